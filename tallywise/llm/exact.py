"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries find the digests that can hold more than one row in
``counters + 1``. Their counts are verified, and the winners, at most
``counters`` rows, are broadcast: rows of these digests get their decision on
the map side and are never shuffled. All other digests use ordinary shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.llm.common import prepare_workers, save, sized, text_or_empty

COUNTERS = 1024
FAN_IN = 128
LEVELS = 3  # FAN_IN ** LEVELS partitions, over two million

SUMMARY = "pid long, digest binary, n long"


def fold(counters: dict[bytes, int], counts: Iterable[tuple[bytes, int]], limit: int) -> dict[bytes, int]:
    """Add counts to a Misra-Gries summary; the result has at most ``limit`` counters."""
    for digest, n in counts:
        counters[digest] = counters.get(digest, 0) + int(n)
    if len(counters) > limit:
        cut = sorted(counters.values(), reverse=True)[limit]
        counters = {d: n - cut for d, n in counters.items() if n > cut}
    return counters


def frequent(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Candidates: every digest of more than N / (counters + 1) rows is among them; at most ``counters`` rows."""
    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, int] = {}
        for rows in batches:
            held = fold(held, rows["digest"].value_counts().items(), counters)
        yield pd.DataFrame({"pid": TaskContext.get().partitionId(), "digest": list(held), "n": list(held.values())})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[bytes, int] = {}
        for _, part in rows.groupby("part"):
            held = fold(held, zip(part["digest"], part["n"]), counters)
        return pd.DataFrame({"pid": rows["pid"].iloc[0], "digest": list(held), "n": list(held.values())})

    found = digests.select("digest").mapInPandas(summarise, SUMMARY)
    for _ in range(LEVELS):
        found = (found.withColumn("part", F.col("pid")).withColumn("pid", F.floor(F.col("pid") / FAN_IN))
                 .groupBy("pid").applyInPandas(merge, SUMMARY))
    return found.select("digest")


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became
    one space. A null text counts as empty. The smallest id of a group stays;
    null ids are never the smallest unless the group has no other. Repeated
    rows with the id that stays are all marked as kept. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    prepare_workers(spark)
    text = F.regexp_replace(text_or_empty(text_col), r"[\x20\x09-\x0D]+", " ")
    digests = save(spark, docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")),
                   "digests")
    total = digests.count()
    group = (F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = save(spark, digests.join(F.broadcast(frequent(digests, counters)), "digest", "left_semi")
                   .groupBy("digest").agg(*group).where(F.col("group_size") * (counters + 1) > total), "winners")
    heavy = digests.join(F.broadcast(winners), "digest")
    rest = digests.join(F.broadcast(winners), "digest", "left_anti")
    light = rest.join(sized(rest.groupBy("digest").agg(*group), total), "digest")
    return heavy.unionByName(light).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
