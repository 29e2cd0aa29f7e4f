"""Helpers that the operators of this package share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise.session import DROP_SHUFFLES, scratch_path, shuffles_dropped  # noqa: F401

BATCH_ROWS = 1000
BATCH_BYTES = 32 * 1024 * 1024
BROADCAST_ROWS = 100_000  # some 10 to 35 MB as a broadcast; Spark may choose one for a join side of so many rows


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Send this library to the Python workers once per application, wherever the driver found it.

    Arrow batches are kept small, so that a worker holds few texts at a time however long they are.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        base = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tallywise-")), "tallywise_package")
        context.addPyFile(shutil.make_archive(base, "zip", root, "tallywise"))
        _SHIPPED.add(context.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def saved(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write a table to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def save(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    return saved(spark, df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` as one side of a join; with over ``BROADCAST_ROWS`` rows, or none known, neither side is broadcast.

    Spark sizes a side by its files, or by what goes into an explode or a Python step. That says little about
    the rows that come out, and a side planned as a broadcast stays one whatever its shuffle turns out to hold.
    """
    return df if rows is not None and rows <= BROADCAST_ROWS else df.hint("merge")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(f"`{col}`").cast("string"), F.lit(""))


def id_and_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator needs: ``doc_id`` and ``body``, the UTF-8 bytes (null text: empty)."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("body"))


def held_out(modulus: int, remainder: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % modulus == remainder, F.lit(False))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` less the ids in ``dropped.doc_id``; all columns stay. Rows with a null id stay."""
    out = dropped.select(F.col("doc_id").alias("__dropped_id")).where("__dropped_id is not null").distinct()
    return docs.join(out, docs[f"`{id_col}`"] == F.col("__dropped_id"), "left_anti")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the smallest node.

    Alternates the large-star and small-star steps: every step is an aggregate
    and an equality join, each round is written to the shared folder, and the
    loop ends when a round changes nothing. Nothing is gathered per node.
    """
    edges = edges.toDF("a", "b")
    now, path = saved(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                      .distinct(), "edges")
    mark = None
    while True:
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if found[0] == 0 or tuple(found) == mark:
            break
        mark = tuple(found)
        both = now.union(now.select("b", "a"))
        low = sized(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), 2 * found[0])
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large, middle = saved(spark, large, "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(sized(low, 2 * found[0]), "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(low.select("a", F.col("low").alias("b"))).distinct())
        last = path
        now, path = saved(spark, small, "small-star")
        remove(spark, last, middle)  # each round holds all that is known
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def cross_pairs(members: DataFrame, block: int, near: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket, have different roots and are ``near``.

    ``members`` has bucket, node, root and size (rows of the bucket). A bucket is cut into blocks of about
    ``block`` rows; every two blocks meet under a key of their own, so that no task holds a whole bucket.
    """
    blocks = F.ceil(F.col("size") / block)
    cut = (members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
           .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
           .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")))
    x, y = cut.where("own = i").alias("x"), cut.where("own = j").alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("bucket", "i", "j")]
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("x.i") < F.col("x.j")) | (F.col("x.node") < F.col("y.node")))
    return x.join(sized(y), [*on, apart & near("x", "y")]).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
