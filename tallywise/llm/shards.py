"""Contiguous shards of nearly equal size, by global prefix sums over bytes.

Rows are dealt into ranges of the order once and written; totals per range
give each range its start, and running sums inside the ranges give every row
its global offset. Cuts at equal targets make the shards. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallywise.llm.common import save, text_or_empty

SHARDS = 16


def assign_shards(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, shard, slot.

    ``size`` is the UTF-8 bytes of the text plus 1, so a null or empty text
    counts 1. The order is by id, null ids first, then by checksum, size and
    hash of the text; rows that agree in all of these are alike and take
    neighbouring places. A row belongs to the shard in whose byte range its
    middle lies. ``slot`` counts from 0 inside a shard. An empty table gives an
    empty result; other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("mark"),
                       F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "text_crc32", "size", "mark", "row"]
    dealt = save(spark, rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    # one row per range: no more rows than shuffle partitions
    totals = dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
                           F.sum("bytes").over(whole).alias("total"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (dealt.join(F.broadcast(starts), "part")
              .withColumn("at", F.col("bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1))
    # the middle of a row, times two: 2 * end - size
    shard = F.expr(f"cast((2 * at - size) * {int(shards)} div (2 * total) as int)")
    placed = save(spark, placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "place"), "placed")
    firsts = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # at most ``shards`` rows
    return (placed.join(F.broadcast(firsts), "shard")
            .select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).alias("slot")))


def write_shards(assigned: DataFrame, docs: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write whole rows of ``docs`` as one folder per shard; ids must be unique."""
    key = assigned.select(F.col("doc_id").alias("__shard_id"), F.col("shard").alias("__shard"))
    (docs.join(key, docs[f"`{id_col}`"].eqNullSafe(F.col("__shard_id"))).drop("__shard_id")
     .write.partitionBy("__shard").parquet(path))
