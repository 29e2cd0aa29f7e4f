"""Batch summaries that merge, so that years of batches are summarised without their rows.

Each batch is stored as one line per key: exact counts and moments, a distinct-count sketch of the
descriptions and a quantile sketch of the confidences. Both sketches are a few kilobytes whatever the
batch holds, and merging them is associative, so any set of stored lines gives a summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.operators.metrics import is_low

DISTINCT_BITS = 14  # 2^14 registers: a standard error below 1 %
QUANTILE_SIZE = 400  # a rank error below 1 %


def batch_sketches(df: DataFrame, keys: list[str], confidence: str = "confidence", text: str = "description") -> DataFrame:
    """One line per key group. Null confidences count as rows only; null texts are not counted as distinct.

    A group without a confidence has a null quantile sketch, one without a text a null distinct sketch.
    """
    c, t = F.col(confidence).cast("double"), F.col(text)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(c).alias("n_scored"), F.sum(is_low(c)).cast("long").alias("low_rows"),
        F.avg(c).alias("mean"), (F.var_pop(c) * F.count(c)).alias("squares"), F.min(c).alias("least"), F.max(c).alias("most"),
        F.when(F.count(t) > 0, F.hll_sketch_agg(t, DISTINCT_BITS)).alias("distinct_sketch"),
        F.when(F.count(c) > 0, F.kll_sketch_agg_double(c, QUANTILE_SIZE)).alias("quantile_sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of the same form for coarser groups; no ``keys`` merges everything."""
    n, m = F.col("n_scored"), F.col("mean")
    total = F.sum("n_scored")
    mean = F.try_divide(F.sum(n * m), total)
    # squares around the common mean: those inside the parts and those between them
    between = F.sum(n * m * m) - total * mean * mean
    return sketches.groupBy(*keys).agg(
        F.sum("n_rows").alias("n_rows"), total.alias("n_scored"), F.sum("low_rows").alias("low_rows"), mean.alias("mean"),
        (F.sum("squares") + F.greatest(between, F.lit(0.0))).alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.when(F.count("distinct_sketch") > 0, F.hll_union_agg("distinct_sketch")).alias("distinct_sketch"),
        F.when(F.count("quantile_sketch") > 0, F.kll_merge_agg_double("quantile_sketch", QUANTILE_SIZE)).alias("quantile_sketch"))


def sketch_summary(sketches: DataFrame, keys: list[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Counts, moments and rates, which are exact, with estimates of distinct texts and quantiles."""
    asked = quantiles or {"median": 0.5, "lower_tenth": 0.1}
    return sketches.select(
        *keys, "n_rows", "n_scored", "mean", "least", "most",
        F.when(F.col("n_scored") > 1, F.sqrt(F.col("squares") / (F.col("n_scored") - 1))).alias("std"),
        F.try_divide(F.col("low_rows"), F.col("n_rows")).alias("low_confidence_rate"),
        F.coalesce(F.hll_sketch_estimate("distinct_sketch"), F.lit(0).cast("long")).alias("distinct_texts"),
        *[F.kll_sketch_get_quantile_double("quantile_sketch", F.lit(q)).alias(n) for n, q in asked.items()])


def store_batches(sketches: DataFrame, path: str, batch: str) -> None:
    """Add the lines of these batches; a batch that is stored already is replaced, all others stay."""
    (sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(batch).parquet(path))


def stored_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored lines. A filter on the batch column reads only the folders it names."""
    return spark.read.schema(schema).parquet(path)
