"""Rolling prediction quality per day, exact at any size.

The stream counts rows per day, source and confidence value. That is the whole
state: it is spread over all keys, a day's part is released once the watermark
has passed it, and every figure of the day, the median included, follows from
the counts. Each micro-batch writes the counts that it changed under its own
number; counts only grow, so the largest of a key is its latest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywise.constants import LOW_CONFIDENCE

COUNTS = "day string, transaction_source string, confidence double, n long, batch int"
BUCKETS = 1000  # of the range 0 to 1, when the median is looked for


def value_counts(df: DataFrame, ts: str = "ts", confidence: str = "confidence", late: str = "1 day") -> DataFrame:
    """``(day, transaction_source, confidence, n)``; of a stream, rows over ``late`` behind the newest are left out."""
    marked = df.withWatermark(ts, late) if df.isStreaming else df
    counts = marked.groupBy(F.window(ts, "1 day").alias("day"), "transaction_source", F.col(confidence).alias("confidence")).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "transaction_source", "confidence", "n")


def counted_median(counts: DataFrame, keys: list[str], value: str, n: str) -> DataFrame:
    """Exact median per key from counts of values, null values left out.

    Buckets of values are counted first, so that a key's windows see at most
    ``BUCKETS`` + 3 rows and then the values of the middle buckets only.
    """
    filled = counts.where(F.col(value).isNotNull()).withColumn(
        "_b", F.floor(F.least(F.greatest(F.col(value), F.lit(-1e-9)), F.lit(1 + 1 / BUCKETS)) * BUCKETS))
    low, high = F.expr("(_total + 1) div 2"), F.expr("(_total + 2) div 2")

    def holds(k):
        return (F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)

    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_bucket = filled.groupBy(*keys, "_b").agg(F.sum(n).alias("_n")).withColumns({
        "_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    middle = per_bucket.where(holds(low) | holds(high)).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_b").alias("_m"), (F.col("_upto") - F.col("_n")).alias("_before"), "_total")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_b") == F.col("_m")]
    near = filled.join(middle, same).select(*keys, "_b", F.col(value).alias("_v"), F.col(n).alias("_n"), "_before", "_total")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = near.withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    return placed.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias("median"))


def daily_quality(counts: DataFrame) -> DataFrame:
    """Size, mean, sample deviation, low rate and exact median per day and source, from ``value_counts``.

    A null confidence counts in the size and as not low, and in nothing else.
    """
    keys = ["day", "transaction_source"]
    c, n = F.col("confidence"), F.col("n")
    total, known = F.sum("n"), F.sum(F.when(c.isNotNull(), n))
    mean = F.sum((c * n).cast("decimal(30,12)")) / known  # exact sums, whatever the order of addition
    square = F.sum(c * c * n) - F.sum(c * n) * F.sum(c * n) / known
    stats = counts.groupBy(*keys).agg(
        total.alias("batch_size"), mean.cast("double").alias("mean"),
        F.when(known > 1, F.sqrt(F.greatest(square, F.lit(0.0)) / (known - 1))).alias("std"),
        F.coalesce(F.sum(F.when(c < LOW_CONFIDENCE, n)), F.lit(0)).alias("low_rows"))
    middle = counted_median(counts, keys, "confidence", "n").select(*[F.col(k).alias(f"_{k}") for k in keys], "median")
    joined = stats.join(middle, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return joined.select(*keys, "batch_size", "mean", "std", (F.col("low_rows") / F.col("batch_size")).alias("low_confidence_rate"),
                         "low_rows", "median")


def latest_counts(spark: SparkSession, results: str) -> DataFrame:
    """The counts of all days so far; empty before the first batch."""
    try:
        table = spark.read.schema(COUNTS).parquet(results)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], COUNTS)
    return table.groupBy("day", "transaction_source", "confidence").agg(F.max("n").alias("n"))


def run_daily_quality(stream: DataFrame, results: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Count all rows now available, then stop. A repeated micro-batch replaces its own folder; no reader's table is touched."""
    def handle(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return (value_counts(stream, late=late).writeStream.outputMode("update").foreachBatch(handle)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
