"""Prediction-quality metrics, frequencies, drift and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.constants import ALERT_LOW_RATE, ALERT_MEAN, LOW_CONFIDENCE, REVIEW_CONFIDENCE
from tallywise.operators.ordered import exact_median, previous_values

# two levels: the finer one leaves about a million distinct doubles per bucket at most
CONFIDENCE_STEPS = [2**16, 2**32]


def confidence_buckets(c: Column) -> list[Column]:
    """Coarse and fine bucket of a value in [0, 1], both in its order."""
    return [F.floor(c * float(n)).cast("long") for n in CONFIDENCE_STEPS]


def frequencies(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per label; rows without a label are left out."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(label, "n", (F.col("n") / total).alias("share"))


def is_low(confidence: Column) -> Column:
    """1.0 below the threshold, else 0.0; a null counts as not low."""
    return F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False)).cast("double")


def quality_metrics(df: DataFrame, batch: str, confidence: str = "confidence",
                    accuracy: int | None = None) -> DataFrame:
    """Size, mean, median, sample deviation and low rate per batch.

    The median is exact unless ``accuracy`` asks for the approximate sketch.
    """
    c = F.col(confidence)
    basic = [F.count(F.lit(1)).alias("batch_size"), F.avg(c).alias("mean"),
             F.stddev_samp(c).alias("std"), F.avg(is_low(c)).alias("low_confidence_rate")]
    if accuracy:
        return df.groupBy(batch).agg(
            *basic, F.percentile_approx(c, 0.5, accuracy).alias("median"))
    medians = exact_median(df, [batch], confidence, confidence_buckets(c), "median")
    medians = medians.select(F.col(batch).alias("_batch"), "median")
    return df.groupBy(batch).agg(*basic).join(medians, F.col(batch).eqNullSafe(F.col("_batch")), "left").drop("_batch")


def quality_alerts(metrics: DataFrame, batch: str) -> DataFrame:
    """One row per alert: too many low confidences, or a low mean."""
    alerts = F.array_compact(F.array(
        F.when(F.col("low_confidence_rate") > ALERT_LOW_RATE,
               F.struct(F.lit("high_low_confidence_rate").alias("alert"),
                        F.col("low_confidence_rate").alias("value"))),
        F.when(F.col("mean") < ALERT_MEAN,
               F.struct(F.lit("low_mean_confidence").alias("alert"),
                        F.col("mean").alias("value")))))
    return metrics.select(batch, F.explode(alerts).alias("a")).select(batch, "a.alert", "a.value")


def distribution_map(df: DataFrame, batch: str, label: str) -> DataFrame:
    """Label counts of each batch as one map; labels come from the dictionary."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(batch, label)
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy(batch).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(label, "n"))))
         .alias("category_distribution"))


def metrics_log(df: DataFrame, batch: str, label: str, at: Column) -> DataFrame:
    """Log rows: timestamp, size, confidence statistics and category counts."""
    stats = quality_metrics(df, batch)
    return stats.join(distribution_map(df, batch, label), batch, "left").select(
        batch, at.alias("ts"), "batch_size",
        F.struct("mean", "median", "std", "low_confidence_rate").alias("confidence_stats"),
        "category_distribution")


def confidence_tiers(df: DataFrame, batch: str) -> DataFrame:
    """High, medium and low counts and shares; a null is in no tier."""
    c = F.col("confidence")
    n = F.count(F.lit(1))
    tiers = {"high": c > REVIEW_CONFIDENCE,
             "medium": (c >= LOW_CONFIDENCE) & (c <= REVIEW_CONFIDENCE),
             "low": c < LOW_CONFIDENCE}
    counts = df.groupBy(batch).agg(n.alias("n_rows"),
                                   *[F.count_if(t).alias(k) for k, t in tiers.items()])
    return counts.withColumns({f"{k}_share": F.col(k) / F.col("n_rows") for k in tiers})


def top_labels(df: DataFrame, label: str, k: int = 5) -> DataFrame:
    """The k most frequent labels, with the number of labels left over."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")))
    n_labels = counts.agg(F.count(F.lit(1))).scalar()
    return (counts.orderBy(F.desc("n"), label).limit(k)
            .withColumn("other_labels", F.greatest(n_labels - k, F.lit(0))))


def dataset_summary(df: DataFrame, group: str, approximate: bool = False) -> DataFrame:
    """Rows, date range, distinct descriptions and money total per group."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("Date").alias("first_date"),
        F.max("Date").alias("last_date"), distinct(F.col("Description")).alias("descriptions"),
        F.sum("Amount").alias("total_amount"))


def run_summary(df: DataFrame, group: str) -> DataFrame:
    c = F.col("confidence")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.avg(c).alias("mean_confidence"),
                                 F.count_if(c < LOW_CONFIDENCE).alias("low_rows"))


def category_drift(old: DataFrame, new: DataFrame, label: str, floor: float = 1e-4) -> DataFrame:
    """Population stability index and total variation distance of two batches.

    Shares are floored before the logarithm so that a label one batch lacks
    gives a finite index.
    """
    a = frequencies(old, label).select(label, F.col("share").alias("old_share"))
    b = frequencies(new, label).select(label, F.col("share").alias("new_share"))
    both = a.join(b, label, "full").select(
        F.coalesce("old_share", F.lit(0.0)).alias("p"), F.coalesce("new_share", F.lit(0.0)).alias("q"))
    p, q = F.greatest("p", F.lit(floor)), F.greatest("q", F.lit(floor))
    return both.agg(F.sum((q - p) * F.log(q / p)).alias("psi"),
                    (F.sum(F.abs(F.col("q") - F.col("p"))) / 2).alias("tv_distance"),
                    F.count(F.lit(1)).alias("labels"))


def correction_rate(audited: DataFrame, groups: list[str]) -> DataFrame:
    return audited.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg((F.col("check") == "Not Correct").cast("double")).alias("correction_rate"))


def version_comparison(registry: DataFrame, block: int = 1000) -> DataFrame:
    """Each metric of each version next to the version before it."""
    long = registry.select("model", "version", F.explode("metrics").alias("metric", "value"))
    prev = previous_values(long, ["model", "metric"], F.floor(F.col("version") / block),
                           ["version"], {"previous": "value"})
    return prev.withColumn("change", F.col("value") - F.col("previous"))
