"""Evaluation of class predictions and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.operators.metrics import confidence_buckets
from tallywise.operators.ordered import running_sums


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    n, k = counts.agg(F.sum("n")).scalar(), counts.agg(F.count(F.lit(1))).scalar()
    return counts.select(label, "n", (n / (k * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Rows per (truth, predicted) pair, in long form."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class in truth or prediction."""
    cells = confusion(df, truth, predicted)
    hit = F.col(truth) == F.col(predicted)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("long").alias("predicted"),
                 F.when(hit, F.col("n")).otherwise(0).alias("correct")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("long").alias("correct")),
    )).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c)
                                        for c in ("support", "predicted", "correct")])
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rates = sums.withColumns({"precision": safe(F.col("correct"), F.col("predicted")),
                              "recall": safe(F.col("correct"), F.col("support"))})
    p, r = F.col("precision"), F.col("recall")
    return rates.withColumn("f1", safe(2 * p * r, p + r))


def report_averages(report: DataFrame) -> DataFrame:
    """Accuracy with macro and support-weighted averages, from a class report."""
    s = F.col("support")
    names = ["precision", "recall", "f1"]
    return report.agg(
        (F.sum("correct") / F.sum(s)).alias("accuracy"),
        *[F.avg(n).alias(f"macro_{n}") for n in names],
        *[(F.sum(F.col(n) * s) / F.sum(s)).alias(f"weighted_{n}") for n in names],
        F.sum(s).alias("support"))


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return class_report(df, truth, predicted).agg(F.avg("f1").alias("macro_f1"))


def _score_counts(df: DataFrame, group: str, positive: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before any sort."""
    pos = F.col(positive).cast("long")
    return df.groupBy(group, score).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def roc_auc(df: DataFrame, group: str, positive: str, score: str,
            buckets: list[Column] | None = None) -> DataFrame:
    """Area under the ROC curve per class by rank sums with average ranks.

    Scores lie in [0, 1]. A class without positives or negatives gives null.
    """
    counts = _score_counts(df, group, positive, score)
    cut = buckets or confidence_buckets(F.col(score))
    below = running_sums(counts, [group], cut, [F.col(score)], {"neg_upto": F.col("neg")})
    wins = F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2)
    return below.groupBy(group).agg(
        F.try_divide(F.sum(wins), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, group: str, positive: str, score: str,
                      buckets: list[Column] | None = None) -> DataFrame:
    """Sum of recall steps times precision over falling distinct scores per class."""
    counts = _score_counts(df, group, positive, score)
    cut = buckets or confidence_buckets(F.col(score))
    down = running_sums(counts, [group], [-c for c in cut], [F.desc(score)],
                        {"tp": F.col("pos"), "all": F.col("pos") + F.col("neg")})
    return down.groupBy(group).agg(
        F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("all")), F.sum("pos"))
         .alias("pr_auc"))


def macro_average(per_class: DataFrame, value: str) -> DataFrame:
    """Mean over the classes that have a value."""
    return per_class.agg(F.avg(value).alias(value), F.count(value).alias("classes"))
