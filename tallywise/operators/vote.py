"""Combining the models' labels and confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def majority_vote(labels: list[Column]) -> Column:
    """Majority of the labels; a tie gives the smallest label.

    Works inside the row, so it needs no shuffle. A model that gave no label is
    left out. Three labels or fewer need only comparisons; more are counted.
    """
    if len(labels) > 3:
        given = F.filter(F.array(*labels), lambda x: x.isNotNull())
        counted = F.transform(F.array_distinct(given), lambda x: F.struct(
            (-F.size(F.filter(given, lambda y: y == x))).alias("n"), x.alias("label")))
        return F.array_min(counted)["label"]
    a, b, c = labels + [F.lit(None)] * (3 - len(labels))
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise(F.least(a, b, c))


def mean_confidence(confidences: list[Column]) -> Column:
    """Mean of the models' own top probabilities; absent models are left out."""
    total = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in confidences])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in confidences])
    return F.try_divide(total, n)


def vote_long(votes: DataFrame, row: str, label: str, confidence: str) -> DataFrame:
    """The same vote for any number of models, from one row per model and row id."""
    per_label = votes.groupBy(row, label).agg(
        F.count(label).alias("n"), F.sum(confidence).alias("s"), F.count(confidence).alias("k"))
    best = F.min_by(F.struct(F.col(label)),
                    F.struct(-F.col("n"), F.col(label)))
    return per_label.where(F.col(label).isNotNull()).groupBy(row).agg(
        best[label].alias(label), (F.sum("s") / F.sum("k")).alias(confidence))


def decode(df: DataFrame, encoder: DataFrame, code: str) -> DataFrame:
    """Category of each (source, code); without an entry the code stays as text."""
    names = encoder.select("transaction_source", F.col("code").alias(code),
                           F.col("category").alias("_category"))
    return (df.join(names, ["transaction_source", code], "left")
            .withColumn("category", F.coalesce("_category", F.col(code).cast("string")))
            .drop("_category"))
