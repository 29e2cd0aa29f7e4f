"""Split, class joins and vector partitions stay even when one label holds nearly all rows."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywise.functions.text import word_ngrams
from tallywise.operators import models as ml, tfidf


def wanted(rows, fraction=0.2):
    """Keys and labels of the first rows of each label by hash, repeats counted."""
    out = Counter()
    for label in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == label), key=lambda r: "" if r[0] is None else hashlib.md5(f"42:{r[0]}".encode()).hexdigest())
        out.update(mine[:int(len(mine) * fraction + 0.5)])
    return out


@pytest.mark.parametrize("rows", [
    [(k, "a" if k % 50 else "b") for k in range(3000)],
    [(k % 7, "a") for k in range(200)] + [(None, "a")] * 15 + [(5, None)] * 9 + [(6, None), (1, "z")],
    [(3, "a")] * 40, []])
def test_split_equals_ranking(spark, rows):
    df = spark.createDataFrame(rows, "k long, label string").repartition(5)
    got = tfidf.stratified_split(df, "k", "label")
    assert got.columns == ["k", "label", "is_test"] and got.count() == len(rows)
    assert Counter((r.k, r.label) for r in got.where("is_test").collect()) == wanted(rows)


def test_no_row_is_shuffled_by_its_label(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.lit("one").alias("label"), F.repeat(F.lit("word "), 40).alias("text"))
    plan = ml.prepare(df, "k", "text", "label")._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "text" in line] and "Window" not in plan.split("Broadcast")[0]
    exchanged = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert not exchanged


def test_vectors_of_many_rows_are_spread(spark, monkeypatch):
    df = spark.range(4000).select(F.col("id").alias("k"), F.repeat(F.lit("word "), 40).alias("text")).coalesce(1)
    assert ml.spread(df, "text").rdd.getNumPartitions() == 1
    monkeypatch.setattr(ml, "PART_BYTES", 100_000)
    parts = ml.spread(df, "text").rdd.glom().map(len).collect()
    assert len(parts) == 40 and max(parts) < 2 * 4000 / 40 and sum(parts) == 4000
    assert ml.spread(df.where("k < 0"), "text").count() == 0


def test_tokens_are_found_once_for_pairs(spark):
    got = spark.createDataFrame([("Ab cd, ab_1 x",), ("one",), ("",), (None,)], "t string").select(word_ngrams(F.col("t")).alias("w"))
    assert [r.w for r in got.collect()] == [["ab", "cd", "ab_1", "ab cd", "cd ab_1"], ["one"], [], None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
