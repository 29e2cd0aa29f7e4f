"""Sides of joins that Spark sizes too low are not broadcast."""

import random

import pytest
from pyspark.sql import functions as F

from tallywise.llm import common, jaccard, simhash
from tests.llm.helpers import documents, near_components, prose


def joins(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {kind for kind in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin") if kind in plan}


def prints(spark, n):
    """Made by Spark, which so knows how small the table is."""
    return spark.range(n).select(F.col("id").alias("node"), F.array(F.xxhash64("id")).alias("print"))


def near_rows():
    base = prose(3, 200).split()
    r = random.Random(4)
    rows = [(1, None), (2, ""), (3, "one"), (4, "one")]
    for k in range(12):
        words = list(base)
        words[r.randrange(200)] = f"new{k}"
        rows.append((10 + k, " ".join(words)))
    return rows + [(40 + k, prose(60 + k, 30)) for k in range(6)]


def test_points_around_fingerprints_are_not_broadcast(spark):
    assert joins(simhash.ball_edges(prints(spark, 100))) == {"SortMergeJoin"}


def test_blocks_of_a_bucket_are_not_broadcast(spark):
    members = spark.range(100).select(F.lit(1).alias("bucket"), F.col("id").alias("node"), F.col("id").alias("root"), F.lit(100).alias("size"))
    pairs = common.cross_pairs(members, 10, lambda a, b: F.lit(True))
    assert joins(pairs) == {"SortMergeJoin"} and pairs.count() == 4950


def test_variants_of_fingerprints_are_not_broadcast(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(simhash, "save", lambda s, df, name: seen.setdefault(name, df))
    simhash.links(spark, prints(spark, 100), 1, 2, 64)
    assert "SortMergeJoin" in joins(seen["members"])


@pytest.mark.parametrize("most", [0, 100_000])
def test_either_kind_of_join_gives_the_same_groups(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    side = common.sized(prints(spark, 5).drop("print"), 5)
    assert joins(prints(spark, 9).join(side, "node")) == ({"BroadcastHashJoin"} if most else {"SortMergeJoin"})
    rows = near_rows()
    docs = documents(spark, rows)
    want, _ = near_components(rows, 3, 1, 2)
    got = simhash.near_groups(spark, docs, paired=2).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    groups = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(spark, docs, paired=4, rounds=1).where("doc_id >= 10").collect()}
    assert groups == {10 + k: 10 for k in range(12)} | {40 + k: 40 + k for k in range(6)}
