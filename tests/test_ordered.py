"""Ordered computations: the split form of a hot key equals the plain form."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallywise.operators.metrics import confidence_buckets
from tallywise.operators.ordered import exact_median, first_rows, positions, previous_values, row_ordinals, running_sums
from tallywise.operators.scores import average_precision, roc_auc


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    # one key holds most of the rows
    data = [("hot" if i % 3 else f"k{i % 11}", i, rnd.randrange(-50, 50), rnd.randrange(0, 20) / 20) for i in range(900)]
    rnd.shuffle(data)
    return data, spark.createDataFrame(data, "k string, i long, v long, c double").repartition(6).cache()


def levels():
    return [F.floor(F.col("i") / 100), F.floor(F.col("i") / 10)]


@pytest.mark.parametrize("hot_rows", [0, 40, 10**6])
def test_running_sums(rows, hot_rows):
    data, df = rows
    got = {r.i: r.s for r in running_sums(df, ["k"], levels(), [F.col("i")], {"s": F.col("v")}, hot_rows).collect()}
    want, sums = {}, {}
    for k, i, v, _ in sorted(data, key=lambda r: r[1]):
        sums[k] = sums.get(k, 0) + v
        want[i] = sums[k]
    assert got == want


@pytest.mark.parametrize("hot_rows", [0, 40, 10**6])
def test_ordinals_and_previous(rows, hot_rows):
    data, df = rows
    got = {r.i: r.n for r in row_ordinals(df, ["k"], levels(), [F.col("i")], "n", hot_rows).collect()}
    prev = {r.i: r.p for r in previous_values(df, ["k"], F.floor(F.col("i") / 70), ["i"], {"p": "v"}, hot_rows).collect()}
    last, count = {}, {}
    for k, i, v, _ in sorted(data, key=lambda r: r[1]):
        count[k] = count.get(k, 0) + 1
        assert got[i] == count[k]
        assert prev[i] == last.get(k)
        last[k] = v


@pytest.mark.parametrize("hot_rows", [0, 40, 10**6])
def test_exact_median(rows, hot_rows):
    data, df = rows
    got = {r.k: r.m for r in exact_median(df, ["k"], "c", confidence_buckets(F.col("c")), "m", hot_rows).collect()}
    groups = {}
    for k, _, _, c in data:
        groups.setdefault(k, []).append(c)
    assert got == pytest.approx({k: statistics.median(v) for k, v in groups.items()})


def test_first_rows(rows):
    data, df = rows
    got = sorted(r.i for r in first_rows(df, ["k"], [F.col("i")], 2).collect())
    want = []
    for k in {r[0] for r in data}:
        want += sorted(r[1] for r in data if r[0] == k)[:2]
    assert got == sorted(want)


def test_scores_by_brute_force(rows):
    data, df = rows
    scored = df.select("k", (F.col("v") > 0).alias("y"), F.col("c").alias("s"))
    roc = {r.k: r.roc_auc for r in roc_auc(scored, "k", "y", "s").collect()}
    ap = {r.k: r.pr_auc for r in average_precision(scored, "k", "y", "s").collect()}
    for k in roc:
        pts = [(r[3], r[2] > 0) for r in data if r[0] == k]
        pos, neg = [s for s, y in pts if y], [s for s, y in pts if not y]
        wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert roc[k] == pytest.approx(wins / (len(pos) * len(neg)))
        area, hit, seen = 0.0, 0, 0
        for s in sorted({s for s, _ in pts}, reverse=True):
            here = [y for t, y in pts if t == s]
            hit, seen = hit + sum(here), seen + len(here)
            area += sum(here) * hit / seen
        assert ap[k] == pytest.approx(area / len(pos))


@pytest.mark.parametrize("ranges", [None, 1, 3, 13])
@pytest.mark.parametrize("descending", [False, True])
def test_positions(rows, descending, ranges):
    """A third of the keys are null or equal; the row key settles ties."""
    data, df = rows
    keyed = df.withColumn("key", F.when(F.col("i") % 7 != 0, F.when(F.col("k") == "hot", 0).otherwise(F.col("v"))))
    order = [F.col("key").desc_nulls_last() if descending else F.col("key").asc_nulls_first(), F.col("i").asc()]
    got = {r.i: r.at for r in positions(keyed, order, "at", ranges).collect()}
    # nulls are smallest both ways: first when ascending, last when descending
    value = lambda r: None if r[1] % 7 == 0 else 0 if r[0] == "hot" else r[2]
    up = lambda r: (value(r) is not None, value(r) or 0, r[1])
    down = lambda r: (value(r) is None, -(value(r) or 0), r[1])
    assert got == {r[1]: n for n, r in enumerate(sorted(data, key=down if descending else up), 1)}


def test_positions_of_few_rows(spark):
    none = positions(spark.range(0), [F.col("id").asc()], "at")
    assert none.columns == ["id", "at"] and none.count() == 0
    same = positions(spark.createDataFrame([(1,)] * 50, "x int").repartition(5), [F.col("x").asc()], "at", 4)
    assert sorted(r.at for r in same.collect()) == list(range(1, 51))


def test_positions_exchange_rows_once(rows):
    _, df = rows
    plan = positions(df, [F.col("i").asc()], "at")._jdf.queryExecution().executedPlan().toString()
    # what is left after the write exchanges one line per range
    assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan and "_rows" in plan
