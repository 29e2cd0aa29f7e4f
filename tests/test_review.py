"""Votes, tiers, corrections and alerts on edge rows."""

import pytest
from pyspark.sql import functions as F

from tallywise.operators import metrics as mt, review, validate, vote


def test_vote_rules(spark):
    rows = spark.createDataFrame([(1, "b", "a", "c"), (2, "b", "a", "b"), (3, "b", "a", None), (4, "c", "c", "a"), (5, None, None, "z"),
                                  (6, None, None, None), (7, "c", "b", "b")], "i int, x string, y string, z string")
    got = {r.i: r.v for r in rows.select("i", vote.majority_vote([F.col("x"), F.col("y"), F.col("z")]).alias("v")).collect()}
    assert got == {1: "a", 2: "b", 3: "a", 4: "c", 5: "z", 6: None, 7: "b"}
    two = {r.i: r.v for r in rows.select("i", vote.majority_vote([F.col("x"), F.col("y")]).alias("v")).collect()}
    assert two[1] == "a" and two[4] == "c"


def test_mean_confidence(spark):
    rows = spark.createDataFrame([(0.5, 0.7, None), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in rows.select(vote.mean_confidence([F.col("a"), F.col("b"), F.col("c")])).collect()]
    assert got[0] == pytest.approx(0.6) and got[1] is None


def test_tier_edges_and_nulls(spark):
    rows = spark.createDataFrame([("x", v) for v in (0.5, 0.7, 0.71, 0.49, None)], "b string, confidence double")
    t = mt.confidence_tiers(rows, "b").first()
    assert (t.n_rows, t.high, t.medium, t.low) == (5, 1, 2, 1)
    m = mt.quality_metrics(rows, "b").first()
    assert m.batch_size == 5 and m.low_confidence_rate == pytest.approx(0.2) and m.median == pytest.approx(0.6)


def test_alerts_are_strict(spark):
    rows = spark.createDataFrame([("a", 0.2, 0.6), ("b", 0.21, 0.59), ("c", None, None)], "b string, low_confidence_rate double, mean double")
    got = sorted((r.b, r.alert) for r in mt.quality_alerts(rows, "b").collect())
    assert got == [("b", "high_low_confidence_rate"), ("b", "low_mean_confidence")]


def test_corrections(spark):
    rows = spark.createDataFrame([(0, "p", 0.9), (1, "p", 0.4), (2, "p", 0.4)], "id long, predicted_category string, confidence double")
    req = spark.createDataFrame([(0, "x", 1), (0, "y", 3), (0, "z", 2), (1, "", 1), (-1, "q", 1), (99, "q", 1), (None, "q", 1)],
                                "id long, new_category string, seq long")
    got = {r.id: (r.predicted_category, r.confidence, r.requests) for r in
           review.apply_corrections(rows, req, "id", "predicted_category").collect()}
    assert got == {0: ("y", 1.0, 3), 1: ("p", 0.4, 0), 2: ("p", 0.4, 0)}


def test_review_reaches_low_confidence_only(spark):
    rows = spark.createDataFrame([(0, "p", 0.7), (1, "p", 0.69), (2, "p", 0.1)], "id long, predicted_category string, confidence double")
    ans = spark.createDataFrame([(0, "x", 1), (1, " x ", 1), (2, "  ", 1)], "id long, answer string, seq long")
    got = {r.id: (r.predicted_category, r.confidence) for r in review.apply_review(rows, ans, "id", "predicted_category").collect()}
    assert got == {0: ("p", 0.7), 1: ("x", 1.0), 2: ("p", 0.1)}


def test_sort_is_type_aware(spark):
    rows = spark.createDataFrame([(0, "10", "b"), (1, "9", "A"), (2, "x", "c")], "i int, Amount string, Description string")
    order = lambda c, down=False: [r.i for r in review.sort_rows(rows, c, "i", down).collect()]
    assert order("Amount") == [2, 1, 0] and order("Amount", True) == [0, 1, 2] and order("Description") == [1, 0, 2]


def test_drift_of_equal_batches_is_zero(spark):
    a = spark.createDataFrame([("x",), ("x",), ("y",)], "l string")
    r = mt.category_drift(a, a, "l").first()
    assert r.psi == pytest.approx(0) and r.tv_distance == pytest.approx(0)
    only = spark.createDataFrame([("z",)], "l string")
    assert mt.category_drift(a, only, "l").first().tv_distance == pytest.approx(1)


def test_a_table_that_keeps_no_row_is_an_error(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 3.0), (3, "b", 4.0)], "i int, x string, y double")
    assert [r.i for r in validate.complete_rows(rows, ["x", "y"], "ledger").collect()] == [3]
    for none in (rows.where("i < 3"), rows.limit(0)):
        with pytest.raises(ValueError, match="ledger: no row has all of x, y"):
            validate.complete_rows(none, ["x", "y"], "ledger")
