"""Stored batch summaries and their merging."""

import pytest
from pyspark.sql import functions as F

from tallywise.operators import sketches as sk


@pytest.fixture(scope="module")
def rows(spark):
    # a hot day with a third of all rows, a day without confidences, one without texts
    day = F.when(F.col("id") % 3 == 0, "d00").otherwise(F.format_string("d%02d", (F.col("id") % 20).cast("int")))
    r = spark.range(60000).select("id", day.alias("day"), F.xxhash64("id").alias("h"))
    return r.select(
        "day", F.when((F.col("day") != "d07") & (F.col("id") % 11 != 0), F.pmod("h", F.lit(10007)) / 10007).alias("confidence"),
        F.when(F.col("day") != "d08", F.concat(F.lit("text "), F.pmod("h", F.lit(5003)).cast("string"))).alias("description")).cache()


def exact(rows):
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("confidence").alias("n_scored"), F.avg("confidence").alias("mean"),
        F.stddev_samp("confidence").alias("std"), F.min("confidence").alias("least"), F.max("confidence").alias("most"),
        F.avg(F.coalesce(F.col("confidence") < 0.5, F.lit(False)).cast("double")).alias("low_confidence_rate"),
        F.count_distinct("description").alias("distinct_texts")).first()


def near(got, want):
    for name in ("n_rows", "n_scored", "mean", "std", "least", "most", "low_confidence_rate"):
        assert got[name] == pytest.approx(want[name], rel=1e-9), name
    assert got.distinct_texts == pytest.approx(want.distinct_texts, rel=0.03)
    assert got.median == pytest.approx(0.5, abs=0.02) and got.lower_tenth == pytest.approx(0.1, abs=0.02)


def test_merged_days_equal_one_pass(rows):
    whole = sk.sketch_summary(sk.batch_sketches(rows, []), []).first()
    days = sk.batch_sketches(rows, ["day"])
    merged = sk.sketch_summary(sk.merge_sketches(days, []), []).first()
    near(whole, exact(rows))
    near(merged, exact(rows))
    # merging in two steps changes nothing but the order
    half = F.substring("day", 3, 1).alias("half")
    steps = sk.merge_sketches(sk.merge_sketches(days.withColumn("half", half), ["half"]), [])
    near(sk.sketch_summary(steps, []).first(), exact(rows))


def test_days_without_values(rows):
    out = {r.day: r for r in sk.sketch_summary(sk.batch_sketches(rows, ["day"]), ["day"]).collect()}
    assert out["d07"].n_scored == 0 and out["d07"].mean is None and out["d07"].median is None and out["d07"].n_rows > 0
    assert out["d08"].distinct_texts == 0 and out["d08"].median is not None
    alone = sk.merge_sketches(sk.batch_sketches(rows.where("day = 'd07'"), ["day"]), [])
    assert sk.sketch_summary(alone, []).first().mean is None
    none = sk.sketch_summary(sk.merge_sketches(sk.batch_sketches(rows.limit(0), ["day"]), ["day"]), ["day"])
    assert none.count() == 0


def test_repeated_batch_replaces_itself(spark, rows, tmp_path):
    days, path = sk.batch_sketches(rows, ["day"]), str(tmp_path / "s")
    sk.store_batches(days, path, "day")
    before = exact(rows)
    sk.store_batches(days.where("day in ('d01', 'd02')"), path, "day")
    near(sk.sketch_summary(sk.merge_sketches(sk.stored_batches(spark, path, days.schema), []), []).first(), before)
    # a late file: its day is summarised anew, the rows of other days are not read
    more = rows.unionByName(rows.where("day = 'd02'").limit(10))
    sk.store_batches(sk.batch_sketches(more.where("day = 'd02'"), ["day"]), path, "day")
    stored = sk.stored_batches(spark, path, days.schema)
    assert sk.merge_sketches(stored, []).first().n_rows == before.n_rows + 10
    plan = stored.where("day = 'd02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
