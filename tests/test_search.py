"""Model search by successive halving."""

import duckdb
import pytest
from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from tallywise.operators import models as ml, search as se, training as tr
from tallywise.plans import bindings as b


@pytest.fixture(scope="module")
def rows(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return ml.prepare(docs, "doc_id", "text", "label").cache()


def bayes(smoothing):
    return NaiveBayes(modelType="multinomial", smoothing=smoothing, featuresCol="features", labelCol="code", weightCol="weight")


class Broken:
    def fit(self, _):
        raise RuntimeError("no")


def test_plan_spends_the_budget():
    assert se.round_plan(9, 6) == [(9, pytest.approx(1 / 3)), (3, 1.0)]
    assert se.round_plan(1, 6) == [(1, 1.0)]
    for n in range(1, 40):
        plan = se.round_plan(n, 4)
        assert sum(k * s for k, s in plan) <= 4 + 1e-9 and plan[0][0] == n
        assert all(a[0] > c[0] and a[1] <= c[1] for a, c in zip(plan, plan[1:]))


def test_folds_need_no_shuffle_and_are_nested(spark, rows):
    folded = se.with_folds(spark.range(5000).withColumnRenamed("id", "k"), "k", 4)
    assert "Exchange" not in folded._jdf.queryExecution().executedPlan().toString()
    got = folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("a"), F.max("place").alias("z")).collect()
    assert len(got) == 4 and all(1100 < r.n < 1400 and 0 <= r.a < 0.01 and 0.99 < r.z < 1 for r in got)
    again = se.with_folds(spark.range(5000).withColumnRenamed("id", "k").repartition(7), "k", 4)
    assert folded.exceptAll(again).count() == 0
    nulls = spark.createDataFrame([(None,), (1,)], "k long")
    assert se.with_folds(nulls, "k").where("fold is null or place is null").count() == 0


def test_scores_follow_from_stored_predictions(spark, rows, tmp_path):
    options = {f"bayes_{i}": bayes(s) for i, s in enumerate((0.01, 0.1, 1.0, 10.0))} | {"broken_0": Broken()}
    found = se.halving(rows, "doc_id", "text", "label", candidates=options, max_features=300, folds=3)
    found.predictions.write.parquet(str(tmp_path / "p"))
    want = duckdb.sql(f"""WITH p AS (SELECT * FROM '{tmp_path}/p/*.parquet'),
      c AS (SELECT DISTINCT round, candidate, unnest([code::DOUBLE, predicted]) AS class FROM p),
      f AS (SELECT c.round, c.candidate, class, 2.0 * COUNT(*) FILTER (code = class AND predicted = class)
         / (COUNT(*) FILTER (code = class) + COUNT(*) FILTER (predicted = class)) AS f1
        FROM c JOIN p ON p.round = c.round AND p.candidate = c.candidate GROUP BY ALL)
      SELECT round, candidate, n, accuracy, macro_f1 FROM (SELECT round, candidate, AVG(f1) AS macro_f1 FROM f GROUP BY ALL)
       JOIN (SELECT round, candidate, COUNT(*) AS n, AVG((code = predicted)::INT) AS accuracy FROM p GROUP BY ALL) USING (round, candidate)""").fetchall()
    got = {(r.round, r.candidate): r for r in found.scores.collect()}
    assert len(got) == len(want) > 0
    for number, name, n, accuracy, macro in want:
        r = got[number, name]
        assert (r.n_rows, r.accuracy, r.macro_f1) == (n, pytest.approx(accuracy), pytest.approx(macro))
    assert not any(name == "broken_0" for _, name in got)
    last = max(k for k, _ in got)
    final = [(-r.macro_f1, r.candidate) for (k, _), r in got.items() if k == last]
    assert found.winner == min(final)[1]
    # every row outside the test part is judged once in the round of its fold
    train = se.with_folds(rows.where("not is_test"), "doc_id", 3)
    sizes = {r.fold: r.n for r in train.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(r.n_rows == sizes[k % 3] for (k, _), r in got.items())
    judged = ml.predict(rows, "text", found.source)
    assert judged.where(~F.col("predicted_category").isin(found.source.labels)).count() == 0


def test_nothing_trainable_is_an_error(rows):
    with pytest.raises(ValueError, match="no candidate"):
        se.halving(rows, "doc_id", "text", "label", candidates={"broken_0": Broken()}, max_features=50)


def test_winner_is_registered(spark, sf, tmp_path):
    training = b.training_rows(spark, sf).withColumn("Category", F.substring_index("Description", " ", 1)).withColumn(
        "row_id", F.monotonically_increasing_id()).cache()
    root, registry = str(tmp_path / "m"), str(tmp_path / "r")
    assert tr.retrain(spark, training, "household", "row_id", root, registry, budget=2.0, max_features=100) == 1
    back = tr.registered_models(spark, registry, "household")
    assert len(back.models) == 1 and next(iter(back.models)) in ml.MODEL_NAMES
    assert ml.predict(training, None, back).where("predicted_category is null").count() == 0
