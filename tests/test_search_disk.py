"""What a model search leaves on disk."""

from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from tallywise.operators import models as ml, search as se
from tallywise.session import DROP_SHUFFLES, READ_PARTS

ROWS, TERMS, PART = 400, 20, 4_000


class Seen:
    """Fits, and notes what it was given."""

    def __init__(self):
        self.plans, self.parts = [], []

    def fit(self, rows):
        self.plans.append(rows._jdf.queryExecution().executedPlan().toString())
        self.parts.append(rows.rdd.getNumPartitions())
        return NaiveBayes(featuresCol="features", labelCol="code", weightCol="weight").fit(rows)


def test_vectors_are_dealt_out_once_and_not_for_every_fit(spark, monkeypatch):
    monkeypatch.setattr(ml, "PART_BYTES", PART)
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}"), F.col("id") % (k + 2)) for k in range(6)])
    rows = spark.range(ROWS).select("id", words.alias("text"), F.concat(F.lit("c"), F.col("id") % 3).alias("label"))
    before = spark.conf.get(DROP_SHUFFLES), spark.conf.get(READ_PARTS, None)
    prepared = ml.prepare(rows, "id", "text", "label")
    train = prepared.where("not is_test").count()
    options = {f"bayes_{k}": Seen() for k in range(4)}
    found = se.halving(prepared, "id", "text", "label", candidates=options, folds=3, max_features=TERMS)
    wanted = -(-train * (ml.ROW_BYTES + 4 * TERMS) // PART)
    assert wanted > spark.sparkContext.defaultParallelism
    for seen in options.values():
        assert all("Exchange" not in plan for plan in seen.plans) and set(seen.parts) == {wanted}
    assert found.predictions.where("round = 0").groupBy("candidate").count().select("count").distinct().count() == 1
    assert (spark.conf.get(DROP_SHUFFLES), spark.conf.get(READ_PARTS, None)) == before
