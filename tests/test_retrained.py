"""A retraining that fails does not look like a result."""

import pytest

from tallywise.operators import models as ml, training as tr
from tallywise.plans import classifiers


def training(spark, sources):
    rows = [(f"{s}:{i}", f"{word} shop {i % 7}", word, s, 1) for s in sources for i, word in enumerate(["bread", "fuel", "rent"] * 20)]
    return spark.createDataFrame(rows, "row_id string, Description string, Category string, transaction_source string, training_version int")


def test_a_source_that_cannot_be_trained_stops_the_job(spark):
    with pytest.raises(Exception):
        classifiers.registered(spark, training(spark, ["household"])).collect()


def test_a_lost_learner_stops_the_job(spark, tmp_path, monkeypatch):
    usual = ml.make_learners()

    class Broken:
        def fit(self, _):
            raise RuntimeError("no memory")

    monkeypatch.setattr(ml, "make_learners", lambda *_: {"logistic": Broken(), "forest": Broken(), "bayes": usual["bayes"]})
    rows, root, registry = training(spark, ["household"]), str(tmp_path / "m"), str(tmp_path / "r")
    with pytest.raises(ValueError, match="household could not be trained: logistic, forest"):
        tr.retrained(spark, rows, "household", "row_id", root, registry, whole=True)
    assert tr.read_registry(spark, registry).isEmpty()
    assert tr.retrain(spark, rows, "household", "row_id", root, registry) == 1  # this caller takes what there is
    assert {r.model for r in tr.read_registry(spark, registry).select("model").collect()} == {"household_tfidf_vectorizer", "household_bayes"}


def test_a_lost_registry_entry_is_raised(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ml, "make_learners", lambda make=ml.make_learners: {"bayes": make()["bayes"]})
    monkeypatch.setattr(tr, "append_registry", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        tr.retrained(spark, training(spark, ["household"]), "household", "row_id", str(tmp_path / "m"), str(tmp_path / "r"))
