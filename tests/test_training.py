"""Merging corrections, models and streams."""

import pytest
from pyspark.sql import functions as F

from tallywise.operators import models as ml, schema, tfidf, training as tr
from tallywise.plans import bindings as b
from tallywise.streaming import ingest


@pytest.fixture(scope="module")
def docs(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", "text", F.col("lang").alias("label")).cache()


@pytest.fixture(scope="module")
def fitted(docs):
    rows = ml.prepare(docs, "doc_id", "text", "label").cache()
    return rows, ml.train(rows, "text", "label", max_features=300)


def test_merge_stops_on_errors(spark, sf, tmp_path):
    training = b.training_rows(spark, sf)
    known = spark.createDataFrame([(x,) for x in b.LABELS], "category string")
    versions = spark.createDataFrame([("household", "v3")], "transaction_source string, source_model_version string")
    bad = b.corrected_file(spark, sf).withColumn("DESCRIPTION", F.when(F.col("row_key") > 5, F.col("DESCRIPTION")))
    at = F.lit("2025-01-01").cast("timestamp")
    with pytest.raises(ValueError, match="validation failed"):
        tr.merge_corrections(training, bad, known, at, versions, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()
    report = tr.merge_corrections(training, b.corrected_file(spark, sf), known, at, versions, str(tmp_path / "t"))
    assert report.where("severity = 'error' and n > 0").count() == 0
    back = spark.read.parquet(str(tmp_path / "t"))
    n = b.corrected_file(spark, sf).count()
    # unknown labels and short texts only warn, so every row is kept
    assert back.count() == n
    assert {(r[0], r[1]) for r in back.select("transaction_source", "source_model_version").distinct().collect()} == {
        ("household", "v3"), ("credit_card", "unknown")}
    assert tr.new_only(back, back, "row_key").count() == 0


def test_merge_reads_leniently_and_loses_nothing(spark, sf, tmp_path):
    training = b.training_rows(spark, sf)
    good = b.corrected_file(spark, sf)
    at = F.lit("2025-01-01").cast("timestamp")
    known = spark.createDataFrame([(x,) for x in b.LABELS], "category string")
    versions = spark.createDataFrame([("household", "v3")], "transaction_source string, source_model_version string")
    date = next(c for c in good.columns if c.lower() == "date")
    typed = good.withColumn(date, F.date_format(F.to_date(F.col(date).cast("string")), "M/d/yyyy"))
    a = tr.prepare_corrections(good, training).select("row_key", "Date")
    assert a.exceptAll(tr.prepare_corrections(typed, training).select("row_key", "Date")).count() == 0
    for wrong in (F.lit(None).cast("string"), F.lit("elsewhere")):
        bad = good.withColumn("transaction_source", F.when(F.col("row_key") % 2 == 0, F.col("transaction_source")).otherwise(wrong))
        with pytest.raises(ValueError, match="validation failed"):
            tr.merge_corrections(training, bad, known, at, versions, str(tmp_path / "x"))
        with pytest.raises(Exception, match="no training version"):
            tr.merged_rows(training, bad, tr.next_versions(training), at, versions).write.format("noop").mode("overwrite").save()
    assert not (tmp_path / "x").exists()
    odd = good.withColumn(date, F.lit("not a date"))
    report = tr.merge_corrections(training, odd, known, at, versions, str(tmp_path / "y"))
    assert report.where("rule = 'cast_loss: Date'").first().n == good.count()


def test_vote_counts_every_model(spark):
    from tallywise.operators.vote import majority_vote
    rows = spark.createDataFrame([("a", "b", "c", "c"), ("b", "a", None, None), (None, None, None, None), ("b", "b", "a", "a")],
                                 "a string, b string, c string, d string")
    assert [r[0] for r in rows.select(majority_vote([F.col(c) for c in "abcd"])).collect()] == ["c", "a", None, "a"]


def test_null_labels_and_batches_stay(spark):
    from tallywise.operators import metrics
    rows = spark.createDataFrame([(i, None if i % 3 else "x", None, i / 10) for i in range(9)],
                                 "id long, label string, batch string, confidence double")
    assert tfidf.stratified_split(rows, "id", "label").count() == 9
    assert metrics.quality_metrics(rows, "batch").first().median == pytest.approx(0.4)


def test_accents_fold_and_missing_registry_is_empty(spark, tmp_path):
    from tallywise.functions.text import fold_accents
    from tallywise.sources.files import scan_registry
    got = spark.createDataFrame([("šőčžă é e\u0301",)], "t string").select(fold_accents(F.col("t"))).first()[0]
    assert got == "soczaee".replace("aee", "a e e")
    assert scan_registry(spark, str(tmp_path / "none.json")).count() == 0


def test_household_amounts_survive(spark, sf):
    raw = b.household(spark, sf).withColumn("Category", F.lit("x")).withColumn("transaction_source", F.lit("household"))
    ready = tr.prepare_corrections(raw, b.training_rows(spark, sf))
    assert ready.where((F.col("Amount") != 0) | (F.col("`Amount (Negated)`") != 0)).count() > 0


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="Out, In"):
        schema.transform_household(spark.createDataFrame([("a", "b")], "Date string, Description string"))
    with pytest.raises(ValueError):
        schema.choose_category(spark.createDataFrame([("a",)], "x string"))


def test_split_is_exact_and_seeded(docs):
    s = tfidf.stratified_split(docs, "doc_id", "label").cache()
    for r in s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("t")).collect():
        assert r.t == int(r.n * 0.2 + 0.5)
    again = tfidf.stratified_split(docs.repartition(3), "doc_id", "label")
    assert s.select("doc_id", "is_test").exceptAll(again.select("doc_id", "is_test")).count() == 0


def test_relational_weights_equal_vectors(docs):
    vocab, weights = tfidf.fit_tfidf(docs, "doc_id", "text", max_features=200)
    features = ml.fit_features(docs, "text", max_features=200)
    names = [r.term for r in vocab.orderBy(F.desc("cf"), "term").collect()]
    vectors = {r.doc_id: r.features for r in ml.featurise(docs, "text", features).select("doc_id", "features").collect()}
    seen = 0
    for r in weights.collect():
        assert vectors[r.doc_id][names.index(r.term)] == pytest.approx(r.weight, abs=1e-12)
        seen += 1
    assert seen == sum(v.numNonzeros() for v in vectors.values()) > 0


def test_predictions(spark, docs, fitted, tmp_path):
    rows, parts = fitted
    got = ml.predict(rows, "text", parts).cache()
    assert got.count() == rows.count()
    assert got.where(~F.col("predicted_category").isin(parts.labels) | (F.col("confidence") < 0) | (F.col("confidence") > 1)).count() == 0
    places = ml.save_models(parts, str(tmp_path / "m"))
    back = ml.load_models(places)
    assert back.labels == parts.labels
    again = ml.predict(rows, None, back)
    cols = ["doc_id", "predicted_category", F.round("confidence", 9).alias("c")]
    assert got.select(*cols).exceptAll(again.select(*cols)).count() == 0


def test_mixed_sources_stay_aligned(docs, fitted):
    _, parts = fitted
    mixed = docs.withColumn("transaction_source", F.when(F.col("doc_id") % 3 == 0, "household")
                            .when(F.col("doc_id") % 3 == 1, "credit_card").otherwise("other"))
    got = ml.predict_by_source(mixed, "text", {"household": parts, "credit_card": parts})
    assert got.count() == docs.count()
    assert got.where("(transaction_source = 'other') <> (predicted_category is null)").count() == 0
    alone = ml.predict(docs, "text", parts).select("doc_id", F.col("predicted_category").alias("p"))
    assert got.join(alone, "doc_id").where("predicted_category <> p").count() == 0


def test_failing_learner_is_left_out(fitted):
    rows, _ = fitted

    class Broken:
        def fit(self, _):
            raise RuntimeError("no")

    learners = {"broken": Broken(), "bayes": ml.make_learners()["bayes"]}
    assert list(ml.train(rows, "text", "label", learners=learners, max_features=100).models) == ["bayes"]
    with pytest.raises(ValueError):
        ml.train(rows, "text", "label", learners={"broken": Broken()}, max_features=100)


def test_evaluation_ranges(fitted):
    rows, parts = fitted
    held = ml.model_columns(rows.where("is_test"), "text", parts)
    r = ml.evaluate(held, "label", "bayes", parts.labels).first()
    assert r.support == rows.where("is_test").count()
    assert all(0 <= r[c] <= 1 for c in ("accuracy", "macro_f1", "weighted_f1", "roc_auc", "pr_auc"))


def test_retrain_failure_keeps_data(spark, tmp_path):
    empty = spark.createDataFrame([], "row_id string, Description string, Category string, transaction_source string")
    assert tr.retrain(spark, empty, "household", "row_id", str(tmp_path / "m"), str(tmp_path / "r")) is None
    with pytest.raises(ValueError, match="no registered"):
        tr.registered_models(spark, str(tmp_path / "r"), "household")


def test_published_models_predict_and_half_runs_are_not_seen(spark, docs, tmp_path, monkeypatch):
    root, registry = str(tmp_path / "m"), str(tmp_path / "r")
    rows = docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("Description"), F.col("label").alias("Category"),
                       F.lit("credit_card").alias("transaction_source"), F.lit(7).alias("training_version"))
    assert tr.retrain(spark, rows, "credit_card", "row_id", root, registry, max_features=100) == 1
    card = tr.registered_models(spark, registry, "credit_card")
    assert card.features.stages[0].getOrDefault("analyzer") == "char_wb" and set(card.models) == set(ml.MODEL_NAMES)
    other = docs.withColumnRenamed("text", "Description")
    before = {r.doc_id: r.predicted_category for r in ml.predict(other, None, card).select("doc_id", "predicted_category").collect()}
    assert set(before.values()) <= set(card.labels)
    with monkeypatch.context() as m:  # the run ends after its models and before its registry entry
        m.setattr(tr, "append_registry", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        assert tr.retrain(spark, rows, "credit_card", "row_id", root, registry, max_features=50) is None
    events = tr.read_registry(spark, registry)
    assert events.agg(F.max("version")).first()[0] == 1
    assert tr.claim_version(spark, root, "credit_card", 1) == 3  # 2 stays claimed; another run gets the next
    assert tr.publish(spark, card, {}, "credit_card", "t", root, registry) == 4
    again = tr.registered_models(spark, registry, "credit_card")
    assert {r.doc_id: r.predicted_category for r in ml.predict(other, None, again).collect()} == before


def test_broken_models_are_left_out(docs, fitted, tmp_path):
    _, parts = fitted
    places = ml.save_models(parts, str(tmp_path / "m"))
    some = ml.load_models({**places, "forest": str(tmp_path / "nothing")})
    assert set(some.models) == set(parts.models) - {"forest"}
    assert ml.predict(docs, "text", some).where("predicted_category is null").count() == 0

    class Broken:
        stages = some.models["bayes"].stages

        def transform(self, _):
            raise RuntimeError("no")

    half = ml.SourceModels(some.features, {"broken": Broken(), "bayes": some.models["bayes"]})
    assert ml.predict(docs, "text", half).count() == docs.count()
    with pytest.raises(ValueError, match="no model can predict"):
        ml.predict(docs, "text", ml.SourceModels(some.features, {"broken": Broken()}))
    with pytest.raises(ValueError, match="could be loaded"):
        ml.load_models({ml.REQUIRED_COMPONENT: places[ml.REQUIRED_COMPONENT], "bayes": str(tmp_path / "no")})


def test_file_drop_takes_each_file_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    run = lambda: ingest.run_file_drop(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "cp"),
                                       lambda x: x.select("txn_id")).awaitTermination()
    (inbox / "a.csv").write_text("txn_id,Date,Description,Amount,transaction_source\n1,2025-01-01,x,5,household\n")
    run()
    (inbox / "b.csv").write_text("txn_id,Date,Description,Amount,transaction_source\n2,2025-01-01,y,6,household\n")
    run()
    run()
    assert sorted(r.txn_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_missing_columns_are_rows_of_the_report(spark, sf, tmp_path):
    from tallywise.operators import validate as val
    training, good = b.training_rows(spark, sf), b.corrected_file(spark, sf)
    known = spark.createDataFrame([(x,) for x in b.LABELS], "category string")
    full = tr.aligned(good, training)
    assert val.column_presence(full).count() == 0
    part = full.drop("Date", "Amount (Negated)", "transaction_source")
    rules = {r.rule: r for r in val.validation_report(part, known).collect()}
    assert {r for r in rules if r.startswith("missing")} == {f"missing_column: {c}" for c in ("Date", "Amount (Negated)", "transaction_source")}
    assert all(rules[r].severity == "error" and rules[r].n == 1 for r in rules if r.startswith("missing"))
    assert not {"bad_date", "all_amounts_zero", "null_negated", "null_source"} & set(rules) and "short_description" in rules
    # a frame without rows still reports what it lacks
    assert val.validation_report(part.limit(0), known).count() == 3
    at = F.lit("2025-01-01").cast("timestamp")
    versions = spark.createDataFrame([("household", "v3")], "transaction_source string, source_model_version string")
    for column in ("DATE", "transaction_source"):
        with pytest.raises(ValueError, match="validation failed"):
            tr.merge_corrections(training, good.drop(column), known, at, versions, str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_garbage_sources_fold_into_one_line(spark):
    from tallywise.operators import validate as val
    rows = spark.createDataFrame([(f"junk {i}", "bad_source", "error", 2) for i in range(500)] + [
        ("household", "bad_date", "warning", 3), (None, "null_source", "error", 4)], "transaction_source string, rule string, severity string, n long")
    got = {(r.transaction_source, r.rule): r.n for r in val.fold_sources(rows).collect()}
    assert got == {("unknown", "bad_source"): 1000, ("household", "bad_date"): 3, (None, "null_source"): 4}
    assert val.blocking_errors(val.fold_sources(rows)).count() == 2


def test_model_versions_never_double_rows(spark, sf):
    training, good = b.training_rows(spark, sf), b.corrected_file(spark, sf)
    at = F.lit("2025-01-01").cast("timestamp")
    versions = lambda *rows: spark.createDataFrame(rows, "transaction_source string, source_model_version string")
    twice = versions(("household", "v3"), ("household", "v3"), ("elsewhere", "v1"), (None, "v1"))
    assert tr.merged_rows(training, good, tr.next_versions(training), at, twice).count() == good.count()
    with pytest.raises(Exception, match="several values of source_model_version"):
        tr.merged_rows(training, good, tr.next_versions(training), at, versions(("household", "v3"), ("household", "v4"))).write.format("noop").mode("overwrite").save()
