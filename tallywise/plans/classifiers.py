"""Training, prediction, evaluation and the feedback loop with Spark ML."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window, functions as F

from tallywise.constants import MIN_CATEGORY_SAMPLES, SPLIT_SEED, TEST_FRACTION
from tallywise.operators import models as ml, registry as reg, training as tr
from tallywise.operators.search import halving
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6
from tallywise.plans.text_features import FIT, WEIGHTS, WORDS
from tallywise.session import materialise, scratch_path


def documents(spark, d):
    """Whole documents with their language as label, split into train and test."""
    docs = b.table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return materialise(spark, ml.prepare(docs, "doc_id", "text", "label"), "prepared")


def rounded(df):
    return df.select(*[r6(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


@query("k06_k09_train_and_evaluate")
def train_and_evaluate(spark, d):
    rows = documents(spark, d)
    fitted = ml.train(rows, "text", "label")
    held_out = ml.model_columns(rows.where("is_test"), "text", fitted)
    held_out = materialise(spark, held_out.drop("text"), "scored")
    out = None
    for name in fitted.models:
        one = ml.evaluate(held_out, "label", name, fitted.labels)
        out = one if out is None else out.unionByName(one)
    return rounded(out)


@query("k07_model_search")
def model_search(spark, d):
    """Scores of every round of the search; the predictions behind them are stored."""
    found = halving(documents(spark, d), "doc_id", "text", "label")
    last = F.max("round").over(Window.partitionBy(F.lit(1)))  # one line per round and candidate
    return rounded(found.scores.withColumn("winner", (F.col("round") == last) & (F.col("candidate") == found.winner)))


BAYES = f"""WITH {WORDS}, sized AS (SELECT doc_id, COALESCE(lang, 'Other') AS label, COUNT(*) OVER (PARTITION BY COALESCE(lang, 'Other')) AS n FROM documents),
split AS (SELECT doc_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY md5('{SPLIT_SEED}:' || doc_id), doc_id) > ROUND(n * {TEST_FRACTION}) AS fitted
 FROM sized WHERE n >= {MIN_CATEGORY_SAMPLES}),
fit AS (SELECT doc_id, label FROM split WHERE fitted), tr AS (SELECT tf.* FROM tf JOIN fit USING (doc_id)),
{FIT.format(docs='fit', tf='tr')}, {WEIGHTS.format(row='doc_id', tf='tf')},
classes AS (SELECT label, COUNT(*) AS rows, (SELECT COUNT(*) FROM fit) / ((SELECT COUNT(DISTINCT label) FROM fit) * COUNT(*)) AS balance FROM fit GROUP BY 1),
seen AS (SELECT label, term, SUM(weight * balance) AS s FROM weights JOIN fit USING (doc_id) JOIN classes USING (label) GROUP BY ALL),
cells AS (SELECT label, term, COALESCE(s, 0) + 1 AS s FROM classes CROSS JOIN vocab LEFT JOIN seen USING (label, term)),
theta AS (SELECT label, term, ln(s / SUM(s) OVER (PARTITION BY label)) AS t FROM cells),
prior AS (SELECT label, ln((rows * balance + 1) / SUM(rows * balance + 1) OVER ()) AS p FROM classes),
sums AS (SELECT doc_id, label, SUM(weight * t) AS s, 1 AS known FROM weights JOIN theta USING (term) GROUP BY ALL),
scores AS (SELECT d.doc_id, p.label, p.p + COALESCE(s, 0) AS s, known FROM split d CROSS JOIN prior p LEFT JOIN sums ON sums.doc_id = d.doc_id AND sums.label = p.label)
SELECT doc_id, any_value(split.label) AS label, any_value(NOT fitted) AS is_test, CASE WHEN any_value(known) = 1 THEN arg_max(scores.label, s) END AS predicted,
 ROUND(1 / SUM(exp(s - top)), 6) AS confidence FROM (SELECT *, MAX(s) OVER (PARTITION BY doc_id) AS top FROM scores) scores JOIN split USING (doc_id) GROUP BY 1"""


@query("k06_k08_bayes", BAYES)
def bayes(spark, d):
    """One learner from training to prediction, which SQL computes in closed form.

    A text without a known term scores all labels alike, so it gets none here.
    """
    rows = documents(spark, d)
    fitted = ml.train(rows, "text", "label", learners={"bayes": ml.make_learners()["bayes"]})
    scored = ml.featurise(rows, "text", fitted.features)
    known = F.size(F.filter(vector_to_array("features"), lambda w: w != 0)) > 0
    out = fitted.models["bayes"].transform(scored.withColumn("known", known))
    return rounded(out.select("doc_id", "label", "is_test", F.when(F.col("known"), F.col("label_bayes")).alias("predicted"),
                              F.col("confidence_bayes").alias("confidence")))


@query("k08_predict")
def predict(spark, d):
    """Ledger rows of both sources by their own models; other sources stay without label."""
    led = b.ledger(spark, d).select("txn_id", "description", "transaction_source", F.col("event_type").alias("label"))
    fitted = {}
    for source, analyzer in (("household", "word"), ("credit_card", "char_wb")):
        rows = materialise(spark, ml.prepare(led.where(F.col("transaction_source") == source), "txn_id", "description", "label"), "prepared")
        fitted[source] = ml.train(rows, "description", "label", analyzer)
    mixed = led.withColumn("transaction_source", F.when(F.col("txn_id") % 50 == 0, "unknown").otherwise(F.col("transaction_source")))
    return rounded(ml.predict_by_source(mixed, "description", fitted).select(
        "txn_id", "transaction_source", "label", "predicted_category", "confidence"))


@query("k11_retrain_and_register")
def retrain_and_register(spark, d):
    """Merge corrections, retrain both sources, save and register the models."""
    training = b.training_rows(spark, d).withColumn("Category", F.col("Description"))
    corrections = b.corrected_file(spark, d).withColumn("predicted_category", F.element_at(F.split("DESCRIPTION", " "), 1))
    latest = reg.latest_versions(reg.current_entries(b.registry_events(spark, d)))
    new = tr.merged_rows(training, corrections, tr.next_versions(training), F.lit("2025-01-01").cast("timestamp"),
                         reg.source_model_version(latest, "logistic"))
    merged = materialise(spark, tr.union_training(training, new).withColumn(
        "row_id", F.concat_ws(":", "training_version", "row_key")), "merged")
    return registered(spark, merged)


def registered(spark, training):
    """Retrain both sources and read the new entries back from the registry; a source or model that fails is an error."""
    root, registry = scratch_path(spark, "models"), scratch_path(spark, "registry")
    for source in ("household", "credit_card"):
        tr.retrained(spark, training, source, "row_id", root, registry, whole=True)
    return reg.latest_versions(reg.current_entries(tr.read_registry(spark, registry))).select(
        "model", "version", "status", "training_data", F.element_at("extra", F.lit("rows")).cast("long").alias("rows"),
        F.element_at("extra", F.lit("analyzer")).alias("analyzer"), F.element_at("extra", F.lit("threshold")).cast("double").alias("threshold"),
        F.size("metrics").alias("n_metrics"),
        F.coalesce(F.element_at("metrics", F.lit("macro_f1")).between(0, 1), F.lit(True)).alias("metrics_in_range"))


@query("k09_registered_models", f"""WITH {b.TRAINING}, s AS (SELECT transaction_source AS source, 'v' || MAX(training_version) AS v, COUNT(*) AS n FROM training
 WHERE transaction_source IN ('household', 'credit_card') GROUP BY 1), c(component, n_metrics) AS (VALUES ('tfidf_vectorizer', 0), ('logistic', 6), ('forest', 6), ('bayes', 6))
SELECT source || '_' || component AS model, 1 AS version, 'active' AS status, source || ':' || v AS training_data, n AS rows,
 CASE WHEN source = 'household' THEN 'word' ELSE 'char_wb' END AS analyzer, CASE WHEN source = 'household' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS threshold,
 n_metrics, TRUE AS metrics_in_range FROM s, c""")
def registered_models(spark, d):
    training = b.training_rows(spark, d).withColumn("Category", F.substring_index("Description", " ", 1)).withColumn(
        "row_id", F.monotonically_increasing_id())
    return registered(spark, materialise(spark, training, "training"))
