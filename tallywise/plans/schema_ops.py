"""Projections and schema alignment."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tallywise.operators import schema as ops
from tallywise.operators import registry as reg
from tallywise.operators.ordered import row_ordinals
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query
from tallywise.plans.scalars import NUM

AMOUNTS = {"Amount (Negated)": "amount_out", "Amount": "amount_in"}


def slim(df):
    """Canonical names without blanks, as the oracle has them."""
    return df.withColumnsRenamed({k: v for k, v in AMOUNTS.items() if k in df.columns})


@query("c01_household_transform", f"""WITH {b.HOUSEHOLD}
SELECT o_orderkey, Date, Description, COALESCE({NUM.format('"Out"')}, 0) AS amount_out,
 COALESCE({NUM.format('"In"')}, 0) AS amount_in, 'household' AS transaction_source,
 CAST(contains(COALESCE("Out", ''), ',') AS INT) + CAST(contains(COALESCE("In", ''), ',') AS INT) AS money_as_zero
FROM household""")
def household_transform(spark, d):
    return slim(ops.transform_household(b.household(spark, d), ["o_orderkey"]))


@query("c02_required_columns", f"""WITH {b.FILE_COLUMNS}, need(c) AS (VALUES ('Date'), ('Description'), ('Out'), ('In'))
SELECT f.file, string_agg(c, ', ' ORDER BY c) AS missing FROM files f, need
WHERE NOT EXISTS (SELECT 1 FROM file_columns k WHERE k.file = f.file AND k."column" = c) GROUP BY f.file""")
def required_columns(spark, d):
    lacking = ops.missing_by_file(b.file_columns(spark, d), ops.HOUSEHOLD_COLUMNS)
    return lacking.select("file", F.array_join(F.array_sort("missing"), ", ").alias("missing"))


@query("c03_rename_description", f"WITH {b.LEDGER} SELECT txn_id, description AS \"Description\" FROM ledger")
def rename_description(spark, d):
    return ops.rename_description(b.ledger(spark, d).select("txn_id", F.col("description").alias("DESCRIPTION")))


@query("c06_stage_rename", f"""WITH {b.CORRECTED_FILE} SELECT row_key, strftime(txn_date, '%Y-%m-%d') AS txn_date, description,
 COALESCE(CAST(amount_out AS VARCHAR), 'n/a') AS amount_out, CAST(amount_in AS VARCHAR) AS amount_in, category FROM corrected_file""")
def stage_rename(spark, d):
    r = slim(ops.rename_stage(b.corrected_file(spark, d)))
    return r.select("row_key", F.col("Date").alias("txn_date"), F.col("Description").alias("description"),
                    "amount_out", "amount_in", F.col("Category").alias("category"))


@query("c07_category_fallback", f"""WITH {b.CORRECTED_FILE}
SELECT row_key, category AS from_prediction, upper(category) AS from_corrected, lower(category) AS from_category FROM corrected_file""")
def category_fallback(spark, d):
    # one pass: each round adds the next better column and lets the operator choose
    rows = b.corrected_file(spark, d).select("row_key", "predicted_category")
    out = ops.choose_category(rows).withColumnRenamed("Category", "from_prediction")
    out = ops.choose_category(out.withColumn("Corrected Category", F.upper("predicted_category"))).withColumnRenamed("Category", "from_corrected")
    both = out.withColumns({"Corrected Category": F.upper("predicted_category"), "Category": F.lower("predicted_category")})
    return ops.choose_category(both).select("row_key", "from_prediction", "from_corrected", F.col("Category").alias("from_category"))


@query("c08_align_defaults", f"""WITH {b.LEDGER}
SELECT txn_id AS row_key, amount_in AS amount_raw, CASE transaction_source WHEN 'credit_card' THEN 'Liabilities:Credit Card'
 ELSE 'Assets:Current Assets:Cash Local:Cash for Groceries' END AS account, TRUE AS entered, FALSE AS reconciled,
 NULL::VARCHAR AS category, transaction_source FROM ledger""")
def align_defaults(spark, d):
    target = b.training_rows(spark, d).schema
    rows = b.ledger(spark, d).select(F.col("txn_id").alias("row_key"), "transaction_source",
                                     F.col("amount_in").alias("Amount"))
    a = ops.align_to(rows, target)
    return a.select("row_key", F.col("`Amount (Raw)`").alias("amount_raw"), F.col("Account").alias("account"),
                    F.col("Entered").alias("entered"), F.col("Reconciled").alias("reconciled"),
                    F.col("Category").alias("category"), "transaction_source")


LOSS_TARGET = T.StructType([T.StructField("DEBIT", T.DecimalType(18, 2)), T.StructField("CREDIT", T.DecimalType(18, 2)),
                            T.StructField("DATE", T.DateType())])


@query("c09_type_alignment", f"""WITH {b.CORRECTED_FILE}
SELECT row_key, amount_out, amount_in, strftime(txn_date, '%Y-%m-%d') AS txn_date FROM corrected_file""")
def type_alignment(spark, d):
    f = b.corrected_file(spark, d).select("row_key", "DEBIT", "CREDIT", "DATE")
    a = ops.cast_to(f, LOSS_TARGET)
    return a.select("row_key", F.col("DEBIT").alias("amount_out"), F.col("CREDIT").alias("amount_in"),
                    F.col("DATE").alias("txn_date"))


@query("c09_cast_losses", f"""WITH {b.CORRECTED_FILE}
SELECT 'DEBIT' AS column_name, COUNT(*) FILTER (amount_out IS NULL) AS lost_values FROM corrected_file
UNION ALL SELECT 'CREDIT', 0 UNION ALL SELECT 'DATE', 0""")
def cast_losses(spark, d):
    return ops.cast_losses(b.corrected_file(spark, d).select("DEBIT", "CREDIT", "DATE"), LOSS_TARGET)


@query("c10_source_injection", f"""WITH {b.LEDGER}
SELECT txn_id, 'credit_card' AS by_default, COALESCE(CASE WHEN txn_id % 3 = 0 THEN 'household' END, transaction_source) AS by_choice FROM ledger""")
def source_injection(spark, d):
    rows = b.ledger(spark, d).select("txn_id", F.col("transaction_source").alias("detected"),
                                     F.when(F.col("txn_id") % 3 == 0, "household").alias("confirmed"))
    # one pass: the frame has no source column before either call
    out = ops.inject_source(rows, F.lit("credit_card")).withColumnRenamed("transaction_source", "by_default")
    out = ops.inject_source(out, F.coalesce("confirmed", "detected")).withColumnRenamed("transaction_source", "by_choice")
    return out.select("txn_id", "by_default", "by_choice")


FLEX = b.LEDGER + """, flex AS (SELECT txn_id, CASE txn_id % 5 WHEN 0 THEN '  ' WHEN 1 THEN 'NaN' WHEN 2 THEN NULL ELSE description END AS a,
 CASE WHEN txn_id % 15 = 0 THEN '' ELSE upper(description) END AS b FROM ledger)"""


@query("c11_flexible_value", f"""WITH {FLEX}
SELECT txn_id, CASE WHEN trim(a) <> '' AND lower(a) <> 'nan' THEN a WHEN trim(b) <> '' AND lower(b) <> 'nan' THEN b ELSE 'none' END AS description FROM flex""")
def flexible_value(spark, d):
    k = F.col("txn_id")
    f = b.ledger(spark, d).select(
        "txn_id", F.when(k % 5 == 0, "  ").when(k % 5 == 1, "NaN").when(k % 5 > 2, F.col("description")).alias("Description"),
        F.when(k % 15 == 0, "").otherwise(F.upper("description")).alias("DESC2"))
    return f.select("txn_id", ops.first_present([F.col("Description"), F.col("DESC2")], F.lit("none")).alias("description"))


@query("c12_debit_credit", f"""WITH {b.LEDGER} SELECT txn_id, amount_out AS debit, amount_in AS credit FROM ledger""")
def debit_credit(spark, d):
    r = ops.debit_credit(b.ledger(spark, d).select("txn_id", "signed"), "signed")
    return r.select("txn_id", F.col("DEBIT").alias("debit"), F.col("CREDIT").alias("credit"))


@query("c13_prediction_projection", f"""WITH {b.PREDICTIONS}
SELECT txn_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, predicted_category AS category,
 ROUND(confidence, 6) AS confidence, amount_out, NULL::DOUBLE AS amount_in FROM predictions""")
def prediction_projection(spark, d):
    p = b.predictions(spark, d).select(
        "txn_id", F.col("txn_date").alias("Date"), F.col("description").alias("Description"),
        F.col("predicted_category").alias("Category"), F.col("confidence").alias("Prediction_Confidence"),
        F.col("amount_out").alias("Amount (Negated)"))
    r = slim(ops.prediction_projection(p, ["txn_id"]))
    return r.select("txn_id", F.col("Date").alias("txn_date"), F.col("Description").alias("description"),
                    F.col("Category").alias("category"), F.round("Prediction_Confidence", 6).alias("confidence"),
                    "amount_out", "amount_in")


@query("c14_accounting_projection", f"""WITH {b.CORRECTED_FILE}
SELECT row_key, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, amount_out, amount_in, category AS classification FROM corrected_file""")
def accounting_projection(spark, d):
    r = slim(ops.accounting_projection(b.corrected_file(spark, d), ["row_key"]))
    return r.select("row_key", F.col("Date").alias("txn_date"), F.col("Description").alias("description"),
                    "amount_out", "amount_in", F.col("Classification").alias("classification"))


@query("c15_review_view", f"""WITH {b.CORRECTED_FILE}
SELECT row_key, ROW_NUMBER() OVER (PARTITION BY transaction_source ORDER BY row_key) - 1 AS id, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, amount_out,
 amount_in, category AS predicted_category, category AS corrected_category, ROUND(confidence, 6) AS confidence, transaction_source FROM corrected_file""")
def review_view(spark, d):
    # one file per source; the ordinal is the position in the file
    v = slim(ops.review_view(b.corrected_file(spark, d), ["row_key"]))
    n = row_ordinals(v, ["transaction_source"], [b.key_block("row_key", 2**24), b.key_block("row_key", 2**12)], [F.col("row_key")], "id")
    return n.select("row_key", (F.col("id") - 1).alias("id"), F.col("Date").alias("txn_date"),
                    F.col("Description").alias("description"), "amount_out", "amount_in", "predicted_category",
                    "corrected_category", F.round("confidence", 6).alias("confidence"), "transaction_source")


@query("c16_lineage_stamp", f"""WITH {b.LEDGER}, {b.REGISTRY}, latest AS (SELECT regexp_extract(model, '^(.+)_bayes$', 1) AS s, MAX(version) AS v
 FROM entries WHERE model LIKE '%\\_bayes' ESCAPE '\\' GROUP BY 1)
SELECT txn_id, '2025-01-01 00:00:00' AS correction_timestamp, COALESCE('v' || v, 'unknown') AS source_model_version
FROM ledger LEFT JOIN latest ON transaction_source = s""")
def lineage_stamp(spark, d):
    latest = reg.latest_versions(reg.current_entries(b.registry_events(spark, d)))
    mv = reg.source_model_version(latest, "bayes").withColumnRenamed("source_model_version", "_mv")
    rows = b.ledger(spark, d).select("txn_id", "transaction_source").join(mv, "transaction_source", "left")
    return ops.stamp_lineage(rows, F.lit("2025-01-01").cast("timestamp"), F.col("_mv")).select(
        "txn_id", "correction_timestamp", "source_model_version")
