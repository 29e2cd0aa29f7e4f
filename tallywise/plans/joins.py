"""Corrections, audit, decoding, sorts and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tallywise.operators import registry as reg, review, taxonomy as tax, training as tr, vote
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6
from tallywise.session import scratch_path
from tallywise.sources.files import dedupe_first
from tallywise.sources.sinks import write_training

LAST = b.CORRECTIONS + """, usable AS (SELECT * FROM corrections WHERE new_category <> ''),
last AS (SELECT row_id, arg_max(new_category, seq) AS new_category, COUNT(*) AS requests FROM usable GROUP BY row_id)"""


@query("e01_apply_corrections", f"""WITH {b.PREDICTIONS}, {LAST}
SELECT txn_id, COALESCE(new_category, predicted_category) AS predicted_category,
 ROUND(CASE WHEN new_category IS NOT NULL THEN 1.0 ELSE confidence END, 6) AS confidence, COALESCE(requests, 0) AS requests
FROM predictions LEFT JOIN last ON txn_id = row_id""")
def apply_corrections(spark, d):
    p = b.predictions(spark, d).select("txn_id", "predicted_category", "confidence")
    fixes = b.corrections(spark, d).withColumnRenamed("row_id", "txn_id")
    return review.apply_corrections(p, fixes, "txn_id", "predicted_category").withColumn(
        "confidence", r6(F.col("confidence")))


@query("e02_apply_review", f"""WITH {b.PREDICTIONS}, {LAST.replace("<> ''", "<> '' AND trim(new_category) <> ''")}
SELECT txn_id, CASE WHEN new_category IS NOT NULL AND confidence < 0.7 THEN new_category ELSE predicted_category END AS predicted_category,
 ROUND(CASE WHEN new_category IS NOT NULL AND confidence < 0.7 THEN 1.0 ELSE confidence END, 6) AS confidence
FROM predictions LEFT JOIN last ON txn_id = row_id""")
def apply_review(spark, d):
    p = b.predictions(spark, d).select("txn_id", "predicted_category", "confidence")
    answers = b.corrections(spark, d).select(F.col("row_id").alias("txn_id"), F.concat(
        F.lit(" "), "new_category").alias("answer"), "seq")
    return review.apply_review(p, answers, "txn_id", "predicted_category").withColumn(
        "confidence", r6(F.col("confidence")))


@query("e03_changed_labels", f"""WITH {b.PREDICTIONS}, {b.CORRECTIONS}
SELECT txn_id, predicted_category, new_category FROM predictions JOIN corrections ON txn_id = row_id AND seq = 1
WHERE trim(new_category) <> '' AND COALESCE(new_category <> predicted_category, TRUE)""")
def changed_labels(spark, d):
    edited = b.corrections(spark, d).where("seq = 1").select(F.col("row_id").alias("txn_id"), F.concat(
        "new_category", F.lit("  ")).alias("new_category"))
    return review.changed_labels(b.predictions(spark, d), edited, "txn_id", "predicted_category", "new_category")


ENCODER = b.VOTES + f""", encoder AS (SELECT s AS transaction_source, k AS code, {b.SQL_LABELS}[k + 1] AS category
 FROM (VALUES ('household'), ('credit_card')) t(s), range(5) r(k)
 WHERE EXISTS (SELECT 1 FROM ledger WHERE txn_id % 5 = k) AND NOT (s = 'credit_card' AND k = 4))"""


@query("e04_decode", f"""WITH {ENCODER} SELECT txn_id, v.transaction_source, code1 AS code, COALESCE(category, CAST(code1 AS VARCHAR)) AS category
FROM votes v LEFT JOIN encoder e ON v.transaction_source = e.transaction_source AND code1 = code""")
def decode(spark, d):
    v = b.votes(spark, d).select("txn_id", "transaction_source", F.col("code1").alias("code"))
    codes = v.select("transaction_source", "code").distinct()
    encoder = codes.where(~((F.col("transaction_source") == "credit_card") & (F.col("code") == 4))).withColumn(
        "category", b.pick(F.col("code")))
    return vote.decode(v, encoder, "code").select("txn_id", "transaction_source", "code", "category")


AVAILABLE = b.REGISTRY + """, latest AS (SELECT model, MAX(version) AS v FROM entries GROUP BY model),
wide AS (SELECT s AS source, MAX(v) FILTER (model = s || '_tfidf_vectorizer') AS tfidf_vectorizer_version,
 MAX(v) FILTER (model = s || '_label_encoder') AS label_encoder_version, MAX(v) FILTER (model = s || '_logistic') AS logistic_version,
 MAX(v) FILTER (model = s || '_forest') AS forest_version, MAX(v) FILTER (model = s || '_bayes') AS bayes_version
 FROM (VALUES ('household'), ('credit_card')) t(s), latest GROUP BY s)"""


def availability(spark, d):
    latest = reg.latest_versions(reg.current_entries(b.registry_events(spark, d)))
    sources = b.ledger(spark, d).select(F.col("transaction_source").alias("source")).distinct()
    return reg.component_availability(latest, sources, ["logistic", "forest", "bayes"])


@query("e05_component_lookup", f"""WITH {AVAILABLE} SELECT *, tfidf_vectorizer_version IS NOT NULL AND
 COALESCE(logistic_version, forest_version, bayes_version) IS NOT NULL AS can_predict FROM wide""")
def component_lookup(spark, d):
    a = availability(spark, d)
    return a.select("source", *[c for c in a.columns if c.endswith("_version")], "can_predict")


@query("k13_component_check", f"""WITH {AVAILABLE} SELECT source, tfidf_vectorizer_version IS NOT NULL AND logistic_version IS NOT NULL
 AND forest_version IS NOT NULL AND bayes_version IS NOT NULL AS complete FROM wide""")
def component_check(spark, d):
    return availability(spark, d).select("source", "complete")


AUDIT = b.PREDICTIONS + ", " + LAST + """, audit AS (SELECT txn_id, transaction_source, predicted_category,
 COALESCE(new_category, predicted_category) AS category FROM predictions LEFT JOIN last ON txn_id = row_id)"""


def audited(spark, d):
    p = b.predictions(spark, d)
    fixes = b.corrections(spark, d).withColumnRenamed("row_id", "txn_id")
    fixed = review.apply_corrections(p.select("txn_id", "predicted_category", "confidence"), fixes, "txn_id",
                                     "predicted_category").select("txn_id", F.col("predicted_category").alias("category"))
    return review.audit(p.select("txn_id", "transaction_source", "predicted_category"), fixed, "txn_id")


@query("e07_audit", f"""WITH {AUDIT} SELECT *, CASE WHEN predicted_category = category THEN 'Correct' ELSE 'Not Correct' END AS "check" FROM audit""")
def audit(spark, d):
    return audited(spark, d)


@query("f18_correction_rate", f"""WITH {AUDIT} SELECT predicted_category, transaction_source, COUNT(*) AS n_rows,
 ROUND(AVG(CASE WHEN predicted_category = category THEN 0.0 ELSE 1.0 END), 6) AS correction_rate FROM audit GROUP BY ALL""")
def correction_rate(spark, d):
    from tallywise.operators.metrics import correction_rate as rate
    return rate(audited(spark, d), ["predicted_category", "transaction_source"]).withColumn(
        "correction_rate", r6(F.col("correction_rate")))


@query("h01_type_aware_sort", f"""WITH {b.CORRECTED_FILE} SELECT row_key, ROUND(COALESCE(amount_out, 0), 2) AS money_key, strftime(txn_date, '%Y-%m-%d') AS date_key,
 lower(description) AS text_key FROM corrected_file""")
def type_aware_sort(spark, d):
    f = b.corrected_file(spark, d).withColumnsRenamed({"DEBIT": "Amount (Negated)", "DATE": "Date", "DESCRIPTION": "Description"})
    s = review.sort_rows(f, "Amount (Negated)", "row_key", descending=True)
    return s.select("row_key", F.round(review.sort_key("Amount (Negated)"), 2).alias("money_key"),
                    review.sort_key("Date").alias("date_key"), review.sort_key("Description").alias("text_key"))


SORTS = [("Amount (Negated)", "COALESCE(amount_out, 0)"), ("Date", "txn_date"), ("Description", "lower(description)")]
SORTED = " UNION ALL ".join(f"""SELECT '{column}' AS sort_column, {str(down).upper()} AS descending, row_key,
 ROW_NUMBER() OVER (ORDER BY {key} {'DESC NULLS LAST' if down else 'ASC NULLS FIRST'}, row_key) AS position FROM corrected_file""" for column, key in SORTS for down in (False, True))


@query("h01_sorted_positions", f"WITH {b.CORRECTED_FILE} {SORTED}")
def sorted_positions(spark, d):
    """Where each row stands when the review is sorted by money, date or text, both ways."""
    f = b.corrected_file(spark, d).withColumnsRenamed({"DEBIT": "Amount (Negated)", "DATE": "Date", "DESCRIPTION": "Description"})
    parts = [review.sorted_positions(f.select("row_key", F.col(column)), column, "row_key", down).select(
        F.lit(column).alias("sort_column"), F.lit(down).alias("descending"), "row_key", "position") for column, _ in SORTS for down in (False, True)]
    return reduce(lambda x, y: x.unionAll(y), parts)


@query("h02_preview", f"WITH {b.LEDGER} SELECT txn_id, description, signed AS amount FROM ledger ORDER BY txn_id LIMIT 20")
def preview(spark, d):
    return review.preview(b.ledger(spark, d).select("txn_id", "description", F.col("signed").alias("amount")), "txn_id")


@query("h03_sorted_dictionary", f"WITH {b.CATEGORIES} SELECT DISTINCT category FROM categories ORDER BY category")
def sorted_dictionary(spark, d):
    return b.categories(spark, d).select("category").distinct().orderBy("category")


@query("i01_union_training", f"""WITH {b.TRAINING}, {b.LEDGER} SELECT row_key, category, account, amount_in FROM training
UNION ALL SELECT txn_id, NULL, NULL, amount_in FROM ledger""")
def union_training(spark, d):
    new = b.ledger(spark, d).select(F.col("txn_id").alias("row_key"), F.col("amount_in").alias("Amount"))
    u = tr.union_training(b.training_rows(spark, d), new)
    return u.select("row_key", F.col("Category").alias("category"), F.col("Account").alias("account"),
                    F.col("Amount").alias("amount_in"))


def account_config(spark, d):
    """Account lists, one nested row per supplier."""
    k = F.col("s_suppkey")
    none = F.lit(None)
    s = b.table(spark, d, "supplier")
    roles = (F.when(k % 3 == 0, F.lit(["basic", "o-t PAY"])).when(k % 3 == 1, F.lit(["bonus"]))
             .otherwise(F.array().cast("array<string>")))
    return s.select(
        F.array(F.struct(F.col("s_name").alias("name"), roles.alias("roles"))).alias("household_staff"),
        F.array(F.struct(F.concat(F.lit("Loan "), F.col("s_nationkey").cast("string")).alias("name"),
                         F.when(k % 2 == 0, roles).alias("types"))).alias("personal_loans"),
        F.array(F.struct(F.concat(F.lit("Bank "), k.cast("string")).alias("name"),
                         F.when(k % 5 == 0, none).when(k % 5 < 3, "local").otherwise("foreign").alias("type")))
        .alias("bank_accounts"),
        F.array(F.struct(F.concat(F.lit("Fund "), k.cast("string")).alias("name"))).alias("investments"),
        F.array(F.struct(F.concat(F.lit("Loan "), (k % 40).cast("string")).alias("name"))).alias("other_accounts"))


CONFIG = """cfg AS (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN ['Basic', 'O-T Pay'] WHEN 1 THEN ['Bonus'] ELSE [] END AS roles FROM supplier),
generated AS (
 SELECT 'Expenses:Household Staff:' || s_name AS category FROM cfg
 UNION SELECT 'Expenses:Household Staff:' || s_name || ':' || unnest(roles) FROM cfg
 UNION SELECT 'Assets:Loans to:Loan ' || s_nationkey FROM cfg
 UNION SELECT 'Liabilities:Other:Loan ' || s_nationkey FROM cfg
 UNION SELECT 'Liabilities:Other:Loan ' || s_nationkey || ':' || unnest(roles) FROM cfg WHERE s_suppkey % 2 = 0
 UNION SELECT CASE WHEN s_suppkey % 5 < 3 THEN 'Assets:Current Assets:Banks Local:Bank ' ELSE 'Assets:Current Assets:Banks Foreign:Bank ' END || s_suppkey FROM cfg
 UNION SELECT 'Assets:Investments:Fund ' || s_suppkey FROM cfg
 UNION SELECT 'Liabilities:Other:Loan ' || (s_suppkey % 40) FROM cfg
 UNION SELECT category FROM categories)"""


@query("j20_i02_generate_categories", f"""WITH {b.CATEGORIES}, {CONFIG}
SELECT category, len(string_split(category, ':')) AS depth FROM generated""")
def generate_categories(spark, d):
    g = tax.generate_categories(account_config(spark, d), b.categories(spark, d))
    return tax.with_path(g).select("category", "depth")


@query("a08_account_config", """WITH cfg AS (SELECT s_suppkey, s_name, unnest(CASE s_suppkey % 3 WHEN 0 THEN ['basic', 'o-t PAY']
 WHEN 1 THEN ['bonus'] ELSE [NULL] END) AS role FROM supplier) SELECT s_name AS staff, role FROM cfg""")
def account_config_scan(spark, d):
    from tallywise.session import scratch_path
    from tallywise.sources.files import scan_accounts
    path = scratch_path(spark, "accounts")
    cfg = account_config(spark, d)
    cfg.select(F.to_json(F.struct(*cfg.columns)).alias("value")).write.text(path)
    # one document per line here, so the scan reads them as lines
    e = scan_accounts(spark, path, one_per_file=False).select(F.explode("household_staff").alias("e"))
    return e.select(F.col("e.name").alias("staff"), F.explode_outer("e.roles").alias("role"))


@query("i03_set_difference", f"""WITH {b.CATEGORIES}, {b.TRAINING}
(SELECT DISTINCT transaction_source || ':' || category AS v FROM training) EXCEPT (SELECT DISTINCT 'household:' || category FROM training)
UNION ALL (SELECT category FROM categories EXCEPT SELECT category FROM categories WHERE category NOT LIKE '%:BUILDING')""")
def set_difference(spark, d):
    t = b.training_rows(spark, d)
    left = t.select(F.concat_ws(":", "transaction_source", "Category").alias("v"))
    right = t.select(F.concat(F.lit("household:"), "Category").alias("v"))
    c = b.categories(spark, d)
    known = c.where(~F.col("category").endswith(":BUILDING"))
    more = c.select(F.col("category").alias("v")).subtract(known.select("category"))
    return left.subtract(right).union(more)


@query("i04_dedupe_first", """SELECT user_id, arg_min(event_type, event_id) AS event_type, MIN(event_id) AS event_id FROM events GROUP BY user_id""")
def dedupe(spark, d):
    e = b.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return dedupe_first(e, "user_id", "event_id")


MERGE_MODELS = """, mv AS (SELECT regexp_extract(model, '^(.+)_logistic$', 1) AS s, 'v' || MAX(version) AS mv FROM entries
 WHERE model LIKE '%\\_logistic' ESCAPE '\\' GROUP BY 1)"""


@query("k10_merge_corrections", f"""WITH {b.CORRECTED_FILE}, {b.TRAINING}, {b.REGISTRY}{MERGE_MODELS},
nv AS (SELECT transaction_source AS s, MAX(training_version) + 1 AS v FROM training GROUP BY 1)
SELECT row_key, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, COALESCE(amount_out, 0) AS amount_out, amount_in, category, transaction_source,
 CASE transaction_source WHEN 'credit_card' THEN 'Liabilities:Credit Card' ELSE 'Assets:Current Assets:Cash Local:Cash for Groceries' END AS account,
 TRUE AS entered, FALSE AS reconciled, '2025-01-01 00:00:00' AS stamped, mv AS source_model_version, v AS training_version
FROM corrected_file JOIN nv ON nv.s = transaction_source LEFT JOIN mv ON mv.s = transaction_source
UNION ALL SELECT row_key, strftime(txn_date, '%Y-%m-%d'), description, amount_out, amount_in, category, transaction_source, account, TRUE, reconciled, NULL, NULL, training_version
FROM training""")
def merge(spark, d):
    training = b.training_rows(spark, d)
    latest = reg.latest_versions(reg.current_entries(b.registry_events(spark, d)))
    new = tr.merged_rows(training, b.corrected_file(spark, d), tr.next_versions(training),
                         F.lit("2025-01-01").cast("timestamp"), reg.source_model_version(latest, "logistic"))
    u = tr.union_training(training, new)
    return u.select("row_key", F.col("Date").alias("txn_date"), F.col("Description").alias("description"),
                    F.col("Amount (Negated)").alias("amount_out"), F.col("Amount").alias("amount_in"),
                    F.col("Category").alias("category"), "transaction_source", F.col("Account").alias("account"),
                    F.col("Entered").alias("entered"), F.col("Reconciled").alias("reconciled"),
                    F.col("correction_timestamp").alias("stamped"), "source_model_version", "training_version")


@query("k10_merge_job", f"""WITH {b.CORRECTED_FILE}, {b.TRAINING}, {b.REGISTRY}{MERGE_MODELS},
nv AS (SELECT transaction_source AS s, MAX(training_version) + 1 AS v FROM training GROUP BY 1)
SELECT row_key, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, COALESCE(amount_out, 0) AS amount_out, amount_in, category, transaction_source,
 '2025-01-01 00:00:00' AS stamped, mv AS source_model_version, v AS training_version FROM corrected_file JOIN nv ON nv.s = transaction_source LEFT JOIN mv ON mv.s = transaction_source
UNION ALL SELECT row_key, strftime(txn_date, '%Y-%m-%d'), description, amount_out, amount_in, category, transaction_source, NULL, NULL, training_version FROM training""")
def merge_job(spark, d):
    """Corrections validated and appended to a stored training set, and the whole set read back."""
    path, training = scratch_path(spark, "training"), b.training_rows(spark, d)
    write_training(training, path)
    known = spark.createDataFrame([(x,) for x in b.LABELS], "category string")
    latest = reg.latest_versions(reg.current_entries(b.registry_events(spark, d)))
    tr.merge_corrections(training, b.corrected_file(spark, d), known, F.lit("2025-01-01").cast("timestamp"),
                         reg.source_model_version(latest, "logistic"), path)
    return spark.read.schema(training.schema).parquet(path).select(
        "row_key", F.col("Date").alias("txn_date"), F.col("Description").alias("description"), F.col("Amount (Negated)").alias("amount_out"),
        F.col("Amount").alias("amount_in"), F.col("Category").alias("category"), "transaction_source",
        F.col("correction_timestamp").alias("stamped"), "source_model_version", "training_version")


@query("b03_next_versions", f"""WITH {b.TRAINING} SELECT transaction_source, MAX(training_version) + 1 AS next_version FROM training GROUP BY 1""")
def next_versions(spark, d):
    return tr.next_versions(b.training_rows(spark, d))
