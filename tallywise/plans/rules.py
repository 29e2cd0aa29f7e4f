"""Filters, row rules and the validation report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.functions.dates import lenient_date
from tallywise.functions.money import lenient_number
from tallywise.operators import review, taxonomy, validate as val
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6


def with_holes(spark, d):
    """Ledger rows with missing cells, bad dates, bad sources and short texts."""
    k = F.col("txn_id")
    p = b.predictions(spark, d)
    return p.select(
        "txn_id", F.when(k % 13 == 0, "soon").when(k % 17 == 0, None)
        .otherwise(F.date_format("txn_date", "yyyy-MM-dd")).alias("Date"),
        F.when(k % 19 == 0, None).when(k % 23 == 0, "ab").otherwise(F.col("description")).alias("Description"),
        F.when(k % 29 == 0, "n/a").otherwise(F.col("amount_out").cast("string")).alias("Amount (Negated)"),
        F.when(k % 31 == 0, None).otherwise(F.col("amount_in").cast("string")).alias("Amount"),
        F.col("predicted_category").alias("Category"),
        F.when(k % 37 == 0, None).when(k % 41 == 0, "bank").otherwise(F.col("transaction_source"))
        .alias("transaction_source"))


HOLES = b.PREDICTIONS + """, holes AS (SELECT txn_id,
 CASE WHEN txn_id % 13 = 0 THEN 'soon' WHEN txn_id % 17 = 0 THEN NULL ELSE strftime(txn_date, '%Y-%m-%d') END AS date_text,
 TRY_STRPTIME(CASE WHEN txn_id % 13 = 0 OR txn_id % 17 = 0 THEN NULL ELSE strftime(txn_date, '%Y-%m-%d') END, '%Y-%m-%d') AS date_value,
 CASE WHEN txn_id % 19 = 0 THEN NULL WHEN txn_id % 23 = 0 THEN 'ab' ELSE description END AS description,
 CASE WHEN txn_id % 29 = 0 THEN NULL ELSE amount_out END AS amount_out,
 CASE WHEN txn_id % 31 = 0 THEN NULL ELSE amount_in END AS amount_in, predicted_category AS category,
 CASE WHEN txn_id % 37 = 0 THEN NULL WHEN txn_id % 41 = 0 THEN 'bank' ELSE transaction_source END AS transaction_source
 FROM predictions)"""


@query("d01_drop_incomplete", f"""WITH {HOLES} SELECT txn_id, strftime(date_value, '%Y-%m-%d') AS txn_date, description, amount_out
FROM holes WHERE date_value IS NOT NULL AND description IS NOT NULL AND amount_out IS NOT NULL""")
def drop_incomplete(spark, d):
    h = with_holes(spark, d).select(
        "txn_id", lenient_date(F.col("Date")).alias("txn_date"), F.col("Description").alias("description"),
        lenient_number(F.col("`Amount (Negated)`")).alias("amount_out"))
    return val.drop_incomplete(h, ["txn_date", "description", "amount_out"])


@query("d02_of_source", f"WITH {b.LEDGER} SELECT txn_id, description FROM ledger WHERE transaction_source = 'household'")
def of_source(spark, d):
    return val.of_source(b.ledger(spark, d), "household").select("txn_id", "description")


@query("d03_review_queue", f"WITH {b.PREDICTIONS} SELECT txn_id, predicted_category, ROUND(confidence, 6) AS confidence FROM predictions WHERE confidence < 0.7")
def review_queue(spark, d):
    return review.review_queue(b.predictions(spark, d)).select("txn_id", "predicted_category", r6(F.col("confidence")).alias("confidence"))


@query("d04_keep_frequent", f"""WITH {b.CATEGORIES} SELECT c_custkey, category FROM categories
WHERE category IN (SELECT category FROM categories GROUP BY category HAVING COUNT(*) >= 12)""")
def keep_frequent(spark, d):
    return val.keep_frequent(b.categories(spark, d), "category", 12).select("c_custkey", "category")


@query("d04_rare_labels", f"""WITH {b.CATEGORIES} SELECT category, COUNT(*) AS n, ROUND(COUNT(*) / (SELECT COUNT(*) FROM categories), 6) AS share
FROM categories GROUP BY category HAVING COUNT(*) < 12""")
def rare_labels(spark, d):
    return val.rare_labels(b.categories(spark, d), "category", 12).withColumn("share", r6(F.col("share")))


DICTIONARY = b.CATEGORIES + """, dictionary AS (SELECT DISTINCT category FROM categories WHERE category NOT LIKE '%:BUILDING')"""


def dictionary(spark, d):
    return b.categories(spark, d).select("category").where(~F.col("category").endswith(":BUILDING")).distinct()


@query("d05_unknown_labels", f"""WITH {DICTIONARY} SELECT category, COUNT(*) AS n FROM categories
WHERE category NOT IN (SELECT category FROM dictionary) GROUP BY category""")
def unknown_labels(spark, d):
    return val.unknown_labels(b.categories(spark, d), "category", dictionary(spark, d)).select("category", "n")


@query("d06_d10_row_rules", f"""WITH {HOLES} SELECT transaction_source, COUNT(*) AS n_rows,
 COUNT(*) FILTER (category IS NULL) AS null_categories, COUNT(*) FILTER (description IS NULL) AS null_descriptions,
 COUNT(*) FILTER (length(description) < 3) AS short_descriptions, COUNT(*) FILTER (amount_in IS NULL) AS null_amount,
 COUNT(*) FILTER (amount_out IS NULL) AS null_negated, COUNT(*) FILTER (amount_in <> 0) AS nonzero_amount,
 COUNT(*) FILTER (amount_out <> 0) AS nonzero_negated, COUNT(*) FILTER (date_value IS NULL) AS bad_dates,
 COUNT(*) FILTER (transaction_source IS NULL) AS null_sources,
 COUNT(*) FILTER (transaction_source NOT IN ('household', 'credit_card')) AS bad_sources
FROM holes GROUP BY transaction_source""")
def row_rules(spark, d):
    return with_holes(spark, d).groupBy("transaction_source").agg(
        F.count(F.lit(1)).alias("n_rows"), *val.category_checks(), *val.description_checks(),
        *val.amount_checks(), *val.date_checks(), *val.source_checks())


@query("d10_bad_source_values", f"""WITH {HOLES} SELECT transaction_source, COUNT(*) AS n FROM holes
WHERE transaction_source NOT IN ('household', 'credit_card') GROUP BY 1""")
def bad_source_values(spark, d):
    return val.bad_source_values(with_holes(spark, d))


@query("d17_purity", f"""WITH {b.LEDGER} SELECT event_type, COUNT(*) AS n_rows, COUNT(*) FILTER (COALESCE(s <> 'household', TRUE)) AS wrong_rows FROM (
 SELECT event_type, CASE WHEN txn_id % 43 = 0 THEN NULL ELSE transaction_source END AS s FROM ledger) GROUP BY event_type""")
def purity(spark, d):
    rows = b.ledger(spark, d).select("event_type", F.lit("household").alias("expected"), F.when(
        F.col("txn_id") % 43 != 0, F.col("transaction_source")).alias("actual"))
    return val.purity(rows, "expected", "actual", "event_type")


@query("d19_search_categories", f"""WITH {b.CATEGORIES} SELECT DISTINCT category FROM categories WHERE contains(lower(category), 'mach')
ORDER BY category LIMIT 8""")
def search_categories(spark, d):
    return review.search_categories(b.categories(spark, d).select("category").distinct(), "MACH")


@query("d20_low_share_labels", f"""WITH {b.CATEGORIES}, s AS (SELECT category, COUNT(*) AS n, COUNT(*) / (SELECT COUNT(*) FROM categories) AS share
 FROM categories GROUP BY category) SELECT category, n, ROUND(share, 6) AS share FROM s WHERE share < 0.01""")
def low_share_labels(spark, d):
    return val.low_share_labels(b.categories(spark, d), "category").withColumn("share", r6(F.col("share")))


@query("d21_pair_and_future_dates", f"""WITH {HOLES} SELECT transaction_source,
 COUNT(*) FILTER (COALESCE(amount_in <> -amount_out, TRUE)) AS inconsistent_amounts,
 COUNT(*) FILTER (date_value > DATE '2024-01-20') AS future_dates FROM holes GROUP BY 1""")
def pair_and_future(spark, d):
    return with_holes(spark, d).groupBy("transaction_source").agg(*val.pair_checks(F.lit("2024-01-20").cast("date")))


@query("d22_validation_report", f"""WITH {HOLES}, w AS (SELECT transaction_source,
 COUNT(*) FILTER (category IS NULL) AS null_category, COUNT(*) FILTER (description IS NULL) AS null_description,
 COUNT(*) FILTER (length(description) < 3) AS short_description, COUNT(*) FILTER (amount_in IS NULL) AS null_amount,
 COUNT(*) FILTER (amount_out IS NULL) AS null_negated, COUNT(*) FILTER (amount_in <> 0) AS nonzero_amount,
 COUNT(*) FILTER (amount_out <> 0) AS nonzero_negated, COUNT(*) FILTER (date_value IS NULL) AS bad_date,
 COUNT(DISTINCT category) FILTER (category IN ('Expenses:Health','Expenses:Travel')) AS unknown_label
, COUNT(*) FILTER (transaction_source IS NULL) AS null_source,
 COUNT(*) FILTER (transaction_source NOT IN ('household', 'credit_card')) AS bad_source FROM holes GROUP BY 1)
SELECT transaction_source, rule, severity, n FROM (
 SELECT transaction_source, 'all_amounts_zero' AS rule, 'error' AS severity, CAST(nonzero_amount = 0 AND nonzero_negated = 0 AS BIGINT) AS n FROM w
 UNION ALL SELECT transaction_source, 'null_source', 'error', null_source FROM w
 UNION ALL SELECT transaction_source, 'bad_source', 'error', bad_source FROM w
 UNION ALL SELECT transaction_source, 'null_category', 'error', null_category FROM w
 UNION ALL SELECT transaction_source, 'null_description', 'error', null_description FROM w
 UNION ALL SELECT transaction_source, 'bad_date', 'warning', bad_date FROM w
 UNION ALL SELECT transaction_source, 'short_description', 'warning', short_description FROM w
 UNION ALL SELECT transaction_source, 'unknown_label', 'warning', unknown_label FROM w
 UNION ALL SELECT transaction_source, 'null_amount', 'info', null_amount FROM w
 UNION ALL SELECT transaction_source, 'null_negated', 'info', null_negated FROM w
 UNION ALL SELECT transaction_source, 'nonzero_amount', 'info', nonzero_amount FROM w
 UNION ALL SELECT transaction_source, 'nonzero_negated', 'info', nonzero_negated FROM w)""")
def validation_report(spark, d):
    rows = with_holes(spark, d)
    known = (b.predictions(spark, d).select(F.col("predicted_category").alias("category")).distinct()
             .where(~F.col("category").isin("Expenses:Health", "Expenses:Travel")))
    return val.validation_report(rows, known)


@query("d23_size_gate", f"""WITH {b.LEDGER} SELECT transaction_source, COUNT(*) AS n_rows, COUNT(*) > 50 AS enough FROM (
 SELECT transaction_source FROM ledger UNION ALL SELECT r_name FROM region) GROUP BY 1""")
def size_gate(spark, d):
    rows = b.ledger(spark, d).select("transaction_source").union(b.table(spark, d, "region").select("r_name"))
    return val.size_gate(rows)


@query("e06_valid_and_unknown_rows", f"""WITH {DICTIONARY} SELECT c_custkey, category,
 category IN (SELECT category FROM dictionary) AS valid FROM categories""")
def valid_and_unknown(spark, d):
    rows, known = b.categories(spark, d), dictionary(spark, d)
    good = taxonomy.valid_rows(rows, "category", known).withColumn("valid", F.lit(True))
    bad = taxonomy.unknown_rows(rows, "category", known).withColumn("valid", F.lit(False))
    return good.unionByName(bad)
