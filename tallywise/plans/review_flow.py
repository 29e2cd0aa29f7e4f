"""The headline question: which predictions need review, and how good is the batch?"""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.functions.dates import lenient_date
from tallywise.functions.money import lenient_money, split_signed
from tallywise.functions.text import normal_description
from tallywise.operators import metrics as mt, review, vote
from tallywise.operators.ordered import exact_median
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6


@query("review_summary", f"""WITH {b.PREDICTED}, q AS (SELECT transaction_source, predicted_category, COUNT(*) AS n_rows,
 COUNT(*) FILTER (confidence < 0.7) AS to_review, COUNT(*) FILTER (confidence > 0.7) AS high, COUNT(*) FILTER (confidence BETWEEN 0.5 AND 0.7) AS medium,
 COUNT(*) FILTER (confidence < 0.5) AS low, CAST(SUM(amount_out) AS DOUBLE) AS amount_out, CAST(SUM(amount_in) AS DOUBLE) AS amount_in,
 AVG(confidence) AS a, MEDIAN(confidence) AS m, AVG(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END) AS r FROM predictions GROUP BY ALL)
SELECT transaction_source, predicted_category, n_rows, to_review, high, medium, low, amount_out, amount_in, ROUND(a, 6) AS mean, ROUND(m, 6) AS median,
 ROUND(r, 6) AS low_confidence_rate, r > 0.2 AS many_low, a < 0.6 AS low_mean FROM q""")
def review_summary(spark, d):
    """Per source and category: rows, tiers, review load, money and confidence alerts."""
    v = b.votes(spark, d).select(
        "txn_id", "transaction_source", "amount_out", "amount_in",
        b.pick(vote.majority_vote([F.col(f"code{i}") for i in (1, 2, 3)])).alias("predicted_category"),
        vote.mean_confidence([F.col(f"conf{i}") for i in (1, 2, 3)]).alias("confidence"))
    keys = ["transaction_source", "predicted_category"]
    c = F.col("confidence")
    sums = v.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(c < 0.7).alias("to_review"), F.count_if(c > 0.7).alias("high"),
        F.count_if(c.between(0.5, 0.7)).alias("medium"), F.count_if(c < 0.5).alias("low"),
        F.sum("amount_out").alias("amount_out"), F.sum("amount_in").alias("amount_in"),
        F.avg(c).alias("mean"), F.avg(mt.is_low(c)).alias("low_confidence_rate"))
    med = exact_median(v, keys, "confidence", mt.confidence_buckets(c), "median")
    return sums.join(med, keys, "left").select(
        *keys, "n_rows", "to_review", "high", "medium", "low", "amount_out", "amount_in", r6(F.col("mean")).alias("mean"),
        r6(F.col("median")).alias("median"), r6(F.col("low_confidence_rate")).alias("low_confidence_rate"),
        (F.col("low_confidence_rate") > mt.ALERT_LOW_RATE).alias("many_low"), (F.col("mean") < mt.ALERT_MEAN).alias("low_mean"))


@query("raw_to_review_queue", f"""WITH {b.PREDICTED} SELECT txn_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, amount_out, amount_in, predicted_category,
 ROUND(confidence, 6) AS confidence FROM predictions WHERE confidence < 0.7""")
def raw_to_review_queue(spark, d):
    """Raw money and date text, cleaned, voted on and filtered to the review queue."""
    text = b.votes(spark, d).select(
        "*", F.date_format("txn_date", "M/d/yyyy").alias("date_text"), F.concat(F.lit("  "), "description", F.lit(" ")).alias("raw_text"),
        F.concat(F.lit(" "), (F.col("amount_out") - F.col("amount_in")).cast("string")).alias("money_text"))
    typed = text.select(
        "txn_id", lenient_date(F.col("date_text")).alias("txn_date"), normal_description(F.col("raw_text")).alias("description"),
        lenient_money(F.col("money_text")).alias("signed"),
        b.pick(vote.majority_vote([F.col(f"code{i}") for i in (1, 2, 3)])).alias("predicted_category"),
        vote.mean_confidence([F.col(f"conf{i}") for i in (1, 2, 3)]).alias("confidence"))
    out, inn = split_signed(F.col("signed"))
    clean = typed.withColumns({"amount_out": out, "amount_in": inn}).drop("signed")
    return review.review_queue(clean).withColumn("confidence", r6(F.col("confidence")))
