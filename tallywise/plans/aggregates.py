"""Votes, quality metrics, frequencies and evaluation scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.operators import metrics as mt, scores as sc, sketches as sk, vote
from tallywise.operators import registry as reg
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6, text_of_map
from tallywise.session import scratch_path


def rounded(df, *names):
    return df.withColumns({n: r6(F.col(n)) for n in names})


@query("f01_frequencies", f"""WITH {b.PREDICTIONS} SELECT predicted_category, COUNT(*) AS n,
 ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM predictions WHERE predicted_category IS NOT NULL GROUP BY 1""")
def frequencies(spark, d):
    return rounded(mt.frequencies(b.predictions(spark, d), "predicted_category"), "share")


STATS = """COUNT(*) AS batch_size, ROUND(AVG(confidence), 6) AS mean, ROUND(MEDIAN(confidence), 6) AS median,
 ROUND(STDDEV_SAMP(confidence), 6) AS std, ROUND(AVG(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate"""


@query("f02_confidence_stats", f"WITH {b.PREDICTIONS} SELECT event_type, {STATS} FROM predictions GROUP BY 1")
def confidence_stats(spark, d):
    m = mt.quality_metrics(b.predictions(spark, d), "event_type")
    return rounded(m, "mean", "median", "std", "low_confidence_rate")


@query("f03_category_distribution", f"""WITH {b.PREDICTIONS}, c AS (SELECT event_type, predicted_category, COUNT(*) AS n
 FROM predictions WHERE predicted_category IS NOT NULL GROUP BY ALL)
SELECT event_type, string_agg(predicted_category || '=' || n, ';' ORDER BY predicted_category) AS distribution FROM c GROUP BY 1""")
def category_distribution(spark, d):
    m = mt.distribution_map(b.predictions(spark, d), "event_type", "predicted_category")
    return m.select("event_type", text_of_map(F.col("category_distribution")).alias("distribution"))


@query("f04_confidence_tiers", f"""WITH {b.PREDICTIONS}, t AS (SELECT transaction_source, COUNT(*) AS n_rows, COUNT(*) FILTER (confidence > 0.7) AS high,
 COUNT(*) FILTER (confidence BETWEEN 0.5 AND 0.7) AS medium, COUNT(*) FILTER (confidence < 0.5) AS low FROM predictions GROUP BY 1)
SELECT *, ROUND(high / n_rows, 6) AS high_share, ROUND(medium / n_rows, 6) AS medium_share, ROUND(low / n_rows, 6) AS low_share FROM t""")
def confidence_tiers(spark, d):
    t = mt.confidence_tiers(b.predictions(spark, d), "transaction_source")
    return rounded(t, "high_share", "medium_share", "low_share")


@query("f05_top_labels", f"""WITH {b.CATEGORIES}, c AS (SELECT category, COUNT(*) AS n FROM categories GROUP BY 1)
SELECT category, n, (SELECT COUNT(*) FROM c) - 5 AS other_labels FROM c ORDER BY n DESC, category LIMIT 5""")
def top_labels(spark, d):
    return mt.top_labels(b.categories(spark, d), "category")


@query("f06_dataset_summary", f"""WITH {b.LEDGER} SELECT transaction_source, COUNT(*) AS n_rows, strftime(MIN(txn_date), '%Y-%m-%d') AS first_date,
 strftime(MAX(txn_date), '%Y-%m-%d') AS last_date, COUNT(DISTINCT description) AS descriptions, CAST(SUM(amount_in) AS DOUBLE) AS total_amount
FROM ledger GROUP BY 1""")
def dataset_summary(spark, d):
    rows = b.ledger(spark, d).select("transaction_source", F.col("txn_date").alias("Date"),
                                     F.col("description").alias("Description"), F.col("amount_in").alias("Amount"))
    return mt.dataset_summary(rows, "transaction_source")


@query("f06_merged_sketches", f"""WITH {b.PREDICTIONS} SELECT transaction_source, COUNT(*) AS n_rows, COUNT(confidence) AS n_scored,
 ROUND(AVG(confidence), 6) AS mean, ROUND(MIN(confidence), 6) AS least, ROUND(MAX(confidence), 6) AS most, ROUND(stddev_samp(confidence), 6) AS std,
 ROUND(AVG(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END), 6) AS low_confidence_rate, TRUE AS distinct_close, TRUE AS median_close FROM predictions GROUP BY 1""")
def merged_sketches(spark, d):
    """Daily lines are stored, then merged per source without the rows; the estimates are held against exact answers."""
    rows, path = b.predictions(spark, d), scratch_path(spark, "sketches")
    daily = sk.batch_sketches(rows, ["txn_date", "transaction_source"])
    sk.store_batches(daily, path, "txn_date")
    merged = sk.merge_sketches(sk.stored_batches(spark, path, daily.schema), ["transaction_source"])
    summary = sk.sketch_summary(merged, ["transaction_source"])
    at = summary.select(F.col("transaction_source").alias("_s"), F.col("median").alias("_median"))
    exact = rows.join(at, F.col("transaction_source") == F.col("_s")).groupBy("_s").agg(
        F.count_distinct("description").alias("_texts"), F.avg((F.col("confidence") < F.col("_median")).cast("double")).alias("_below"),
        F.avg((F.col("confidence") <= F.col("_median")).cast("double")).alias("_upto"))
    out = summary.join(exact, F.col("transaction_source") == F.col("_s")).withColumns({
        "distinct_close": F.abs(F.col("distinct_texts") - F.col("_texts")) <= 0.03 * F.col("_texts"),
        "median_close": (F.col("_below") <= 0.52) & (F.col("_upto") >= 0.48)})
    return rounded(out.drop("_s", "_texts", "_below", "_upto", "distinct_texts", "median", "lower_tenth"),
                   "mean", "least", "most", "std", "low_confidence_rate")


@query("f07_quality_alerts", f"""WITH {b.PREDICTIONS}, m AS (SELECT txn_date, AVG(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END) AS r, AVG(confidence) AS a
 FROM predictions GROUP BY 1)
SELECT strftime(txn_date, '%Y-%m-%d') AS txn_date, 'high_low_confidence_rate' AS alert, ROUND(r, 6) AS value FROM m WHERE r > 0.2
UNION ALL SELECT strftime(txn_date, '%Y-%m-%d'), 'low_mean_confidence', ROUND(a, 6) FROM m WHERE a < 0.6""")
def quality_alerts(spark, d):
    m = mt.quality_metrics(b.predictions(spark, d), "txn_date")
    return rounded(mt.quality_alerts(m, "txn_date"), "value")


@query("f08_f09_vote", f"""WITH {b.VOTES}, long AS (SELECT txn_id, code1 AS code, conf1 AS conf FROM votes UNION ALL SELECT txn_id, code2, conf2 FROM votes
 UNION ALL SELECT txn_id, code3, conf3 FROM votes),
w AS (SELECT txn_id, code, ROW_NUMBER() OVER (PARTITION BY txn_id ORDER BY COUNT(*) DESC, code) AS k FROM long WHERE code IS NOT NULL GROUP BY txn_id, code)
SELECT txn_id, w.code, ROUND(c, 6) AS confidence FROM w JOIN (SELECT txn_id, AVG(conf) AS c FROM long GROUP BY 1) USING (txn_id) WHERE k = 1""")
def wide_vote(spark, d):
    v = b.votes(spark, d)
    return v.select("txn_id", vote.majority_vote([F.col(f"code{i}") for i in (1, 2, 3)]).alias("code"),
                    r6(vote.mean_confidence([F.col(f"conf{i}") for i in (1, 2, 3)])).alias("confidence"))


@query("f08_f09_vote_any_number", f"""WITH {b.VOTES}, long AS (SELECT txn_id, code1 AS code, conf1 AS conf FROM votes UNION ALL SELECT txn_id, code2, conf2 FROM votes
 UNION ALL SELECT txn_id, code3, conf3 FROM votes UNION ALL SELECT txn_id, (code1 + 1) % 5, conf2 FROM votes),
w AS (SELECT txn_id, code, ROW_NUMBER() OVER (PARTITION BY txn_id ORDER BY COUNT(*) DESC, code) AS k FROM long WHERE code IS NOT NULL GROUP BY txn_id, code)
SELECT txn_id, w.code, ROUND(c, 6) AS confidence FROM w JOIN (SELECT txn_id, AVG(conf) AS c FROM long GROUP BY 1) USING (txn_id) WHERE k = 1""")
def long_vote(spark, d):
    v = b.votes(spark, d)
    entries = F.array(*[F.struct(F.col(f"code{i}").alias("code"), F.col(f"conf{i}").alias("confidence")) for i in (1, 2, 3)],
                      F.struct(((F.col("code1") + 1) % 5).alias("code"), F.col("conf2").alias("confidence")))
    long = v.select("txn_id", F.explode(entries).alias("e")).select("txn_id", "e.*")
    return vote.vote_long(long, "txn_id", "code", "confidence").withColumn("confidence", r6(F.col("confidence")))


@query("f10_class_weights", f"""WITH {b.CATEGORIES}, c AS (SELECT category, COUNT(*) AS n FROM categories GROUP BY 1)
SELECT category, n, ROUND((SELECT SUM(n) FROM c) / ((SELECT COUNT(*) FROM c) * n), 6) AS weight FROM c""")
def class_weights(spark, d):
    return rounded(sc.class_weights(b.categories(spark, d), "category"), "weight")


def truth_and_guess(spark, d):
    """Document language against a rule on its length, and labels against another."""
    docs = b.table(spark, d, "documents").select(
        F.col("lang").alias("truth"), F.when(F.col("n_chars") % 3 == 0, F.col("lang")).when(F.col("n_chars") > 2000, "en")
        .when(F.col("doc_id") % 7 == 0, "it").otherwise("de").alias("guess"))
    return docs


GUESS = """g AS (SELECT lang AS truth, CASE WHEN n_chars % 3 = 0 THEN lang WHEN n_chars > 2000 THEN 'en' WHEN doc_id % 7 = 0 THEN 'it' ELSE 'de' END AS guess FROM documents),
labels_ AS (SELECT truth AS label FROM g UNION SELECT guess FROM g),
rep AS (SELECT label, (SELECT COUNT(*) FROM g WHERE truth = label) AS support, (SELECT COUNT(*) FROM g WHERE guess = label) AS predicted,
 (SELECT COUNT(*) FROM g WHERE guess = label AND truth = label) AS correct FROM labels_),
pr AS (SELECT *, COALESCE(correct / nullif(predicted, 0), 0) AS p, COALESCE(correct / nullif(support, 0), 0) AS r FROM rep),
report AS (SELECT label, support, predicted, correct, p AS precision, r AS recall, COALESCE(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM pr)"""


@query("f11_class_report", f"""WITH {GUESS} SELECT label, support, predicted, correct, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1 FROM report""")
def class_report(spark, d):
    return rounded(sc.class_report(truth_and_guess(spark, d), "truth", "guess"), "precision", "recall", "f1")


@query("f11_report_averages", f"""WITH {GUESS} SELECT ROUND(SUM(correct) / SUM(support), 6) AS accuracy, ROUND(AVG(precision), 6) AS macro_precision,
 ROUND(AVG(recall), 6) AS macro_recall, ROUND(AVG(f1), 6) AS macro_f1, ROUND(SUM(precision * support) / SUM(support), 6) AS weighted_precision,
 ROUND(SUM(recall * support) / SUM(support), 6) AS weighted_recall, ROUND(SUM(f1 * support) / SUM(support), 6) AS weighted_f1, CAST(SUM(support) AS BIGINT) AS support FROM report""")
def report_averages(spark, d):
    a = sc.report_averages(sc.class_report(truth_and_guess(spark, d), "truth", "guess"))
    return rounded(a, *[c for c in a.columns if c != "support"])


@query("f12_macro_f1", f"WITH {GUESS} SELECT ROUND(AVG(f1), 6) AS macro_f1 FROM report")
def macro_f1(spark, d):
    return rounded(sc.macro_f1(truth_and_guess(spark, d), "truth", "guess"), "macro_f1")


SCORED = """s AS (SELECT source AS label, CAST(quality AS INT) AS y, ((n_chars * 7 + doc_id * 13) % 50) / 50.0::DOUBLE AS score
 FROM documents JOIN labels USING (doc_id))"""


def scored(spark, d):
    """Quality labels per source with a coarse score, so that ties are common."""
    docs, labels = b.table(spark, d, "documents"), b.table(spark, d, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("source").alias("label"), (F.col("quality") == 1).alias("positive"),
        (((F.col("n_chars") * 7 + F.col("doc_id") * 13) % 50) / 50.0).alias("score"))


@query("f13_roc_auc", f"""WITH {SCORED}, r AS (SELECT label, y, RANK() OVER (PARTITION BY label ORDER BY score) + (COUNT(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS k FROM s),
a AS (SELECT label, SUM(y) AS p, COUNT(*) - SUM(y) AS n, SUM(k) FILTER (y = 1) AS k FROM r GROUP BY 1)
SELECT label, CASE WHEN p > 0 AND n > 0 THEN ROUND((k - p * (p + 1) / 2.0) / (p * n), 6) END AS roc_auc FROM a""")
def roc_auc(spark, d):
    return rounded(sc.roc_auc(scored(spark, d), "label", "positive", "score"), "roc_auc")


@query("f14_pr_auc", f"""WITH {SCORED}, g AS (SELECT label, score, SUM(y) AS p, COUNT(*) AS n FROM s GROUP BY ALL),
c AS (SELECT label, p, SUM(p) OVER w AS tp, SUM(n) OVER w AS a FROM g WINDOW w AS (PARTITION BY label ORDER BY score DESC))
SELECT label, CASE WHEN SUM(p) > 0 THEN ROUND(SUM(p * tp / a) / SUM(p), 6) END AS pr_auc FROM c GROUP BY 1""")
def pr_auc(spark, d):
    return rounded(sc.average_precision(scored(spark, d), "label", "positive", "score"), "pr_auc")


@query("f13_f14_macro", f"""WITH {SCORED}, g AS (SELECT label, score, SUM(y) AS p, COUNT(*) AS n FROM s GROUP BY ALL),
c AS (SELECT label, p, SUM(p) OVER w AS tp, SUM(n) OVER w AS a FROM g WINDOW w AS (PARTITION BY label ORDER BY score DESC)),
e AS (SELECT label, CASE WHEN SUM(p) > 0 THEN SUM(p * tp / a) / SUM(p) END AS v FROM c GROUP BY 1),
r AS (SELECT label, y, RANK() OVER (PARTITION BY label ORDER BY score) + (COUNT(*) OVER (PARTITION BY label, score) - 1) / 2.0 AS k FROM s),
u AS (SELECT label, SUM(y) AS p, COUNT(*) - SUM(y) AS n, SUM(k) FILTER (y = 1) AS k FROM r GROUP BY 1)
SELECT 'pr_auc' AS score, ROUND(AVG(v), 6) AS macro, COUNT(v) AS classes FROM e
UNION ALL SELECT 'roc_auc', ROUND(AVG(CASE WHEN p > 0 AND n > 0 THEN (k - p * (p + 1) / 2.0) / (p * n) END), 6), COUNT(*) FILTER (p > 0 AND n > 0) FROM u""")
def macro_auc(spark, d):
    rows = scored(spark, d)
    pr = sc.macro_average(sc.average_precision(rows, "label", "positive", "score"), "pr_auc")
    roc = sc.macro_average(sc.roc_auc(rows, "label", "positive", "score"), "roc_auc")
    named = lambda df, n: df.select(F.lit(n).alias("score"), F.col(n).alias("macro"), "classes")
    return rounded(named(pr, "pr_auc").unionByName(named(roc, "roc_auc")), "macro")


@query("f15_run_summary", f"""WITH {b.PREDICTIONS} SELECT transaction_source, COUNT(*) AS n_rows, ROUND(AVG(confidence), 6) AS mean_confidence,
 COUNT(*) FILTER (confidence < 0.5) AS low_rows FROM predictions GROUP BY 1""")
def run_summary(spark, d):
    return rounded(mt.run_summary(b.predictions(spark, d), "transaction_source"), "mean_confidence")


@query("f16_confusion", f"WITH {GUESS} SELECT truth, guess, COUNT(*) AS n FROM g GROUP BY ALL")
def confusion(spark, d):
    return sc.confusion(truth_and_guess(spark, d), "truth", "guess")


@query("f17_category_drift", f"""WITH {b.CATEGORIES}, o AS (SELECT category, COUNT(*) / SUM(COUNT(*)) OVER () AS p FROM categories WHERE c_custkey % 2 = 0 GROUP BY 1),
n AS (SELECT category, COUNT(*) / SUM(COUNT(*)) OVER () AS q FROM categories WHERE c_custkey % 2 = 1 GROUP BY 1),
j AS (SELECT COALESCE(p, 0) AS p, COALESCE(q, 0) AS q, greatest(COALESCE(p, 0), 0.0001) AS pp, greatest(COALESCE(q, 0), 0.0001) AS qq FROM o FULL JOIN n USING (category))
SELECT ROUND(SUM((qq - pp) * ln(qq / pp)), 6) AS psi, ROUND(SUM(abs(q - p)) / 2, 6) AS tv_distance, COUNT(*) AS labels FROM j""")
def category_drift(spark, d):
    c = b.categories(spark, d)
    return rounded(mt.category_drift(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 2 = 1"), "category"), "psi", "tv_distance")


@query("f19_version_comparison", f"""WITH {b.REGISTRY}, l AS (SELECT model, version, 'macro_f1' AS metric, macro_f1 AS value FROM entries
 UNION ALL SELECT model, version, 'accuracy', accuracy FROM entries), p AS (SELECT *, LAG(value) OVER (PARTITION BY model, metric ORDER BY version) AS previous FROM l)
SELECT *, ROUND(value - previous, 6) AS change FROM p""")
def version_comparison(spark, d):
    e = reg.current_entries(b.registry_events(spark, d))
    return rounded(mt.version_comparison(e, block=10).select("model", "version", "metric", "value", "previous", "change"), "change")
