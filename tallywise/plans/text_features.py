"""TF-IDF, label codes and the stratified split on whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.operators import tfidf
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6

WORDS = """toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents),
terms AS (SELECT doc_id, unnest(t) AS term FROM toks UNION ALL
 SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM toks),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM terms GROUP BY ALL)"""
FIT = """n AS (SELECT COUNT(*) AS n FROM {docs}),
vocab AS (SELECT term, df, cf, ln((n + 1) / (df + 1)) + 1 AS idf FROM (SELECT term, COUNT(*) AS df, SUM(tf) AS cf FROM {tf} GROUP BY 1), n
 WHERE df >= 2 AND df <= n * 0.95 ORDER BY cf DESC, term LIMIT 5000)"""
WEIGHTS = """raw AS (SELECT {row}, term, tf * idf AS w FROM {tf} JOIN vocab USING (term)),
weights AS (SELECT {row}, term, w / sqrt(SUM(w * w) OVER (PARTITION BY {row})) AS weight FROM raw)"""


@query("k01_vocabulary", f"""WITH {WORDS}, {FIT.format(docs='documents', tf='tf')}
SELECT term, df, CAST(cf AS BIGINT) AS cf, ROUND(idf, 6) AS idf FROM vocab""")
def vocabulary(spark, d):
    v = tfidf.fit_vocabulary(b.table(spark, d, "documents"), "text")
    return v.withColumn("idf", r6(F.col("idf")))


@query("k01_tfidf_word", f"""WITH {WORDS}, {FIT.format(docs='documents', tf='tf')}, {WEIGHTS.format(row='doc_id', tf='tf')}
SELECT doc_id, term, ROUND(weight, 6) AS weight FROM weights""")
def tfidf_word(spark, d):
    _, w = tfidf.fit_tfidf(b.table(spark, d, "documents"), "doc_id", "text")
    return w.withColumn("weight", r6(F.col("weight")))


CHARS = """words AS (SELECT conv_id, turn, ' ' || w || ' ' AS w, COUNT(*) AS k FROM (SELECT conv_id, turn,
  unnest(regexp_split_to_array(strip_accents(lower(text)), '\\s+')) AS w FROM conversations) WHERE w <> '' GROUP BY ALL),
grams AS (SELECT conv_id, turn, k, substr(w, i, 1) AS term FROM (SELECT *, unnest(range(1, length(w) + 1)) AS i FROM words) UNION ALL
 SELECT conv_id, turn, k, substr(w, i, 2) FROM (SELECT *, unnest(range(1, length(w))) AS i FROM words) UNION ALL
 SELECT conv_id, turn, k, substr(w, i, 3) FROM (SELECT *, unnest(range(1, length(w) - 1)) AS i FROM words)),
tf AS (SELECT conv_id || ':' || turn AS row_id, term, SUM(k) AS tf FROM grams GROUP BY ALL)"""


@query("k02_tfidf_char", f"""WITH {CHARS}, {FIT.format(docs='conversations', tf='tf')}, {WEIGHTS.format(row='row_id', tf='tf')}
SELECT row_id, term, ROUND(weight, 6) AS weight FROM weights""")
def tfidf_char(spark, d):
    c = b.table(spark, d, "conversations").select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), "text")
    _, w = tfidf.fit_tfidf(c, "row_id", "text", "char_wb")
    return w.withColumn("weight", r6(F.col("weight")))


@query("k03_apply_vocabulary", f"""WITH {WORDS}, tr AS (SELECT tf.* FROM tf JOIN documents d ON d.doc_id = tf.doc_id WHERE lang = 'en'),
{FIT.format(docs="documents WHERE lang = 'en'", tf='tr')}, {WEIGHTS.format(row='doc_id', tf='tf')}
SELECT d.doc_id, term, ROUND(weight, 6) AS weight FROM documents d LEFT JOIN weights w ON w.doc_id = d.doc_id""")
def apply_vocabulary(spark, d):
    """A vocabulary fitted on one language, applied to the whole table."""
    docs = b.table(spark, d, "documents").select("doc_id", "text", "lang")
    vocab = tfidf.fit_vocabulary(docs.where("lang = 'en'"), "text")
    return tfidf.apply_tfidf(docs, "doc_id", "text", vocab).withColumn("weight", r6(F.col("weight")))


@query("k04_label_codes", f"WITH {b.CATEGORIES} SELECT category, DENSE_RANK() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM categories)")
def label_codes(spark, d):
    return tfidf.encode_labels(b.categories(spark, d), "category")


@query("k05_stratified_split", """WITH r AS (SELECT event_id, event_type, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY md5('42:' || event_id), event_id) AS k,
 COUNT(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_id, event_type, k <= ROUND(n * 0.2) AS is_test FROM r""")
def stratified_split(spark, d):
    return tfidf.stratified_split(b.table(spark, d, "events").select("event_id", "event_type"), "event_id", "event_type")
