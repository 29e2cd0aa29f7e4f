"""Source, column and quality detection over many files at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.operators import detect
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6, text_of_list, text_of_map
from tallywise.session import materialise

HITS = lambda expr, ws: " + ".join(f"contains({expr}, '{w}')::INT" for w in ws)

SCORES = b.FILE_CELLS + f""", bycol AS (SELECT file,
  bool_or(regexp_matches(lower("column"), 'item|expense|grocery')) AS h_col, bool_or(regexp_matches(lower("column"), 'merchant|vendor|payee')) AS c_col,
  bool_or(regexp_matches(lower("column"), 'card|credit')) AS c_weak, bool_or(lower("column") IN ('description', 'item')) AS has_text FROM file_columns GROUP BY 1),
bytext AS (SELECT file, string_agg(lower(value), ' ') AS t FROM file_cells WHERE row_no < 100 AND lower("column") IN ('description', 'item', 'details') GROUP BY 1),
raw AS (SELECT f.file, f.name, f.size, CAST((({HITS('lower(name)', ['house','kitty','household','cash','expenses','grocery','utilities','rent','mortgage','home'])}) * 3
   + COALESCE(h_col::INT, 0) * 4 + CASE WHEN has_text AND t IS NOT NULL THEN {HITS('t', ['grocery','supermarket','gas','utilities','rent','insurance'])} ELSE 0 END) AS BIGINT) AS h10,
  CAST((({HITS('lower(name)', ['visa','mastercard','amex','discover','card','credit','bank','statement','purchase','merchant'])}) * 3
   + COALESCE(c_col::INT, 0) * 4 + COALESCE(c_weak::INT, 0) * 2 + CASE WHEN has_text AND t IS NOT NULL THEN {HITS('t', ['visa','mastercard','payment','purchase','pos'])} ELSE 0 END) AS BIGINT) AS c10
 FROM files f LEFT JOIN bycol USING (file) LEFT JOIN bytext USING (file)),
scores AS (SELECT file, name, size, h10 / 10.0::DOUBLE AS household_score, c10 / 10.0::DOUBLE AS card_score,
  CASE WHEN h10 > c10 AND h10 > 3 THEN 'household' ELSE 'credit_card' END AS source,
  CASE WHEN h10 <> c10 AND greatest(h10, c10) > 3 THEN least(greatest(h10, c10) / 10.0::DOUBLE, 0.95::DOUBLE) ELSE 0.5::DOUBLE END AS source_confidence FROM raw)"""


def scores(spark, d):
    return detect.source_scores(b.files(spark, d).select("file", "name"), b.file_columns(spark, d), b.file_rows(spark, d))


@query("j17_source_scores", f"WITH {SCORES} SELECT file, name, household_score, card_score, source, source_confidence FROM scores")
def source_scores(spark, d):
    return scores(spark, d)


@query("d24_confirmation_tier", f"""WITH {SCORES} SELECT file, CASE WHEN source_confidence > 0.7 THEN 'accept' WHEN source_confidence >= 0.5 THEN 'offer' ELSE 'choose' END AS tier FROM scores""")
def confirmation_tier(spark, d):
    return scores(spark, d).select("file", detect.confirmation_tier(F.col("source_confidence")).alias("tier"))


PATTERNS = """patterns(source, field, names) AS (VALUES
 ('household', 'date', ['date','transaction_date','trans_date','timestamp']),
 ('household', 'description', ['description','item','expense','details','memo']),
 ('household', 'amount', ['amount','cost','price','value','expense_amount','out','in','debit','credit']),
 ('household', 'category', ['category','type','classification','expense_type']),
 ('credit_card', 'date', ['date','transaction_date','trans_date','posting_date','purchase_date']),
 ('credit_card', 'description', ['description','merchant','vendor','payee','details']),
 ('credit_card', 'amount', ['amount','transaction_amount','charge','debit','credit']),
 ('credit_card', 'category', ['category','type','classification','merchant_category']))"""
MAPPING = SCORES + ", " + PATTERNS + """, pats AS (SELECT source, field, unnest(names) AS pat, unnest(range(len(names))) AS pri FROM patterns),
hits AS (SELECT c.file, field, "column", ROW_NUMBER() OVER (PARTITION BY c.file, field ORDER BY CASE WHEN lower("column") = pat THEN 0 ELSE 1 END, pri, ordinal) AS k
 FROM file_columns c JOIN scores s USING (file) JOIN pats USING (source) WHERE contains(lower("column"), pat)),
pairs AS (SELECT file, MAX("column") FILTER (lower("column") = 'out') AS o, MAX("column") FILTER (lower("column") = 'in') AS i,
  MAX("column") FILTER (lower("column") = 'debit') AS dr, MAX("column") FILTER (lower("column") = 'credit') AS cr FROM file_columns GROUP BY 1),
paired AS (SELECT file, CASE WHEN o IS NOT NULL AND i IS NOT NULL THEN 'out_in_pair' ELSE 'debit_credit_pair' END AS mark, COALESCE(o, dr) AS mo, COALESCE(i, cr) AS mi
 FROM pairs WHERE (o IS NOT NULL AND i IS NOT NULL) OR (dr IS NOT NULL AND cr IS NOT NULL)),
mapping AS (SELECT file, field, "column" FROM hits WHERE k = 1 AND NOT (field = 'amount' AND file IN (SELECT file FROM paired))
 UNION ALL SELECT file, 'amount', mark FROM paired UNION ALL SELECT file, 'amount_out', mo FROM paired UNION ALL SELECT file, 'amount_in', mi FROM paired)"""


def mapping(spark, d):
    """Column mapping of every file, stored because several steps read it."""
    found = materialise(spark, scores(spark, d), "scores")
    return materialise(spark, detect.column_mapping(b.file_columns(spark, d), found), "mapping")


@query("c04_column_mapping", f"""WITH {MAPPING} SELECT file, field, "column" FROM mapping""")
def column_mapping(spark, d):
    return mapping(spark, d)


@query("c05_amount_pairs", f"""WITH {MAPPING} SELECT file, mark AS amount, mo AS amount_out, mi AS amount_in FROM paired""")
def amount_pairs(spark, d):
    return detect.amount_pairs(b.file_columns(spark, d))


@query("d11_d13_column_quality", f"""WITH {b.FILE_CELLS} SELECT file, "column", COUNT(*) AS n_rows, COUNT(value) AS filled, COUNT(TRY_CAST(value AS DOUBLE)) AS numeric,
 ROUND(COUNT(value) / COUNT(*), 6) AS filled_share, ROUND(COUNT(TRY_CAST(value AS DOUBLE)) / nullif(COUNT(value), 0), 6) AS numeric_share FROM file_cells GROUP BY ALL""")
def column_quality(spark, d):
    q = detect.column_quality(b.file_rows(spark, d))
    return q.withColumns({"filled_share": r6(F.col("filled") / F.col("n_rows")),
                          "numeric_share": r6(F.try_divide(F.col("numeric"), F.col("filled")))})


SAMPLE = MAPPING + """, dated AS (SELECT c.file, value, ROW_NUMBER() OVER (PARTITION BY c.file ORDER BY row_no) AS k FROM file_cells c
 JOIN mapping m ON m.file = c.file AND m.field = 'date' AND m."column" = c."column" WHERE value IS NOT NULL),
sample AS (SELECT file, COUNT(*) AS sampled, COUNT(*) FILTER (value <> 'soon') AS parsed FROM dated WHERE k <= 10 GROUP BY 1)"""


@query("d12_date_sample", f"WITH {SAMPLE} SELECT * FROM sample")
def date_sample(spark, d):
    return detect.date_sample_quality(b.file_rows(spark, d), mapping(spark, d))


@query("d14_d15_required_fields", f"""WITH {MAPPING}, r AS (SELECT file, COUNT(*) AS n_rows FROM numbered GROUP BY 1)
SELECT f.file, COALESCE(n_rows, 0) AS n_rows, COALESCE(n_rows, 0) < 10 AS too_small, (SELECT COUNT(*) FROM mapping m WHERE m.file = f.file AND field IN ('date', 'description', 'amount')) AS required_fields
FROM files f LEFT JOIN r ON r.file = f.file""")
def required_fields(spark, d):
    rows = b.file_rows(spark, d).groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"))
    found = mapping(spark, d).where(F.col("field").isin("date", "description", "amount")).groupBy("file").agg(
        F.count(F.lit(1)).alias("required_fields"))
    n = F.coalesce("n_rows", F.lit(0))
    return b.files(spark, d).select("file").join(rows, "file", "left").join(found, "file", "left").select(
        "file", n.alias("n_rows"), (n < 10).alias("too_small"), F.coalesce("required_fields", F.lit(0)).alias("required_fields"))


VERDICT = SAMPLE + """, q AS (SELECT file, "column", COUNT(*) AS n, COUNT(value) AS filled, COUNT(TRY_CAST(value AS DOUBLE)) AS num FROM file_cells GROUP BY ALL),
probs AS (SELECT m.file, unnest(list_filter([
   CASE WHEN field NOT IN ('amount_out', 'amount_in') AND filled < n * 0.5 THEN 'mostly empty: ' || m."column" END,
   CASE WHEN field = 'amount' AND filled = 0 THEN 'cannot validate: ' || m."column" END,
   CASE WHEN field IN ('amount', 'amount_out', 'amount_in') AND num < filled * 0.8 THEN 'not numeric: ' || m."column" END], lambda x: x IS NOT NULL)) AS issue
 FROM mapping m JOIN q ON q.file = m.file AND q."column" = m."column"
 UNION ALL SELECT m.file, 'cannot validate: amount pair' FROM mapping m JOIN q ON q.file = m.file AND q."column" = m."column" WHERE field IN ('amount_out', 'amount_in')
 GROUP BY m.file HAVING MAX(filled) = 0),
colissues AS (SELECT file, list_sort(list(issue)) AS ci FROM probs GROUP BY 1),
fields AS (SELECT file, list(field) AS fs, string_agg(field || '=' || "column", ';' ORDER BY field) AS detected FROM mapping GROUP BY 1),
cnt AS (SELECT file, COUNT(*) AS n FROM numbered GROUP BY 1),
j AS (SELECT s.*, ci, fs, detected, COALESCE(n, 0) AS n, sampled, parsed,
  list_filter(['date', 'description', 'amount'], lambda x: NOT list_contains(COALESCE(fs, []), x)) AS lack
 FROM scores s LEFT JOIN colissues c ON c.file = s.file LEFT JOIN fields f ON f.file = s.file LEFT JOIN cnt ON cnt.file = s.file LEFT JOIN sample p ON p.file = s.file),
b AS (SELECT *, CASE WHEN size IS NULL THEN 'File not found' WHEN size = 0 THEN 'File is empty' WHEN n = 0 THEN 'File contains no data rows' END AS broken FROM j),
v AS (SELECT *, CASE WHEN broken IS NOT NULL THEN [broken] ELSE list_concat(list_concat(list_concat(
   CASE WHEN len(lack) > 0 THEN ['missing columns: ' || array_to_string(lack, ', ')] ELSE [] END, COALESCE(ci, [])),
   CASE WHEN parsed < sampled * 0.8 THEN ['unreadable dates'] ELSE [] END), CASE WHEN n < 10 THEN ['too few rows: ' || n] ELSE [] END) END AS issues FROM b)"""


@query("d16_file_verdict", f"""WITH {VERDICT} SELECT file, name, CASE WHEN broken IS NULL THEN source END AS source, CASE WHEN broken IS NULL THEN source_confidence ELSE 0 END AS confidence,
 array_to_string(issues, '|') AS issues, detected, n AS row_count, COALESCE(size, 0) AS file_size,
 len(issues) = 0 AND source_confidence > 0.5 AS is_valid FROM v""")
def file_verdict(spark, d):
    # ingested rows are a stored table
    rows = materialise(spark, b.file_rows(spark, d), "rows")
    v = detect.detect_files(b.files(spark, d).select("file", "name", "size"), b.file_columns(spark, d), rows)
    return v.select("file", "name", "source", "confidence", text_of_list(F.col("issues")).alias("issues"),
                    F.when(F.col("detected_columns").isNotNull(), text_of_map(F.col("detected_columns"))).alias("detected"),
                    "row_count", "file_size", "is_valid")
