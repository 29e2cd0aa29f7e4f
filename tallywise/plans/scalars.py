"""Scalar functions on money, date and file-name text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.constants import SOURCE_SETTINGS
from tallywise.functions import filenames as fn
from tallywise.functions import money as mn
from tallywise.functions.dates import lenient_date
from tallywise.functions.text import normal_description
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6

# SQL of the number rule, for a text expression
NUM = r"""CASE WHEN regexp_matches(trim({0}), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$')
 THEN TRY_CAST(trim({0}) AS DOUBLE) END"""


@query("j01_bank_money", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 29 = 0 THEN 'PHP n/a' ELSE
  'PHP ' || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '' END || format('{{:,.2f}}', l_extendedprice) END AS t
  FROM lineitem)
SELECT l_orderkey, l_linenumber, t AS money_text, {NUM.format("replace(replace(t, 'PHP ', ''), ',', '')")} AS amount FROM t""")
def bank_money(spark, d):
    text = F.when(F.col("l_orderkey") % 29 == 0, "PHP n/a").otherwise(F.concat(
        F.lit("PHP "), F.when(F.col("l_returnflag") == "R", "-").otherwise(""),
        F.format_number("l_extendedprice", 2)))
    t = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("money_text"))
    return t.withColumn("amount", mn.bank_money(F.col("money_text")))


@query("j02_any_money", f"""
WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_orderkey % 6
   WHEN 0 THEN '$' || p WHEN 1 THEN '(' || p || ')' WHEN 2 THEN 'EUR ' || p WHEN 3 THEN '₱(' || p || ')'
   WHEN 4 THEN p || ' USD' ELSE 'about ' || p END AS t
  FROM (SELECT *, format('{{:,.2f}}', l_extendedprice) AS p FROM lineitem))
SELECT l_orderkey, l_linenumber, t AS money_text, {NUM.format(
    "replace(replace(replace(replace(replace(replace(replace(replace(t, '$', ''), '₱', ''), 'PHP', ''), 'USD', ''), 'EUR', ''), ',', ''), '(', '-'), ')', '')")} AS amount FROM t""")
def any_money(spark, d):
    p, k = F.format_number("l_extendedprice", 2), F.col("l_orderkey") % 6
    text = (F.when(k == 0, F.concat(F.lit("$"), p)).when(k == 1, F.concat(F.lit("("), p, F.lit(")")))
            .when(k == 2, F.concat(F.lit("EUR "), p)).when(k == 3, F.concat(F.lit("₱("), p, F.lit(")")))
            .when(k == 4, F.concat(p, F.lit(" USD"))).otherwise(F.concat(F.lit("about "), p)))
    t = b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.alias("money_text"))
    return t.withColumn("amount", mn.any_money(F.col("money_text")))


@query("j03_lenient_number", f"""
WITH t AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' ' || v || ' ' WHEN 1 THEN v || 'd' WHEN 2 THEN 'nan'
   WHEN 3 THEN '' WHEN 4 THEN '1,' || v WHEN 5 THEN '-' || v WHEN 6 THEN v || 'e2' WHEN 7 THEN '.5' ELSE 'inf' END AS t
  FROM (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events))
SELECT event_id, t AS number_text, ROUND({NUM.format("t")}, 6) AS number FROM t""")
def lenient_number(spark, d):
    v, k = F.col("value").cast("decimal(18,2)").cast("string"), F.col("event_id") % 9
    text = (F.when(k == 0, F.concat(F.lit(" "), v, F.lit(" "))).when(k == 1, F.concat(v, F.lit("d")))
            .when(k == 2, "nan").when(k == 3, "").when(k == 4, F.concat(F.lit("1,"), v))
            .when(k == 5, F.concat(F.lit("-"), v)).when(k == 6, F.concat(v, F.lit("e2")))
            .when(k == 7, ".5").otherwise("inf"))
    t = b.table(spark, d, "events").select("event_id", text.alias("number_text"))
    return t.withColumn("number", r6(mn.lenient_number(F.col("number_text"))))


@query("j04_lenient_date", """
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
   WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y')
   WHEN 3 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%-d/13/%Y') END AS t FROM orders)
SELECT o_orderkey, t AS date_text, strftime(COALESCE(TRY_STRPTIME(t, '%Y-%m-%d'), TRY_STRPTIME(t, '%m/%d/%Y')), '%Y-%m-%d') AS txn_date
FROM t""")
def dates(spark, d):
    o, k = "o_orderdate", F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format(o, "yyyy-MM-dd")).when(k == 1, F.date_format(o, "M/d/yyyy"))
            .when(k == 2, F.date_format(o, "MM/dd/yyyy")).when(k == 3, F.date_format(o, "dd.MM.yyyy"))
            .otherwise(F.concat(F.date_format(o, "d"), F.lit("/13/"), F.date_format(o, "yyyy"))))
    t = b.table(spark, d, "orders").select("o_orderkey", text.alias("date_text"))
    return t.withColumn("txn_date", lenient_date(F.col("date_text")))


@query("j05_clean_description", r"""
SELECT doc_id, regexp_replace(CASE WHEN doc_id % 50 = 0 THEN NULL ELSE '  ' || text || ' ' END, '^\s+|\s+$', '', 'g') AS description
FROM documents""")
def clean_description(spark, d):
    raw = F.when(F.col("doc_id") % 50 != 0, F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
    return b.table(spark, d, "documents").select("doc_id", normal_description(raw).alias("description"))


STEM = r"regexp_replace({0}, '^(.+)\.[^.]+$', '\1')"


@query("j06_period_of_name", f"""WITH {b.NAMES}
SELECT o_orderkey, name, nullif(regexp_extract(lower({STEM.format('name')}), '(\\d{{4}}-\\d{{2}})', 1), '') AS period FROM names""")
def period_of_name(spark, d):
    return b.names(spark, d).select("o_orderkey", "name", fn.period_of(F.col("name")).alias("period"))


SOURCE_SQL = r"""CASE WHEN contains(s, 'unionbank') OR contains(s, 'union bank') THEN 'unionbank_visa'
  WHEN contains(s, 'bpi') THEN 'bpi_mastercard' WHEN contains(s, 'metrobank') THEN 'metrobank_visa'
  WHEN contains(s, 'house') OR contains(s, 'kitty') OR contains(s, 'cash') THEN 'household_cash'
  WHEN regexp_matches(s, 'automl.*statement.*?([a-z]+(?:\s+[a-z]+)?)')
   THEN regexp_replace(regexp_extract(s, 'automl.*statement.*?([a-z]+(?:\s+[a-z]+)?)', 1), '\s+', '_', 'g')
  ELSE 'unknown' END"""


@query("j07_source_of_name", f"""WITH {b.NAMES}
SELECT o_orderkey, name, {SOURCE_SQL} AS source FROM (SELECT *, lower({STEM.format('name')}) AS s FROM names)""")
def source_of_name(spark, d):
    return b.names(spark, d).select("o_orderkey", "name", fn.source_of(F.col("name")).alias("source"))


@query("j08_standard_source", r"""
WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' Union Bank! ' WHEN 1 THEN 'B.P.I Gold' WHEN 2 THEN 'Kitty ' || p_name
   WHEN 3 THEN p_name || ' & Co.' WHEN 4 THEN '--' ELSE 'The  Union  ' || p_type || ' Bank' END AS t FROM part),
c AS (SELECT *, regexp_replace(lower(trim(t)), '[^\p{L}\p{N}_\s]', '', 'g') AS c FROM t)
SELECT p_partkey, t AS source_text, CASE
  WHEN c = 'union bank' THEN 'unionbank_visa' WHEN contains(j, 'union') AND contains(j, 'bank') THEN 'unionbank_visa'
  WHEN contains(j, 'bpi') THEN 'bpi_mastercard'
  WHEN contains(j, 'house') OR contains(j, 'kitty') OR contains(j, 'cash') THEN 'household_cash'
  WHEN j = '' THEN 'unknown' ELSE j END AS source
FROM (SELECT *, regexp_replace(c, '\s+', '_', 'g') AS j FROM c)""")
def standard_source(spark, d):
    k = F.col("p_partkey") % 6
    text = (F.when(k == 0, " Union Bank! ").when(k == 1, "B.P.I Gold")
            .when(k == 2, F.concat(F.lit("Kitty "), "p_name")).when(k == 3, F.concat("p_name", F.lit(" & Co.")))
            .when(k == 4, "--").otherwise(F.concat(F.lit("The  Union  "), "p_type", F.lit(" Bank"))))
    t = b.table(spark, d, "part").select("p_partkey", text.alias("source_text"))
    return t.withColumn("source", fn.standard_source(F.col("source_text")))


@query("j09_build_name", """
SELECT o_orderkey, lower(o_orderstatus) || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '_' || strftime(o_orderdate, '%Y-%m') END
 || '_predictions_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.csv' AS name FROM orders""")
def build_name(spark, d):
    period = F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM"))
    return b.table(spark, d, "orders").select("o_orderkey", fn.build_name(
        F.lower("o_orderstatus"), period, F.lit("predictions"),
        F.date_format("o_orderdate", fn.STAMP)).alias("name"))


PARSED = b.NAMES + f""", parts AS (SELECT *, string_split({STEM.format('name')}, '_') AS p FROM names),
heads AS (SELECT *, p[1:len(p) - 3] AS head FROM parts),
found AS (SELECT *, list_filter(head, lambda x: regexp_matches(x, '^\\d{{4}}-\\d{{2}}'))[1] AS per FROM heads),
parsed AS (SELECT o_orderkey, o_orderdate, name, p, CASE WHEN len(p) >= 4 THEN per END AS period,
  CASE WHEN len(p) >= 4 THEN nullif(array_to_string(CASE WHEN per IS NULL THEN head ELSE head[1:list_position(head, per) - 1] END, '_'), '') END AS source,
  CASE WHEN len(p) >= 4 THEN p[len(p) - 2] END AS stage,
  CASE WHEN len(p) >= 4 THEN p[len(p) - 1] || '_' || p[len(p)] END AS ts FROM found)"""
STAMP_OK = r"(regexp_matches(ts, '^\d{8}_\d{6}$') AND TRY_STRPTIME(ts, '%Y%m%d_%H%M%S') IS NOT NULL)"


@query("j10_parse_name", f"WITH {PARSED} SELECT o_orderkey, name, source, period, stage, ts AS stamp FROM parsed")
def parse_name(spark, d):
    return b.names(spark, d).withColumn("p", fn.parse_name(F.col("name"))).select(
        "o_orderkey", "name", "p.source", "p.period", "p.stage", F.col("p.timestamp").alias("stamp"))


@query("j11_name_is_standard", f"""WITH {PARSED} SELECT o_orderkey, name, COALESCE(source IS NOT NULL
 AND stage IN ('input','predictions','corrected','accounting','training') AND {STAMP_OK}, FALSE) AS ok FROM parsed""")
def name_is_standard(spark, d):
    return b.names(spark, d).select("o_orderkey", "name", fn.name_is_standard(F.col("name")).alias("ok"))


LEGACY = r"""legacy AS (SELECT *, list_filter(p, lambda x: regexp_matches(x, '^\d{8}'))[1] AS dd FROM parsed),
legacy2 AS (SELECT * EXCLUDE (ts), ts AS own_ts, dd || '_' || p[list_position(p, dd) + 1] AS ts FROM legacy),
legacy3 AS (SELECT *, 'legacy_file_accounting_' || COALESCE(CASE WHEN STAMP_OK THEN ts END, '20250101_000000') || '.csv' AS legacy_name
 FROM legacy2)""".replace("STAMP_OK", STAMP_OK)


@query("j12_legacy_name", f"WITH {PARSED}, {LEGACY} SELECT o_orderkey, name, legacy_name FROM legacy3")
def legacy_name(spark, d):
    return b.names(spark, d).select("o_orderkey", "name", fn.legacy_name(
        F.col("name"), F.lit("accounting"), F.lit("20250101_000000")).alias("legacy_name"))


@query("j13_next_stage", f"""WITH {PARSED}, {LEGACY},
m AS (SELECT *, CASE WHEN source IS NOT NULL AND stage IS NOT NULL AND {STAMP_OK.replace('ts', 'own_ts')}
  THEN source || COALESCE('_' || period, '') || '_' END AS start FROM legacy3)
SELECT o_orderkey, name, start || 'corrected_' || own_ts || '.csv' AS corrected,
 COALESCE(start || 'accounting_' || own_ts || '.csv', legacy_name) AS accounting,
 start || 'training_' || own_ts || '.csv' AS training FROM m""")
def next_stage(spark, d):
    now = F.lit("20250101_000000")
    return b.names(spark, d).select("o_orderkey", "name", *[
        fn.next_stage_name(F.col("name"), s, now).alias(s) for s in ("corrected", "accounting", "training")])


@query("j14_strip_upload_prefix", f"""WITH {b.NAMES}
SELECT o_orderkey, CASE WHEN len(p) >= 4 THEN array_to_string(p[4:], '_') ELSE name END AS bare
FROM (SELECT *, string_split(name, '_') AS p FROM names)""")
def strip_upload_prefix(spark, d):
    return b.names(spark, d).select("o_orderkey", fn.strip_upload_prefix(F.col("name")).alias("bare"))


@query("j15_household_output_name", f"""WITH {b.NAMES}
SELECT o_orderkey, 'House Kitty Transactions - Cash - Corrected ' || COALESCE(nullif(regexp_extract(name,
 'House Kitty Transactions - Cash (\\d{{4}}-\\d{{2}})\\.csv', 1), ''), '2025-01') || '.csv' AS output_name FROM names""")
def household_output_name(spark, d):
    return b.names(spark, d).select("o_orderkey", fn.household_output_name(
        F.col("name"), F.lit("2025-01")).alias("output_name"))


@query("j16_version_in_name", r"""
SELECT p_partkey, TRY_CAST(regexp_extract(n, 'v(\d+)', 1) AS BIGINT) AS version FROM (
 SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'initial.csv' ELSE
  'training_data_household_v' || p_size || '_20250101.csv' END AS n FROM part)""")
def version_in_name(spark, d):
    n = F.when(F.col("p_partkey") % 4 == 0, "initial.csv").otherwise(F.concat(
        F.lit("training_data_household_v"), F.col("p_size").cast("string"), F.lit("_20250101.csv")))
    return b.table(spark, d, "part").select("p_partkey", fn.version_in(n).alias("version"))


@query("j18_source_settings", """
WITH s(source, display, min_samples, threshold, analyzer) AS (VALUES
 ('household', 'Household Expenses', 5, 0.6::DOUBLE, 'word'),
 ('credit_card', 'Credit Card Transactions', 3, 0.7::DOUBLE, 'char_wb')),
t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HOUSEHOLD' WHEN 1 THEN 'Credit_Card' WHEN 2 THEN 'household' ELSE 'cash' END AS t FROM events)
SELECT event_id, t AS source_text, source, display, min_samples, threshold, analyzer FROM t LEFT JOIN s ON lower(t) = source""")
def source_settings(spark, d):
    s = spark.createDataFrame(SOURCE_SETTINGS, "source string, display string, min_samples int, "
                              "threshold double, kind string, analyzer string, n1 int, n2 int")
    t = b.table(spark, d, "events").select("event_id", F.element_at(
        F.lit(["HOUSEHOLD", "Credit_Card", "household", "cash"]),
        (F.col("event_id") % 4 + 1).cast("int")).alias("source_text"))
    # two fixed rows
    return t.join(F.broadcast(s), F.lower("source_text") == s["source"], "left").select(
        "event_id", "source_text", "source", "display", "min_samples", "threshold", "analyzer")


@query("j19_human_size", """
SELECT l_orderkey, l_linenumber, CASE WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0::DOUBLE)
 ELSE printf('%.1f MB', s / 1048576.0::DOUBLE) END AS size_text
FROM (SELECT *, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS s FROM lineitem)""")
def human_size(spark, d):
    size = F.round(F.col("l_extendedprice") * 100).cast("long")
    return b.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber",
                                                mn.human_size(size).alias("size_text"))


@query("j21_percent_text", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN NULL ELSE ROUND(ROUND(l_discount * 100, 2) / 100.0, 6) END AS ratio,
 printf('%.2f', l_tax * 100.0) || '%' AS percent FROM lineitem""")
def percent_text(spark, d):
    text = F.when(F.col("l_linenumber") == 7, "n/a%").otherwise(
        mn.ratio_to_percent(F.col("l_discount")))
    return b.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(mn.percent_to_ratio(text)).alias("ratio"),
        mn.ratio_to_percent(F.col("l_tax")).alias("percent"))
