"""Ledger concepts read from the test tables, in DataFrame form and as SQL CTEs.

Every function takes ``(spark, folder)``. The SQL constant next to it is the
same table for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise.functions.money import split_signed
from tallywise.operators.ordered import row_ordinals
from tallywise.operators.vote import mean_confidence, majority_vote

LABELS = ["Expenses:Dining", "Expenses:Fees", "Expenses:Groceries", "Expenses:Health",
          "Expenses:Travel"]
SQL_LABELS = "['Expenses:Dining','Expenses:Fees','Expenses:Groceries','Expenses:Health','Expenses:Travel']"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(index: Column) -> Column:
    return F.element_at(F.lit(LABELS), (index + 1).cast("int"))


def source_by(key: str) -> Column:
    return F.when(F.col(key) % 2 == 0, "household").otherwise("credit_card")


def key_block(key: str, rows: int = 2**20) -> Column:
    """Block of an increasing key, for splitting long stretches of rows."""
    return F.floor(F.col(key) / rows)


# --- ledger rows -------------------------------------------------------------
def ledger(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value").cast("decimal(18,2)")
    signed = F.when(F.col("event_type").isin("error", "signup"), -v).otherwise(v).cast("decimal(18,2)")
    out, inn = split_signed(signed)
    return table(spark, d, "events").select(
        F.col("event_id").alias("txn_id"), "ts", F.col("ts").cast("date").alias("txn_date"),
        F.concat_ws(" ", "event_type", "props").alias("description"), signed.alias("signed"),
        out.alias("amount_out"), inn.alias("amount_in"),
        source_by("event_id").alias("transaction_source"), "user_id", "event_type", "value")


LEDGER = """ledger AS (
 SELECT txn_id, ts, CAST(ts AS DATE) AS txn_date, description, signed,
  CASE WHEN signed > 0 THEN signed ELSE 0 END AS amount_out,
  CASE WHEN signed < 0 THEN -signed ELSE 0 END AS amount_in,
  transaction_source, user_id, event_type, value
 FROM (SELECT event_id AS txn_id, ts, event_type || ' ' || props AS description,
   CAST(CASE WHEN event_type IN ('error','signup') THEN -CAST(value AS DECIMAL(18,2))
        ELSE CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS signed,
   CASE WHEN event_id % 2 = 0 THEN 'household' ELSE 'credit_card' END AS transaction_source,
   user_id, event_type, value FROM events))"""


# --- model votes and predictions ---------------------------------------------
def votes(spark: SparkSession, d: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    e, u = F.col("txn_id"), F.col("user_id")
    third = e % 97 != 0
    base = ledger(spark, d).withColumn("cents", cents)
    c = F.col("cents")
    return base.select(
        "txn_id", "ts", "txn_date", "description", "amount_out", "amount_in",
        "transaction_source", "event_type",
        (e % 5).cast("int").alias("code1"), F.expr("(txn_id div 3) % 5").cast("int").alias("code2"),
        F.when(third, F.expr("(user_id * 7 + txn_id div 5) % 5").cast("int")).alias("code3"),
        ((c % 1000) / 1000.0).alias("conf1"), (F.expr("(cents div 7) % 1000") / 1000.0).alias("conf2"),
        F.when(third, ((c * 3 + e) % 1000) / 1000.0).alias("conf3"))


VOTES = LEDGER + """, votes AS (
 SELECT txn_id, ts, txn_date, description, amount_out, amount_in, transaction_source, event_type,
  CAST(txn_id % 5 AS INT) AS code1, CAST((txn_id // 3) % 5 AS INT) AS code2,
  CASE WHEN txn_id % 97 <> 0 THEN CAST((user_id * 7 + txn_id // 5) % 5 AS INT) END AS code3,
  (cents % 1000) / 1000.0::DOUBLE AS conf1, ((cents // 7) % 1000) / 1000.0::DOUBLE AS conf2,
  CASE WHEN txn_id % 97 <> 0 THEN ((cents * 3 + txn_id) % 1000) / 1000.0::DOUBLE END AS conf3
 FROM (SELECT *, CAST(ROUND(value * 100) AS BIGINT) AS cents FROM ledger))"""


def predictions(spark: SparkSession, d: str) -> DataFrame:
    v = votes(spark, d)
    known = F.col("txn_id") % 101 != 0
    code = majority_vote([F.col("code1"), F.col("code2"), F.col("code3")])
    conf = mean_confidence([F.col("conf1"), F.col("conf2"), F.col("conf3")])
    return v.select(
        "txn_id", "ts", "txn_date", "description", "amount_out", "amount_in",
        "transaction_source", "event_type",
        F.when(known, pick(code)).alias("predicted_category"),
        F.when(known, conf).alias("confidence"))


PREDICTIONS = VOTES + f""", winner AS (
 SELECT txn_id, code FROM (
  SELECT txn_id, code, ROW_NUMBER() OVER (PARTITION BY txn_id ORDER BY COUNT(*) DESC, code) AS k
  FROM (SELECT txn_id, code1 AS code FROM votes UNION ALL SELECT txn_id, code2 FROM votes
        UNION ALL SELECT txn_id, code3 FROM votes) WHERE code IS NOT NULL GROUP BY txn_id, code)
 WHERE k = 1),
predictions AS (
 SELECT v.txn_id, ts, txn_date, description, amount_out, amount_in, transaction_source, event_type,
  CASE WHEN v.txn_id % 101 <> 0 THEN {SQL_LABELS}[code + 1] END AS predicted_category,
  CASE WHEN v.txn_id % 101 <> 0 THEN (conf1 + conf2 + COALESCE(conf3, 0))
   / (CASE WHEN conf3 IS NULL THEN 2 ELSE 3 END) END AS confidence
 FROM votes v JOIN winner w ON v.txn_id = w.txn_id)"""
# the same with a prediction for every row
PREDICTED = PREDICTIONS.replace("v.txn_id % 101 <> 0", "TRUE")


# --- correction requests -----------------------------------------------------
def corrections(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("row_id"))
    first = e.where(F.col("row_id") % 7 == 0).select(
        "row_id", F.when(F.col("row_id") % 35 == 0, "").otherwise(pick(F.expr("(row_id div 7) % 5")))
        .alias("new_category"), F.lit(1).cast("long").alias("seq"))
    again = e.where(F.col("row_id") % 21 == 0).select(
        "row_id", pick(F.expr("(row_id div 21) % 5")).alias("new_category"),
        F.lit(2).cast("long").alias("seq"))
    outside = e.where((F.col("row_id") % 49 == 0) & (F.col("row_id") > 0)).select(
        (-F.col("row_id")).alias("row_id"), F.lit(LABELS[0]).alias("new_category"),
        F.lit(1).cast("long").alias("seq"))
    return first.union(again).union(outside)


CORRECTIONS = f"""corrections AS (
 SELECT event_id AS row_id, CASE WHEN event_id % 35 = 0 THEN ''
   ELSE {SQL_LABELS}[(event_id // 7) % 5 + 1] END AS new_category, 1 AS seq
 FROM events WHERE event_id % 7 = 0
 UNION ALL SELECT event_id, {SQL_LABELS}[(event_id // 21) % 5 + 1], 2 FROM events WHERE event_id % 21 = 0
 UNION ALL SELECT -event_id, 'Expenses:Dining', 1 FROM events WHERE event_id % 49 = 0 AND event_id > 0)"""


# --- household log with Out and In -------------------------------------------
def household(spark: SparkSession, d: str) -> DataFrame:
    price = F.col("o_totalprice").cast("decimal(18,2)")
    paid_in = F.col("o_orderstatus") == "P"
    text = F.when(F.col("o_orderkey") % 50 == 0, F.format_number(F.col("o_totalprice"), 2)) \
            .otherwise(price.cast("string"))
    return table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate",
        F.date_format("o_orderdate", "M/d/yyyy").alias("Date"),
        F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")).alias("Description"),
        F.when(~paid_in, text).alias("Out"), F.when(paid_in, text).alias("In"))


HOUSEHOLD = """household AS (
 SELECT o_orderkey, o_custkey, o_orderdate, strftime(o_orderdate, '%-m/%-d/%Y') AS Date,
  ' ' || o_orderpriority || ' ' AS Description,
  CASE WHEN o_orderstatus <> 'P' THEN t END AS "Out", CASE WHEN o_orderstatus = 'P' THEN t END AS "In"
 FROM (SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN format('{:,.2f}', o_totalprice)
   ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS t FROM orders))"""


# --- category dictionary -----------------------------------------------------
def categories(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    return (c.join(n, c["c_nationkey"] == n["n_nationkey"])
            .join(r, n["n_regionkey"] == r["r_regionkey"])
            .select("c_custkey", F.concat_ws(":", "r_name", "n_name", "c_mktsegment").alias("category")))


CATEGORIES = """categories AS (
 SELECT c_custkey, r_name || ':' || n_name || ':' || c_mktsegment AS category
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


# --- statement files of several layouts --------------------------------------
# layout, ordinal, column, kind of cell
LAYOUTS = [
    (0, 0, "Date", "date"), (0, 1, "Description", "text"), (0, 2, "Out", "out"), (0, 3, "In", "in"),
    (1, 0, "Date", "date"), (1, 1, "Merchant", "text"), (1, 2, "Amount", "amount"),
    (2, 0, "Posting_Date", "date"), (2, 1, "Details", "text"), (2, 2, "Debit", "out"),
    (2, 3, "Credit", "in"),
    (3, 0, "Date", "date"), (3, 1, "Item", "text"), (3, 2, "Cost", "dirty"), (3, 3, "Category", "sparse"),
    (4, 0, "DATE", "date"), (4, 1, "DESCRIPTION", "text"), (4, 2, "AMOUNT", "amount"),
    (5, 0, "When", "date"), (5, 1, "What", "text"), (5, 2, "HowMuch", "amount"),
]
def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("file") % 6
    month = F.format_string("%d-%02d", (F.lit(1995) + F.col("file") % 7).cast("long"),
                            (F.col("file") % 12 + 1).cast("long"))
    name = (F.when(k == 0, F.concat(F.lit("House Kitty Transactions - Cash "), month, F.lit(".csv")))
            .when(k == 1, F.concat(F.lit("visa statement "), month, F.lit(".csv")))
            .when(k == 2, F.concat(F.lit("ledger "), F.col("file").cast("string"), F.lit(".csv")))
            .when(k == 3, F.concat(F.lit("Grocery Expenses "), month, F.lit(".csv")))
            .when(k == 4, F.concat(F.lit("For Automl Statement UNIONBANK Visa "), month, F.lit(".csv")))
            .otherwise(F.concat(F.lit("notes "), F.col("file").cast("string"), F.lit(".csv"))))
    return (table(spark, d, "customer").select(F.col("c_custkey").alias("file"))
            .select("file", k.cast("int").alias("layout"), name.alias("name"),
                    F.when(F.col("file") % 41 == 0, F.lit(None).cast("long"))
                    .when(F.col("file") % 43 == 0, F.lit(0).cast("long"))
                    .otherwise(F.col("file") * 7919 + 100).alias("size")))


FILES = """files AS (
 SELECT file, CAST(file % 6 AS INT) AS layout, CASE file % 6
   WHEN 0 THEN 'House Kitty Transactions - Cash ' || m || '.csv'
   WHEN 1 THEN 'visa statement ' || m || '.csv'
   WHEN 2 THEN 'ledger ' || file || '.csv'
   WHEN 3 THEN 'Grocery Expenses ' || m || '.csv'
   WHEN 4 THEN 'For Automl Statement UNIONBANK Visa ' || m || '.csv'
   ELSE 'notes ' || file || '.csv' END AS name,
  CASE WHEN file % 41 = 0 THEN NULL WHEN file % 43 = 0 THEN 0 ELSE file * 7919 + 100 END AS size
 FROM (SELECT c_custkey AS file, (1995 + c_custkey % 7) || '-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') AS m
       FROM customer))"""


def file_columns(spark: SparkSession, d: str) -> DataFrame:
    per_layout = F.create_map(*[x for k in range(6) for x in (
        F.lit(k), F.lit([c for (lay, _, c, _) in LAYOUTS if lay == k]))])
    return files(spark, d).select("file", F.posexplode(F.element_at(per_layout, F.col("layout")))
                                  .alias("ordinal", "column"))


LAYOUT_SQL = "layouts(layout, ordinal, col, kind) AS (VALUES " + ", ".join(
    f"({a},{b},'{c}','{k}')" for a, b, c, k in LAYOUTS) + ")"
FILE_COLUMNS = FILES + ", " + LAYOUT_SQL + """, file_columns AS (
 SELECT file, ordinal, col AS "column" FROM files JOIN layouts USING (layout))"""


def numbered_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their 0-based position in the customer's file."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "file")
    n = row_ordinals(o, ["file"], [F.year("o_orderdate"), F.col("o_orderdate"), key_block("o_orderkey")], [F.col("o_orderdate"), F.col("o_orderkey")], "row_no")
    return n.withColumn("row_no", F.col("row_no") - 1)


NUMBERED = """numbered AS (
 SELECT *, o_custkey AS file,
  ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS row_no FROM orders)"""


def file_rows(spark: SparkSession, d: str) -> DataFrame:
    """``(file, row_no, cells)`` with each file's own column names."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    layout = F.col("file") % 6
    kinds = {
        "date": F.when((key % 11 == 0) | ((F.col("file") % 13 == 0) & (key % 2 == 0)), "soon")
                 .when(layout % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
                 .otherwise(F.date_format("o_orderdate", "M/d/yyyy")),
        "text": F.when((F.col("file") % 10 == 0) & (key % 3 != 0), None).otherwise(
            F.concat(F.col("o_orderpriority"), F.when(key % 5 == 0, " Grocery")
                     .when(key % 5 == 1, " VISA payment").otherwise(""))),
        "out": F.when(status != "P", price), "in": F.when(status == "P", price),
        "amount": price,
        "dirty": F.when(key % 4 == 0, "abc").otherwise(price),
        "sparse": F.when(key % 2 == 0, status),
    }
    cells = None
    for k in range(6):
        m = F.create_map(*[x for lay, _, c, kind in LAYOUTS if lay == k
                           for x in (F.lit(c), kinds[kind].cast("string"))])
        cells = F.when(layout == k, m) if cells is None else cells.when(layout == k, m)
    return numbered_orders(spark, d).select("file", "row_no", cells.alias("cells"))


FILE_CELLS = FILE_COLUMNS + ", " + NUMBERED + """, file_cells AS (
 SELECT n.file, row_no, ordinal, col AS "column", CASE kind
  WHEN 'date' THEN CASE WHEN o_orderkey % 11 = 0 OR (n.file % 13 = 0 AND o_orderkey % 2 = 0) THEN 'soon'
    WHEN layout % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%-m/%-d/%Y') END
  WHEN 'text' THEN CASE WHEN n.file % 10 = 0 AND o_orderkey % 3 <> 0 THEN NULL ELSE o_orderpriority ||
    CASE WHEN o_orderkey % 5 = 0 THEN ' Grocery' WHEN o_orderkey % 5 = 1 THEN ' VISA payment' ELSE '' END END
  WHEN 'out' THEN CASE WHEN o_orderstatus <> 'P' THEN p END
  WHEN 'in' THEN CASE WHEN o_orderstatus = 'P' THEN p END
  WHEN 'amount' THEN p
  WHEN 'dirty' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'abc' ELSE p END
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END END AS value
 FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM numbered) n
 JOIN files f ON n.file = f.file JOIN layouts USING (layout))"""


# --- statement grids ---------------------------------------------------------
def statement_grid(spark: SparkSession, d: str) -> DataFrame:
    """A 13-row preamble per customer, then one row per order."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    i = F.col("row_no")
    head = c.select(key, "c_name", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("row_no"))
    pre = head.select(
        key.alias("file"), i.cast("long").alias("row_no"),
        F.when(i == 0, "Account Name").when((i == 2) & (key % 3 == 0), "CARD NUMBER")
        .when((i == 4) & (key % 2 == 0), "Statement Balance").when(i == 6, "Payment Due Date").alias("c0"),
        F.when(i == 0, F.col("c_name")).alias("c1"), F.lit(None).cast("string").alias("c2"))
    money = F.format_number("o_totalprice", 2)
    o = F.col("o_orderkey")
    body = numbered_orders(spark, d).select(
        "file", (F.col("row_no") + 13).alias("row_no"),
        F.when(o % 17 == 0, "pending").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("c0"),
        F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("c1"),
        F.when(o % 13 != 0, F.concat(F.lit("PHP "), F.when(F.col("o_orderstatus") == "P", "-").otherwise(""),
                                     money)).alias("c2"))
    return pre.unionByName(body)


STATEMENT_GRID = NUMBERED + """, grid AS (
 SELECT c_custkey AS file, CAST(i AS BIGINT) AS row_no,
  CASE WHEN i = 0 THEN 'Account Name' WHEN i = 2 AND c_custkey % 3 = 0 THEN 'CARD NUMBER'
   WHEN i = 4 AND c_custkey % 2 = 0 THEN 'Statement Balance' WHEN i = 6 THEN 'Payment Due Date' END AS c0,
  CASE WHEN i = 0 THEN c_name END AS c1, NULL AS c2
 FROM customer, range(13) t(i)
 UNION ALL
 SELECT file, row_no + 13, CASE WHEN o_orderkey % 17 = 0 THEN 'pending' ELSE strftime(o_orderdate, '%Y-%m-%d') END,
  '  ' || o_orderpriority || ' ', CASE WHEN o_orderkey % 13 <> 0 THEN 'PHP ' ||
   CASE WHEN o_orderstatus = 'P' THEN '-' ELSE '' END || format('{:,.2f}', o_totalprice) END
 FROM numbered)"""


# --- file names of several kinds ---------------------------------------------
def names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    month = F.date_format("o_orderdate", "yyyy-MM")
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"),
                     F.lpad((k % 240000).cast("string"), 6, "0"))
    stage = F.element_at(F.lit(["input", "predictions", "corrected", "accounting", "training", "draft"]),
                         (k % 6 + 1).cast("int"))
    word = F.element_at(F.lit(["unionbank_visa", "household_cash", "bpi_mastercard", "my bank"]),
                        (F.expr("o_orderkey div 6") % 4 + 1).cast("int"))
    name = (F.when(k % 8 < 3, F.concat_ws("_", word, month, stage, F.concat(stamp, F.lit(".csv"))))
            .when(k % 8 == 3, F.concat_ws("_", word, stage, F.concat(stamp, F.lit(".csv"))))
            .when(k % 8 == 4, F.concat(F.lit("House Kitty Transactions - Cash "), month, F.lit(".csv")))
            .when(k % 8 == 5, F.concat(F.lit("For Automl Statement Some Bank Visa "), month, F.lit(".csv")))
            .when(k % 8 == 6, F.concat(F.lit("corrected_job_file_1_"), stamp, F.lit("_005042.csv")))
            .otherwise(F.concat(F.lit("file_"), k.cast("string"), F.lit("_"), stamp,
                                F.lit("_BPI Mastercard "), month, F.lit("x.CSV"))))
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate", name.alias("name"))


NAMES = """names AS (
 SELECT o_orderkey, o_orderdate, CASE
  WHEN k % 8 < 3 THEN word || '_' || month || '_' || stage || '_' || stamp || '.csv'
  WHEN k % 8 = 3 THEN word || '_' || stage || '_' || stamp || '.csv'
  WHEN k % 8 = 4 THEN 'House Kitty Transactions - Cash ' || month || '.csv'
  WHEN k % 8 = 5 THEN 'For Automl Statement Some Bank Visa ' || month || '.csv'
  WHEN k % 8 = 6 THEN 'corrected_job_file_1_' || stamp || '_005042.csv'
  ELSE 'file_' || k || '_' || stamp || '_BPI Mastercard ' || month || 'x.CSV' END AS name
 FROM (SELECT o_orderkey, o_orderdate, o_orderkey AS k, strftime(o_orderdate, '%Y-%m') AS month,
  strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey % 240000 AS VARCHAR), 6, '0') AS stamp,
  ['input','predictions','corrected','accounting','training','draft'][o_orderkey % 6 + 1] AS stage,
  ['unionbank_visa','household_cash','bpi_mastercard','my bank'][(o_orderkey // 6) % 4 + 1] AS word
  FROM orders))"""


# --- model registry events ---------------------------------------------------
COMPONENTS = ["tfidf_vectorizer", "label_encoder", "logistic", "forest", "bayes"]


def registry_events(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    comp = F.element_at(F.lit(COMPONENTS), (k % 5 + 1).cast("int"))
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    model = F.concat_ws("_", source_by("p_partkey"), comp)
    # bayes of the card source is never registered
    return table(spark, d, "part").where((k % 10) != 9).select(
        model.alias("model"), F.col("p_size").alias("version"),
        F.create_map(F.lit("local"), F.concat_ws("/", F.lit("models"), model, F.col("p_size").cast("string")))
        .alias("locations"),
        F.create_map(F.lit("macro_f1"), (cents % 1000) / 1000.0,
                     F.lit("accuracy"), F.expr("(cast(round(p_retailprice * 100) as bigint) div 3) % 1000")
                     / 1000.0).alias("metrics"),
        F.col("p_name").alias("training_data"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 900).cast("int")).cast("timestamp").alias("ts"),
        F.lit("active").alias("status"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("extra"),
        k.alias("seq"))


REGISTRY = """registry AS (
 SELECT model, version, 'models/' || model || '/' || version AS location,
  (cents % 1000) / 1000.0::DOUBLE AS macro_f1, ((cents // 3) % 1000) / 1000.0::DOUBLE AS accuracy,
  p_name AS training_data, DATE '2024-01-01' + CAST(p_partkey % 900 AS INT) AS ts, 'active' AS status,
  p_brand AS brand, p_partkey AS seq
 FROM (SELECT *, CAST(ROUND(p_retailprice * 100) AS BIGINT) AS cents, p_size AS version,
  CASE WHEN p_partkey % 2 = 0 THEN 'household' ELSE 'credit_card' END || '_' ||
  ['tfidf_vectorizer','label_encoder','logistic','forest','bayes'][p_partkey % 5 + 1] AS model
  FROM part WHERE p_partkey % 10 <> 9)),
entries AS (
 SELECT * EXCLUDE (k) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY model, version ORDER BY seq DESC) AS k
  FROM registry) WHERE k = 1)"""


# --- training rows -----------------------------------------------------------
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Orders as an existing versioned training set."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    paid_in = F.col("o_orderstatus") == "P"
    return table(spark, d, "orders").select(
        k.alias("row_key"), F.col("o_orderdate").cast("date").alias("Date"),
        F.col("o_orderpriority").alias("Description"),
        F.when(paid_in, zero).otherwise(price).cast("decimal(18,2)").alias("Amount (Negated)"),
        F.when(paid_in, price).otherwise(zero).cast("decimal(18,2)").alias("Amount"),
        pick(F.col("o_custkey") % 5).alias("Category"), source_by("o_orderkey").alias("transaction_source"),
        F.lit("Assets:Bank").alias("Account"),
        F.when(paid_in, price).otherwise(zero).cast("decimal(18,2)").alias("Amount (Raw)"),
        F.lit(True).alias("Entered"), (k % 3 == 0).alias("Reconciled"),
        F.lit(None).cast("timestamp").alias("correction_timestamp"),
        F.lit(None).cast("string").alias("source_model_version"),
        (k % 4 + 1).cast("int").alias("training_version"))


TRAINING = f"""training AS (
 SELECT o_orderkey AS row_key, CAST(o_orderdate AS DATE) AS txn_date, o_orderpriority AS description,
  CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount_out,
  CASE WHEN o_orderstatus = 'P' THEN CAST(o_totalprice AS DECIMAL(18,2)) ELSE 0 END AS amount_in,
  {SQL_LABELS}[o_custkey % 5 + 1] AS category,
  CASE WHEN o_orderkey % 2 = 0 THEN 'household' ELSE 'credit_card' END AS transaction_source,
  'Assets:Bank' AS account, o_orderkey % 3 = 0 AS reconciled,
  CAST(o_orderkey % 4 + 1 AS INT) AS training_version
 FROM orders)"""


def corrected_file(spark: SparkSession, d: str) -> DataFrame:
    """A corrected stage with spreadsheet names and text amounts."""
    p = predictions(spark, d)
    return p.select(
        F.col("txn_id").alias("row_key"), F.date_format("txn_date", "yyyy-MM-dd").alias("DATE"),
        F.when(F.col("txn_id") % 500 == 3, "ab").otherwise(F.col("description")).alias("DESCRIPTION"),
        F.when(F.col("txn_id") % 40 == 1, "n/a").otherwise(F.col("amount_out").cast("string")).alias("DEBIT"),
        F.col("amount_in").cast("string").alias("CREDIT"),
        F.coalesce("predicted_category", F.lit("Expenses:Unsorted")).alias("predicted_category"),
        "confidence", "transaction_source")


CORRECTED_FILE = PREDICTIONS + """, corrected_file AS (
 SELECT txn_id AS row_key, txn_date,
  CASE WHEN txn_id % 500 = 3 THEN 'ab' ELSE description END AS description,
  CASE WHEN txn_id % 40 = 1 THEN NULL ELSE amount_out END AS amount_out, amount_in,
  COALESCE(predicted_category, 'Expenses:Unsorted') AS category, confidence, transaction_source
 FROM predictions)"""
