"""Scans and sinks: files are written from the tables, then read back."""

from __future__ import annotations

from math import ceil

from pyspark.sql import functions as F

from tallywise.functions import filenames as fn
from tallywise.functions.money import lenient_money
from tallywise.operators import detect, metrics as mt, registry as reg, training as tr
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6, text_of_map
from tallywise.session import materialise, scratch_path
from tallywise.sources import files, grids, sinks


@query("a01_csv_scan", f"""WITH {b.PREDICTIONS} SELECT txn_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, amount_out,
 nullif(predicted_category, '') AS category FROM predictions""")
def csv_scan(spark, d):
    path = scratch_path(spark, "csv")
    p = b.predictions(spark, d)
    sinks.write_csv(p.select("txn_id", F.date_format("txn_date", "yyyy-MM-dd").alias("Date"),
                             F.concat("description", F.lit(", x")).alias("Description"),
                             F.col("amount_out").cast("string").alias("Out"),
                             F.col("predicted_category").alias("Category")), path)
    raw = files.scan_csv(spark, path)
    return raw.select(F.col("txn_id").cast("long").alias("txn_id"), F.col("Date").alias("txn_date"),
                      F.regexp_replace("Description", ", x$", "").alias("description"),
                      lenient_money(F.col("Out")).alias("amount_out"), F.col("Category").alias("category"))


@query("a01_grid_scan", """WITH o AS (SELECT *, o_orderkey % 4 AS part, ROW_NUMBER() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) - 1 AS row_no FROM orders)
SELECT part, row_no, CAST(o_orderkey AS VARCHAR) AS c0, o_orderpriority AS c1 FROM o""")
def grid_scan(spark, d):
    path = scratch_path(spark, "grid")
    o = b.table(spark, d, "orders").withColumn("part", F.col("o_orderkey") % 4)
    (o.repartition(4, "part").sortWithinPartitions("part", "o_orderkey")
     .select("part", F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority")
     .write.partitionBy("part").csv(path))
    g = files.scan_grid(spark, f"{path}/part=*")
    return g.select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "row_no",
                    F.get("cells", F.lit(0)).alias("c0"), F.get("cells", F.lit(1)).alias("c1"))


ROWS_PER_FILE = 250_000


def statement_files(spark, d, rows_per_file=None):
    """One file per order priority, or of about ``rows_per_file`` rows each: blank lines, a preamble, 20 columns, repeated and empty header names, notes of two lines."""
    path = scratch_path(spark, "wide")
    key, part = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    note = F.concat(F.lit('"first ""'), key.cast("string"), F.lit('"",\nsecond"'))
    row = F.array_join(F.concat(F.array(key.cast("string"), F.when(key % 3 == 0, note).otherwise("plain"), F.col("o_totalprice").cast("string")),
                                F.array_repeat(F.lit("x"), 16), F.array(F.col("o_orderstatus"))), ",")
    blank = F.when(key % 5 == 0, F.lit("\n")).otherwise("")
    orders = b.table(spark, d, "orders")
    pieces = max(1, ceil(orders.count() / (5 * rows_per_file))) if rows_per_file else 1
    rows = orders.select(part.alias("part"), F.pmod(F.xxhash64(key), F.lit(pieces)).alias("piece"), key.alias("k"), F.concat(row, blank).alias("value"))
    head = F.lit("\n\nkey,note,amount," + "x," * 15 + ",status")
    heads = rows.select("part", "piece").distinct().select("part", "piece", F.lit(-1).cast("long").alias("k"), head.alias("value"))
    (rows.union(heads).repartition("part", "piece").sortWithinPartitions("part", "piece", "k").select("part", "piece", "value")
     .write.partitionBy("part", "piece").text(path))
    return f"{path}/part=*/piece=*"


@query("a01_wide_grid", r"""WITH o AS (SELECT *, substr(o_orderpriority, 1, 1) AS part, 1 + CAST(o_orderkey % 3 = 0 AS BIGINT) + CAST(o_orderkey % 5 = 0 AS BIGINT) AS n_lines FROM orders)
SELECT part, 3 + SUM(n_lines) OVER (PARTITION BY part ORDER BY o_orderkey) - n_lines AS line, CAST(o_orderkey AS VARCHAR) AS key,
 CASE WHEN o_orderkey % 3 = 0 THEN 'first "' || o_orderkey || '",' || chr(10) || 'second' ELSE 'plain' END AS note, 20 AS width, o_orderstatus AS last FROM o""")
def wide_grid(spark, d):
    g = files.scan_grid(spark, statement_files(spark, d)).where("row_no > 2")
    return g.select(F.regexp_extract("file", r"part=(\d+)", 1).alias("part"), F.col("row_no").alias("line"), F.get("cells", F.lit(0)).alias("key"),
                    F.get("cells", F.lit(1)).alias("note"), F.size("cells").alias("width"), F.get("cells", F.lit(19)).alias("last"))


@query("a01_named_cells", r"""SELECT substr(o_orderpriority, 1, 1) AS part, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, 'x|x|x' AS xs, 20 AS n_names FROM orders""")
def named_cells(spark, d):
    # heads and bodies both read the grid, so it is cut into cells once
    rows = grids.body_cells(materialise(spark, files.scan_grid(spark, statement_files(spark, d, ROWS_PER_FILE)), "grid"))
    cell = lambda n: F.element_at("cells", F.lit(n))
    return rows.select(F.regexp_extract("file", r"part=(\d+)", 1).alias("part"), cell("key").alias("key"), cell("status").alias("status"),
                       F.concat_ws("|", cell("x"), cell("x.14"), cell("Unnamed: 18")).alias("xs"), F.size("cells").alias("n_names"))


@query("a01_mixed_columns", """SELECT o_orderkey % 3 AS layout, CAST(o_orderkey AS VARCHAR) AS "Key", strftime(o_orderdate, '%Y-%m-%d') AS "Date",
 CASE WHEN o_orderkey % 3 <> 2 THEN o_orderstatus END AS "Status" FROM orders""")
def mixed_columns(spark, d):
    path = scratch_path(spark, "mixed")
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("Key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"),
                                           F.col("o_orderstatus").alias("Status"), (F.col("o_orderkey") % 3).alias("layout"))
    for k, names in enumerate((["Key", "Date", "Status"], ["Status", "Key", "Date"], ["Date", "Key"])):
        sinks.write_csv(o.where(F.col("layout") == k).select(*names), f"{path}/layout={k}")
    rows = files.scan_csv(spark, f"{path}/layout=*")
    return rows.select(F.regexp_extract("file", r"layout=(\d+)", 1).cast("long").alias("layout"), "Key", "Date", "Status")


def statement_grid(spark, d):
    return b.statement_grid(spark, d).select("file", "row_no", F.array("c0", "c1", "c2").alias("cells"))


@query("a02_statement_rows", f"""WITH {b.STATEMENT_GRID} SELECT file, row_no, c0 AS date, c1 AS description, c2 AS amount FROM grid WHERE row_no >= 13""")
def statement_rows(spark, d):
    return grids.statement_rows(statement_grid(spark, d))


@query("a02_normalise_statement", f"""WITH {b.STATEMENT_GRID} SELECT file, row_no, c0 AS date, trim(c1) AS description, CAST(replace(replace(c2, 'PHP ', ''), ',', '') AS DOUBLE) AS amount
FROM grid WHERE row_no >= 13 AND c0 <> 'pending' AND c1 IS NOT NULL AND c2 IS NOT NULL""")
def normalise_statement(spark, d):
    return grids.normalise_statement(statement_grid(spark, d))


@query("a03_statement_layout", f"""WITH {b.STATEMENT_GRID}, t AS (SELECT file, string_agg(upper(COALESCE(c0,'') || ' ' || COALESCE(c1,'') || ' ' || COALESCE(c2,'')), chr(10)) AS t
 FROM grid WHERE row_no < 16 GROUP BY 1), m AS (SELECT file, contains(t, 'ACCOUNT NAME')::BIGINT + contains(t, 'CARD NUMBER')::BIGINT + contains(t, 'STATEMENT BALANCE')::BIGINT
 + contains(t, 'PAYMENT DUE DATE')::BIGINT + contains(t, 'TOTAL AMOUNT DUE')::BIGINT AS markers FROM t)
SELECT file, markers, markers >= 3 AS is_statement FROM m""")
def statement_layout(spark, d):
    return detect.statement_layout(statement_grid(spark, d))


@query("a04_generic_grid", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS description,
 CAST(CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS DOUBLE) AS amount FROM orders WHERE o_orderkey % 9 <> 0""")
def generic_grid(spark, d):
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    o = b.table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "M/d/yyyy").alias("Posting_Date"), F.lit("x").alias("Branch"),
        F.concat(F.lit(" "), "o_orderpriority").alias("Merchant"),
        F.when(F.col("o_orderkey") % 9 == 0, "n/a").when(F.col("o_orderstatus") == "P", F.concat(F.lit("("), money, F.lit(")")))
        .otherwise(money).alias("Total"))
    # no amount name matches, so the last column is taken
    return grids.normalise_grid(o, ["o_orderkey"])


def manifest_files(spark, d):
    """Manifest rows from the file names, with sizes and times."""
    n = b.names(spark, d)
    return n.select(F.col("o_orderkey").alias("file"), F.concat(F.lit("/in/"), "name").alias("path"), "name",
                    (F.col("o_orderkey") * 7919 % 20000000).alias("size"), F.col("o_orderdate").alias("modified"))


MANIFEST = b.NAMES + """, manifest AS (SELECT o_orderkey AS file, '/in/' || name AS path, name, o_orderkey * 7919 % 20000000 AS size, o_orderdate AS modified FROM names)"""


@query("a05_top_files", f"""WITH {MANIFEST} (SELECT 'time' AS kind, path, size FROM manifest ORDER BY modified DESC, path, size LIMIT 20)
UNION ALL (SELECT 'name', path, size FROM manifest ORDER BY lower(name), path, size LIMIT 20)
UNION ALL (SELECT 'size', path, size FROM manifest ORDER BY size DESC, path, size LIMIT 20)""")
def top_files(spark, d):
    m = manifest_files(spark, d)
    pick = lambda kind, by: files.top_files(m, by).select(F.lit(kind).alias("kind"), "path", "size")
    return pick("time", "modified_date").union(pick("name", "name")).union(pick("size", "size"))


@query("a05_manifest", """SELECT CAST(o_orderkey % 4 AS BIGINT) AS part, COUNT(*) AS n_rows FROM orders GROUP BY 1""")
def manifest(spark, d):
    path = scratch_path(spark, "manifest")
    o = b.table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("part"), F.lit("12345678").alias("v"))
    o.repartition(4, "part").write.partitionBy("part").csv(path)
    m = files.manifest(spark, [path], "*.csv")
    part = F.regexp_extract("directory", r"part=(\d+)", 1).cast("long")
    # every row is eight digits and a line end
    return m.groupBy(part.alias("part")).agg((F.sum("size") / 9).cast("long").alias("n_rows"))


@query("d18_upload_admission", f"""WITH {MANIFEST} SELECT file, size, size <= 10485760 AND regexp_matches(lower(name), '\\.(csv|xlsx|xls)$') AS admitted
FROM (SELECT file, size, CASE WHEN file % 5 = 0 THEN replace(name, '.csv', '.pdf') ELSE name END AS name FROM manifest)""")
def upload_admission(spark, d):
    m = manifest_files(spark, d).withColumn("name", F.when(
        F.col("file") % 5 == 0, F.replace("name", F.lit(".csv"), F.lit(".pdf"))).otherwise(F.col("name")))
    return files.admitted(m).select("file", "size", "admitted")


@query("a06_latest_training_file", """WITH t AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'household' ELSE 'credit_card' END AS s, p_size AS v, p_partkey FROM part WHERE p_partkey % 7 <> 0)
SELECT s AS transaction_source, MAX(v) AS version FROM t GROUP BY 1""")
def latest_training_file(spark, d):
    p = b.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 7 == 0, "notes_v99.csv").otherwise(F.concat(
        F.lit("training_data_"), b.source_by("p_partkey"), F.lit("_v"), F.col("p_size").cast("string"), F.lit("_20250101.csv")))
    return files.latest_training(p.select(name.alias("name"))).select("transaction_source", "version")


@query("a07_dictionary_scan", f"WITH {b.CATEGORIES} SELECT DISTINCT category FROM categories")
def dictionary_scan(spark, d):
    path = scratch_path(spark, "dictionary")
    lines = b.categories(spark, d).select(F.when(F.col("c_custkey") % 9 == 0, "  ").otherwise(
        F.concat(F.lit(" "), "category", F.lit("  "))).alias("value"))
    lines.union(b.categories(spark, d).select("category")).write.text(path)
    return files.scan_dictionary(spark, path)


@query("a09_registry_scan", """SELECT DISTINCT p_brand AS model, p_size AS version, 'x' AS status, ROUND(MAX(p_retailprice), 6) AS macro_f1 FROM part GROUP BY ALL""")
def registry_scan(spark, d):
    path = scratch_path(spark, "registry")
    e = b.table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.max("p_retailprice").alias("m"))
    entry = F.struct(F.create_map(F.lit("local"), F.lit("x")).alias("locations"),
                     F.create_map(F.lit("macro_f1"), F.col("m")).alias("metrics"), F.lit("t").alias("training_data"),
                     F.lit("2025-01-01T00:00:00").alias("timestamp"), F.lit("x").alias("status"))
    # one registry document per entry
    doc = F.create_map(F.col("p_brand"), F.create_map(F.col("p_size").cast("string"), entry))
    e.select(F.to_json(F.struct(doc.alias("models"))).alias("value")).write.text(path)
    r = files.scan_registry(spark, path, one_per_file=False)
    return r.select("model", "version", "status", r6(F.element_at("metrics", F.lit("macro_f1"))).alias("macro_f1"))


LOG = f"""WITH {b.PREDICTIONS}, s AS (SELECT event_type, COUNT(*) AS batch_size, ROUND(AVG(confidence), 6) AS mean, ROUND(MEDIAN(confidence), 6) AS median FROM predictions GROUP BY 1),
c AS (SELECT event_type, predicted_category, COUNT(*) AS n FROM predictions WHERE predicted_category IS NOT NULL GROUP BY ALL)
SELECT batch_size, mean, median, (SELECT string_agg(predicted_category || '=' || n, ';' ORDER BY predicted_category) FROM c WHERE c.event_type = s.event_type) AS distribution FROM s"""


@query("a10_b02_metrics_log", LOG)
def metrics_log(spark, d):
    path = scratch_path(spark, "metrics")
    log = mt.metrics_log(b.predictions(spark, d), "event_type", "predicted_category", F.lit("2025-01-01").cast("timestamp"))
    first, rest = log.where("event_type = 'click'"), log.where("event_type <> 'click'")
    for part in (first, rest):
        sinks.append_metrics(part.drop("event_type"), path)
    back = files.scan_metrics_log(spark, path)
    return back.select("batch_size", r6(F.col("confidence_stats.mean")).alias("mean"), r6(F.col("confidence_stats.median")).alias("median"),
                       text_of_map(F.col("category_distribution")).alias("distribution"))


@query("b01_stage_write", f"""WITH {b.PREDICTIONS} SELECT txn_id, transaction_source AS source, strftime(txn_date, '%Y-%m') AS period, 'predictions' AS stage,
 predicted_category, ROUND(confidence, 6) AS confidence FROM predictions""")
def stage_write(spark, d):
    path = scratch_path(spark, "stages")
    p = b.predictions(spark, d).select("txn_id", F.col("transaction_source").alias("source"), F.date_format("txn_date", "yyyy-MM").alias("period"),
                                       F.lit("predictions").alias("stage"), "predicted_category", "confidence")
    sinks.write_stage(p, path)
    return spark.read.schema(p.schema).parquet(path).withColumn("confidence", r6(F.col("confidence"))).select(
        "txn_id", "source", "period", "stage", "predicted_category", "confidence")


@query("b03_training_write", f"""WITH {b.TRAINING} SELECT transaction_source, training_version, COUNT(*) AS n_rows, CAST(SUM(amount_in) AS DOUBLE) AS total FROM training
 WHERE transaction_source = 'household' AND training_version <= 3 GROUP BY ALL""")
def training_write(spark, d):
    path = scratch_path(spark, "training")
    rows = b.training_rows(spark, d)
    sinks.write_training(rows, path)
    back = spark.read.schema(rows.schema).parquet(path)
    return tr.training_at(back, "household", 3).groupBy("transaction_source", "training_version").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("Amount").alias("total"))


@query("b03_training_readback", f"""WITH {b.TRAINING} SELECT row_key, strftime(txn_date, '%Y-%m-%d') AS txn_date, description, amount_out, amount_in, category, transaction_source,
 training_version FROM training""")
def training_readback(spark, d):
    """Every row of the written training set, types and versions included."""
    path, rows = scratch_path(spark, "training"), b.training_rows(spark, d)
    sinks.write_training(rows, path)
    return spark.read.schema(rows.schema).parquet(path).select(
        "row_key", F.col("Date").alias("txn_date"), F.col("Description").alias("description"), F.col("Amount (Negated)").alias("amount_out"),
        F.col("Amount").alias("amount_in"), F.col("Category").alias("category"), "transaction_source", "training_version")


@query("b04_registry_write", f"WITH {b.REGISTRY} SELECT model, version, training_data, status FROM entries")
def registry_write(spark, d):
    path = scratch_path(spark, "events")
    ev = b.registry_events(spark, d)
    done = reg.register(ev.drop("ts", "status"), F.lit("2025-01-01").cast("timestamp"), F.col("seq")).select(*ev.columns)
    for k in (0, 1):
        sinks.append_registry(done.where(F.col("seq") % 2 == k), path)
    return reg.current_entries(spark.read.schema(ev.schema).parquet(path)).select("model", "version", "training_data", "status")


@query("b05_dictionary_write", f"WITH {b.CATEGORIES} SELECT DISTINCT category FROM categories")
def dictionary_write(spark, d):
    path = scratch_path(spark, "sorted")
    sinks.write_dictionary(b.categories(spark, d).select("category").distinct(), path)
    return spark.read.text(path).withColumnRenamed("value", "category")


@query("l01_j13_predictions_name", f"""SELECT o_orderkey, 'household_cash_' || strftime(o_orderdate, '%Y-%m') || '_predictions_20250101_000000.csv' AS name FROM orders""")
def predictions_name(spark, d):
    original = F.concat(F.lit("House Kitty Transactions - Cash "), F.date_format("o_orderdate", "yyyy-MM"), F.lit(".csv"))
    return b.table(spark, d, "orders").select("o_orderkey", fn.build_name(
        fn.source_of(original), fn.period_of(original), F.lit("predictions"), F.lit("20250101_000000")).alias("name"))
