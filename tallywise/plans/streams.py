"""File-drop ingest and the rolling quality monitor as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallywise.constants import UPLOAD_MAX_BYTES
from tallywise.functions.dates import lenient_date
from tallywise.functions.money import lenient_money, split_signed
from tallywise.functions.text import normal_description
from tallywise.operators import metrics as mt, models as ml
from tallywise.operators.ordered import positions
from tallywise.plans import bindings as b
from tallywise.plans.catalog import query, r6, text_of_map
from tallywise.session import materialise, scratch_path
from tallywise.sources import sinks
from tallywise.streaming import inbox as drop, ingest, monitor


FILE_BYTES = UPLOAD_MAX_BYTES // 2  # of the rows in one inbox file


def drop_files(spark, d):
    """Statement CSV files written to a fresh inbox."""
    inbox = scratch_path(spark, "inbox")
    rows = b.ledger(spark, d).select(
        "txn_id", F.date_format("txn_date", "M/d/yyyy").alias("Date"), F.concat(F.col("description"), F.lit(" ")).alias("Description"),
        F.when(F.col("txn_id") % 60 == 0, "n/a").otherwise(F.col("signed").cast("string")).alias("Amount"), "transaction_source")
    sinks.write_csv(rows.repartition(4, "txn_id"), inbox)
    return inbox


def clean(batch):
    out, inn = split_signed(lenient_money(F.col("Amount")))
    return batch.select("txn_id", lenient_date(F.col("Date")).alias("txn_date"), normal_description(F.col("Description")).alias("description"),
                        out.alias("amount_out"), inn.alias("amount_in"), "transaction_source",
                        lenient_money(F.col("Amount")).isNull().alias("bad_amount"))


@query("l01_file_drop_ingest", f"""WITH {b.LEDGER} SELECT txn_id, strftime(txn_date, '%Y-%m-%d') AS txn_date, description,
 CASE WHEN txn_id % 60 = 0 THEN 0 ELSE amount_out END AS amount_out, CASE WHEN txn_id % 60 = 0 THEN 0 ELSE amount_in END AS amount_in, transaction_source, txn_id % 60 = 0 AS bad_amount FROM ledger""")
def file_drop_ingest(spark, d):
    inbox, results = drop_files(spark, d), scratch_path(spark, "results")
    q = ingest.run_file_drop(spark, inbox, results, scratch_path(spark, "checkpoint"), clean)
    q.awaitTermination()
    return spark.read.parquet(results).drop("batch")


@query("l01_file_drop_predict")
def file_drop_predict(spark, d):
    led = b.ledger(spark, d).select("txn_id", "description", F.col("event_type").alias("label"))
    rows = materialise(spark, ml.prepare(led, "txn_id", "description", "label"), "prepared")
    fitted = ml.train(rows, "description", "label")
    inbox, results = drop_files(spark, d), scratch_path(spark, "results")
    q = ingest.run_file_drop(spark, inbox, results, scratch_path(spark, "checkpoint"),
                             lambda batch: ml.predict(clean(batch), "description", fitted))
    q.awaitTermination()
    return spark.read.parquet(results).select("txn_id", "transaction_source", "predicted_category", r6(F.col("confidence")).alias("confidence"))


def mixed_inbox(spark, d):
    """Orders as files of three layouts, of columns nobody knows, and of a kind that isn't admitted."""
    path = scratch_path(spark, "inbox")
    key, money = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    credit = F.col("o_orderstatus") == "P"
    what = F.concat(F.lit('"'), F.element_at(F.split("o_orderpriority", "-"), -1), F.lit(', grocery and rent"'))
    date = F.when(key % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    comma = F.format_number("o_totalprice", 2)
    body = {
        0: F.concat_ws(",", date, what, F.when(credit, "").otherwise(money), F.when(credit, money).otherwise("")),
        1: F.concat(F.when(credit, "-").otherwise(""), money, F.lit(","), what, F.lit(",4321,"), date),
        2: F.concat(date, F.lit(","), what, F.lit(',"PHP '), F.when(credit, "-").otherwise(""), comma, F.lit('"')),
        3: F.concat_ws(",", date, what, money), 4: F.concat_ws(",", date, what, money)}
    heads = {0: "Date,Item,Out,In", 1: "Amount,Merchant,Card,Posting_Date",
             2: "Account Name,x|,|Card Number,1|,|,|,|Statement Balance,3|,|Payment Due Date,2025-02-01|,|,|,|Date,What,How much",
             3: "When,What,Much", 4: "When,What,Much"}
    o = b.table(spark, d, "orders").withColumn("layout", (key % 10).cast("int")).where("layout < 6")
    o = o.withColumn("layout", F.when(F.col("layout") == 5, 0).otherwise(F.col("layout")))
    lines = o.select("layout", key.alias("k"), F.coalesce(*[F.when(F.col("layout") == k, c) for k, c in body.items()]).alias("value"))
    first = spark.createDataFrame([(k, i - 99, line) for k, head in heads.items() for i, line in enumerate(head.split("|"))],
                                  "layout int, k long, value string")
    # a layout goes on in another file of the same head before one is too large to be admitted
    placed = positions(lines, [F.col("layout"), F.col("k")], "at")
    sizes = placed.groupBy("layout").agg(F.min("at").alias("start"), (F.max(F.octet_length("value")) + 1).alias("width"))
    per_file = F.greatest(F.floor(F.lit(FILE_BYTES) / F.col("width")), F.lit(1))
    body_lines = placed.join(F.broadcast(sizes), "layout").select(
        "layout", F.floor((F.col("at") - F.col("start")) / per_file).alias("file"), "k", "value")
    cut = materialise(spark, body_lines, "lines")
    parts = cut.select("layout", "file").union(spark.createDataFrame([(k, 0) for k in heads], "layout int, file long")).distinct()
    sorted_ = (cut.union(parts.join(F.broadcast(first), "layout").select("layout", "file", "k", "value"))
               .repartition("layout", "file").sortWithinPartitions("layout", "file", "k").select("layout", "file", "value"))
    # whole lines as they are
    sorted_.where("layout < 4").write.partitionBy("layout", "file").options(sep="\u0001", quote="\u0000").csv(path)
    sorted_.where("layout = 4").write.mode("append").partitionBy("layout", "file").json(path)
    return path


def rule_of_thumb(rows):
    """A stand-in for trained models, which SQL can follow."""
    return rows.withColumns({"predicted_category": F.lower(F.substring_index("description", ",", 1)),
                             "confidence": F.when(F.col("amount_in") > 0, 0.4).otherwise(0.9)})


def inbox_results(spark, d):
    out = scratch_path(spark, "drop")
    drop.run_inbox(spark, mixed_inbox(spark, d), out, scratch_path(spark, "checkpoint"), rule_of_thumb).awaitTermination()
    return out


INBOX = r"""WITH o AS (SELECT *, CASE WHEN o_orderkey % 10 = 5 THEN 0 ELSE o_orderkey % 10 END AS layout,
  CAST(o_totalprice AS DECIMAL(18, 2)) AS p, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS word FROM orders WHERE o_orderkey % 10 < 6),
n AS (SELECT layout, COUNT(*) AS n FROM o GROUP BY 1)"""


@query("l01_inbox_stage", INBOX + """ SELECT layout, CASE WHEN layout = 0 THEN 'household' ELSE 'credit_card' END AS source, strftime(o_orderdate, '%Y-%m') AS period,
 'predictions' AS stage, strftime(o_orderdate, '%Y-%m-%d') AS txn_date, trim(word || ', grocery and rent') AS description,
 CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE p END AS DOUBLE) AS amount_out, CAST(CASE WHEN o_orderstatus = 'P' THEN p ELSE 0 END AS DOUBLE) AS amount_in,
 lower(word) AS predicted_category, CASE WHEN o_orderstatus = 'P' THEN 0.4::DOUBLE ELSE 0.9::DOUBLE END AS confidence
FROM o WHERE layout < 3 AND o_orderkey % 7 <> 0""")
def inbox_stage(spark, d):
    t = drop.read_table(spark, inbox_results(spark, d), "stage")
    return t.select(F.regexp_extract("file", r"layout=(\d)", 1).cast("long").alias("layout"), "source", F.col("period").cast("string").alias("period"),
                    "stage", "txn_date", "description", "amount_out", "amount_in", "predicted_category", "confidence")


@query("l01_inbox_files", INBOX + """, v AS (SELECT layout, n, CASE layout WHEN 0 THEN 'accepted' WHEN 1 THEN 'accepted' WHEN 2 THEN 'accepted' ELSE 'rejected' END AS status FROM n)
SELECT layout, status, CASE WHEN layout < 4 THEN n ELSE 0 END AS row_count, CASE layout WHEN 0 THEN 'household' WHEN 1 THEN 'credit_card' WHEN 2 THEN 'credit_card' WHEN 3 THEN 'credit_card' END AS source,
 CASE layout WHEN 0 THEN 'amount=out_in_pair;amount_in=In;amount_out=Out;date=Date;description=Item' WHEN 1 THEN 'amount=Amount;date=Posting_Date;description=Merchant' WHEN 3 THEN '' END AS detected,
 CASE layout WHEN 3 THEN 'missing columns: date, description, amount' WHEN 4 THEN 'unknown extension' ELSE '' END AS issues FROM v""")
def inbox_files(spark, d):
    t = drop.read_table(spark, inbox_results(spark, d), "files")
    found = t.where("name not like '%.crc' and name <> '_SUCCESS'").select(
        F.regexp_extract("file", r"layout=(\d)", 1).cast("long").alias("layout"), "status", "row_count", "source",
        F.when(F.col("layout") == "table", text_of_map(F.coalesce("detected_columns", F.create_map().cast("map<string,string>")))).alias("detected"),
        F.array_join("issues", "|").alias("issues"))
    # a layout of many rows has several files
    return found.groupBy("layout", "status", "source", "detected", "issues").agg(F.sum("row_count").alias("row_count")).select(*found.columns)


DAILY = f"""WITH {b.PREDICTIONS}, m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, transaction_source, COUNT(*) AS batch_size, AVG(CAST(confidence AS DECIMAL(18, 12))) AS mean, STDDEV_SAMP(confidence) AS std,
 AVG(CASE WHEN confidence < 0.5 THEN 1.0 ELSE 0.0 END) AS low_confidence_rate, COUNT(*) FILTER (confidence < 0.5) AS low_rows, MEDIAN(confidence) AS median
 FROM predictions GROUP BY ALL)"""


def daily(spark, d):
    src, results = scratch_path(spark, "log"), scratch_path(spark, "daily")
    p = b.predictions(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "transaction_source", "confidence")
    p.write.parquet(src)
    q = monitor.run_daily_quality(spark.readStream.schema(p.schema).parquet(src), results, scratch_path(spark, "checkpoint"))
    q.awaitTermination()
    return monitor.daily_quality(monitor.latest_counts(spark, results))


@query("l02_daily_quality_stream", DAILY + """ SELECT day, transaction_source, batch_size, low_rows, ROUND(mean, 6) AS mean, ROUND(std, 6) AS std,
 ROUND(low_confidence_rate, 6) AS low_confidence_rate, ROUND(median, 6) AS median FROM m""")
def daily_stream(spark, d):
    t = daily(spark, d)
    return t.withColumns({n: r6(F.col(n)) for n in ("mean", "std", "low_confidence_rate", "median")})


@query("l02_daily_alerts_stream", DAILY + """ SELECT day || ' ' || transaction_source AS batch, 'high_low_confidence_rate' AS alert, ROUND(low_confidence_rate, 6) AS value FROM m WHERE low_confidence_rate > 0.2
UNION ALL SELECT day || ' ' || transaction_source, 'low_mean_confidence', ROUND(mean, 6) FROM m WHERE mean < 0.6""")
def daily_alerts(spark, d):
    t = daily(spark, d).withColumn("batch", F.concat_ws(" ", "day", "transaction_source"))
    return mt.quality_alerts(t, "batch").withColumn("value", r6(F.col("value")))
