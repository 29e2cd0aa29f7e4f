"""File drop end to end: new files to verdicts, typed rows, predictions, metrics and a batch ledger.

The stream reads a listing of the inbox; contents are scanned per micro-batch
with true line numbers and cells by name. Each micro-batch writes its tables
under its own number, replacing what an interrupted attempt left, and a ledger
entry last. Only batches in the ledger are read, and one that is in it is never
done again, so a repeated batch changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywise.constants import CREDIT_CARD, UPLOAD_EXTENSIONS
from tallywise.functions.dates import lenient_date
from tallywise.functions.filenames import base_name, extension
from tallywise.functions.money import MONEY, any_money, bank_money, split_signed
from tallywise.functions.text import normal_description
from tallywise.operators import detect
from tallywise.operators.metrics import metrics_log
from tallywise.session import materialise
from tallywise.sources import files, grids

FILES_PER_BATCH = 10_000  # paths of one micro-batch that reach the driver
LISTING = "path string, modificationTime timestamp, length long, content binary"  # contents are never read from it
READABLE = [".csv"]
STAGE = ("file string, row_no long, txn_date date, description string, amount_out decimal(18,2), amount_in decimal(18,2), "
         "predicted_category string, confidence double, batch int, source string, period string, stage string")


def admit(listing: DataFrame) -> DataFrame:
    """Files with name, size and, where a file may not be read, the reason."""
    named = listing.select(F.col("path").alias("file"), base_name(F.col("path")).alias("name"), F.col("length").alias("size"))
    checked = files.admitted(named)
    return checked.select("file", "name", "size", F.when(~extension(F.col("name")).isin(UPLOAD_EXTENSIONS), "unknown extension")
                          .when(~F.col("admitted"), "too large").when(~extension(F.col("name")).isin(READABLE), "not a text file")
                          .alias("refused"))


def one_slash(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def detected(spark: SparkSession, admitted: DataFrame, grid: DataFrame) -> DataFrame:
    """One row per file: layout (statement or table), source, confidence, detected columns, row count, issues and status."""
    layout = detect.statement_layout(grid).where("is_statement").select("file")
    statements = materialise(spark, layout, "statements")
    tables = grid.join(statements, "file", "left_anti")
    rest = admitted.where("refused is null").join(statements, "file", "left_anti").select("file", "name", "size")
    verdicts = detect.detect_files(rest, grids.header_cells(tables), grids.body_cells(tables)).select(
        "file", F.lit("table").alias("layout"), "source", "confidence", "detected_columns", "row_count", "issues", "is_valid")
    body = grids.statement_rows(grid.join(statements, "file", "left_semi"))
    counted = statements.join(body.groupBy("file").agg(F.count(F.lit(1)).alias("row_count")), "file", "left").select(
        "file", F.lit("statement").alias("layout"), F.lit(CREDIT_CARD).alias("source"), F.lit(1.0).alias("confidence"),
        F.lit(None).cast("map<string,string>").alias("detected_columns"), F.coalesce("row_count", F.lit(0)).alias("row_count"))
    counted = counted.withColumn("issues", F.when(F.col("row_count") == 0, F.array(F.lit("File contains no data rows")))
                                 .otherwise(F.array().cast("array<string>"))).withColumn("is_valid", F.size("issues") == 0)
    known = admitted.join(verdicts.unionByName(counted), "file", "left")
    refused = F.when(F.col("refused").isNotNull(), F.array("refused"))
    return known.select(
        "file", "name", "size", "layout", "source", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "detected_columns",
        F.coalesce("row_count", F.lit(0)).cast("long").alias("row_count"),
        F.coalesce(refused, F.col("issues"), F.array(F.lit("File is empty"))).alias("issues"),
        F.when(F.col("refused").isNull() & F.coalesce("is_valid", F.lit(False)), "accepted").otherwise("rejected").alias("status"))


def typed_rows(grid: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Rows of accepted files: file, row_no, source, txn_date, description, amount_out, amount_in; incomplete rows go."""
    accepted = verdicts.where("status = 'accepted'")
    cell = lambda field: F.element_at("cells", F.element_at("detected_columns", F.lit(field)))
    money = lambda field: any_money(cell(field))
    tables = accepted.where("layout = 'table'").select("file", "source", "detected_columns")
    named = grids.body_cells(grid.join(tables.select("file"), "file", "left_semi")).join(tables, "file")
    paired = F.map_contains_key("detected_columns", F.lit("amount_out"))
    out, inn = split_signed(money("amount"))
    zero = F.lit(0).cast(MONEY)

    def side(field: str, single: Column) -> Column:
        return F.when(paired, F.coalesce(money(field), zero)).otherwise(single)

    has_money = F.when(paired, money("amount_out").isNotNull() | money("amount_in").isNotNull()).otherwise(money("amount").isNotNull())
    rows = named.select("file", "row_no", "source", lenient_date(cell("date")).alias("txn_date"),
                        normal_description(cell("description")).alias("description"), side("amount_out", out).alias("amount_out"),
                        side("amount_in", inn).alias("amount_in"), has_money.alias("has_money"))
    statements = accepted.where("layout = 'statement'").select("file", "source")
    lines = grids.statement_rows(grid.join(statements.select("file"), "file", "left_semi")).join(statements, "file")
    out, inn = split_signed(bank_money(F.col("amount")))
    more = lines.select("file", "row_no", "source", lenient_date(F.col("date")).alias("txn_date"),
                        normal_description(F.col("description")).alias("description"), out.alias("amount_out"), inn.alias("amount_in"),
                        bank_money(F.col("amount")).isNotNull().alias("has_money"))
    return (rows.unionByName(more).where("has_money and txn_date is not null and description is not null").drop("has_money"))


def committed(spark: SparkSession, out: str) -> DataFrame:
    """The ledger, one row per finished batch; empty before the first."""
    try:
        return spark.read.parquet(f"{out}/ledger")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "files long, rejected long, rows_read long, rows_kept long, done_at timestamp, batch int")


def read_table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the file drop, finished batches only; the batch number prunes folders."""
    done = committed(spark, out).select(F.col("batch").alias("_done"))
    try:
        table = spark.read.json(f"{out}/{name}") if name == "metrics" else spark.read.parquet(f"{out}/{name}")
    except AnalysisException as e:
        if name != "stage" or e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        table = spark.createDataFrame([], STAGE)  # no file had a row to keep, so no part was written
    return table.join(done, F.col("batch") == F.col("_done"), "left_semi")


def process_batch(spark: SparkSession, listing: DataFrame, number: int, out: str, predict: Callable[[DataFrame], DataFrame]) -> None:
    """One micro-batch: ``listing`` has path and length of its files."""
    if not committed(spark, out).where(F.col("batch") == number).isEmpty():
        return
    admitted = materialise(spark, admit(listing), "admitted")
    # at most FILES_PER_BATCH paths
    paths = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r.file) for r in admitted.where("refused is null and size > 0").select("file").collect()]
    found = files.scan_grid(spark, paths) if paths else spark.createDataFrame([], "file string, row_no long, cells array<string>")
    # a scan gives its files as URLs, a listing as plain paths
    grid = materialise(spark, found.withColumn("file", one_slash(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))))), "grid")
    verdicts = materialise(spark, detected(spark, admitted.withColumn("file", one_slash(F.col("file"))), grid), "verdicts")
    verdicts.write.mode("overwrite").parquet(f"{out}/files/batch={number}")
    rows = predict(typed_rows(grid, verdicts)).withColumns({
        "period": F.date_format("txn_date", "yyyy-MM"), "stage": F.lit("predictions")})
    rows.write.mode("overwrite").partitionBy("source", "period", "stage").parquet(f"{out}/stage/batch={number}")
    kept = materialise(spark, rows.select(F.lit(number).alias("number"), "predicted_category", "confidence"), "kept")
    (metrics_log(kept, "number", "predicted_category", F.current_timestamp()).drop("number")
     .write.mode("overwrite").json(f"{out}/metrics/batch={number}"))
    counts = verdicts.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("status") == "rejected").alias("rejected"),
                          F.coalesce(F.sum("row_count"), F.lit(0)).alias("rows_read"))
    total = kept.agg(F.count(F.lit(1))).scalar()
    (counts.select("*", total.alias("rows_kept"), F.current_timestamp().alias("done_at"))
     .write.mode("overwrite").parquet(f"{out}/ledger/batch={number}"))  # last: the commit


def run_inbox(spark: SparkSession, inbox: str, out: str, checkpoint: str, predict: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Process all files now in the inbox, then stop. ``predict`` adds predicted_category and confidence to typed rows."""
    listing = (spark.readStream.format("binaryFile").schema(LISTING).option("maxFilesPerTrigger", FILES_PER_BATCH)
               .option("recursiveFileLookup", True).load(inbox).select("path", "length"))
    return (listing.writeStream.foreachBatch(lambda batch, number: process_batch(spark, batch, number, out, predict))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
