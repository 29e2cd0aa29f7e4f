"""Physical lines and records of delimited files.

Lines keep their true numbers, blank ones included. They come from where a
split of the file starts and the order within it, so one huge file is numbered
by many tasks and no row is shuffled for it. A record is one line, or several
where a quoted field holds line breaks. Whether a line begins inside a quote is
the composition, line by line, of functions on two states (inside, outside):
composed per split first, then over the splits of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tallywise.session import materialise

_INNER = r'[^"]*+(?:""[^"]*+)*+'  # a quote inside a quoted field is doubled
_QUOTED = rf'"{_INNER}"'
_FIELDS = rf'(?:(?:{_QUOTED}[^,]*+|[^,"][^,]*+|),)*+'
OPENS = rf'\A{_FIELDS}"{_INNER}\z'
CLOSES = rf'\A{_INNER}"'
REOPENS = rf'\A{_INNER}"[^,]*+,{_FIELDS}"{_INNER}\z'
CELL = rf',(?:{_QUOTED}[^,]*+|[^,]*+)'


def lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(file, split, row_no, value, torn)`` of every line; ``torn`` marks files in which some line leaves a quote open."""
    raw = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value")
    # one row per split of a file; a split's rows have consecutive ids
    splits = materialise(spark, raw.groupBy("file", "split").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.bool_or(opens(F.col("value"))).alias("opens")), "splits")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"),
                           F.max("opens").over(Window.partitionBy("file")).alias("torn"))
    placed = raw.join(starts, ["file", "split"]).withColumn("row_no", F.col("lines_before") + F.col("at") - F.col("first"))
    clean = F.when(F.col("row_no") == 0, F.regexp_replace("value", "\\A\ufeff", "")).otherwise(F.col("value"))
    return placed.select("file", "split", "row_no", clean.alias("value"), "torn")


def opens(line: Column) -> Column:
    """A line that begins outside a quote ends inside one."""
    return F.contains(line, F.lit('"')) & line.rlike(OPENS)


def stays(line: Column) -> Column:
    """A line that begins inside a quote ends inside one."""
    return ~F.contains(line, F.lit('"')) | ~line.rlike(CLOSES) | line.rlike(REOPENS)


def records(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``(file, row_no, record)``; ``row_no`` is the number of the record's first line.

    A quote that its file never closes is an ordinary character.
    """
    found = lines(spark, paths)
    whole = found.where(~F.col("torn")).select("file", "row_no", F.col("value").alias("record"))
    torn = materialise(spark, found.where("torn").drop("torn"), "torn")
    return whole if torn.isEmpty() else whole.unionByName(joined_lines(spark, torn))


def _last(column: Column, window) -> Column:
    return F.last(column, ignorenulls=True).over(window)


def joined_lines(spark: SparkSession, torn: DataFrame) -> DataFrame:
    """Records of files that have some of several lines."""
    one, two = opens(F.col("value")), stays(F.col("value"))
    marked = torn.withColumns({"sets": F.when(one == two, one.cast("int")), "flips": (one & ~two).cast("int")})
    inside = Window.partitionBy("file", "split").orderBy("row_no")
    upto, before = (inside.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    marked = marked.withColumn("run", F.sum("flips").over(upto))
    marked = marked.withColumns({
        "set_before": _last(F.col("sets"), before),
        "flips_before": F.coalesce(F.sum("flips").over(before), F.lit(0))
        - F.coalesce(_last(F.when(F.col("sets").isNotNull(), F.col("run")), before), F.lit(0))})
    marked = materialise(spark, marked, "marked")

    # what a whole split does: it sets a state, or it flips the one it meets
    at_set = F.when(F.col("sets").isNotNull(), F.col("row_no"))
    per_split = marked.groupBy("file", "split").agg(
        F.max_by("sets", at_set).alias("sets"), (F.sum("flips") - F.coalesce(F.max_by("run", at_set), F.lit(0))).alias("after"))
    odd = (F.col("after") % 2).cast("int")
    per_split = per_split.select("file", "split", F.col("sets").bitwiseXOR(odd).alias("sets"),
                                 F.when(F.col("sets").isNull(), odd).otherwise(0).alias("flips"))
    over = Window.partitionBy("file").orderBy("split")
    upto, before = (over.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    per_split = per_split.withColumn("run", F.sum("flips").over(upto))

    def state(window, run: Column) -> Column:
        since = run - F.coalesce(_last(F.when(F.col("sets").isNotNull(), F.col("run")), window), F.lit(0))
        return F.coalesce(_last(F.col("sets"), window), F.lit(0)).bitwiseXOR((since % 2).cast("int"))

    per_split = per_split.select("file", "split", state(before, F.coalesce(F.sum("flips").over(before), F.lit(0))).alias("entered"),
                                 state(upto, F.col("run")).alias("left"))
    at_start = F.coalesce("set_before", "entered").bitwiseXOR((F.col("flips_before") % 2).cast("int"))
    begun = marked.join(per_split, ["file", "split"]).withColumn("begins", F.when(at_start == 0, F.col("row_no")))

    # the last record that began in an earlier split goes on into this one
    ends = begun.groupBy("file", "split").agg(F.max("begins").alias("begins"), F.max("left").alias("left"))
    carried = ends.select("file", "split", F.max("begins").over(before).alias("carried"),
                          F.max("begins").over(Window.partitionBy("file")).alias("final"),
                          F.max_by("left", "split").over(Window.partitionBy("file")).alias("unclosed"))
    own = F.max("begins").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    placed = begun.withColumn("own", own).join(carried, ["file", "split"]).withColumn("of", F.coalesce("own", "carried"))
    never = (F.col("unclosed") == 1) & (F.col("of") == F.col("final"))
    grouped = placed.withColumn("of", F.when(never, F.col("row_no")).otherwise(F.col("of")))
    parts = F.array_sort(F.collect_list(F.struct("row_no", "value")))
    return (grouped.groupBy("file", "of").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("record"))
            .select("file", F.col("of").alias("row_no"), "record"))


def cells(record: Column) -> Column:
    """All cells of a record, however many; empty ones are null, doubled quotes are single ones."""
    raw = F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(CELL), F.lit(0)),
                      lambda c: F.substring(c, F.lit(2), F.length(c)))
    plain = F.transform(raw, lambda c: F.when(
        c.rlike(rf"\A{_QUOTED}\z"), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.transform(plain, lambda c: F.nullif(c, F.lit("")))
