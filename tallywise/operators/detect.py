"""File detection over cell tables: layout, source, columns, quality, verdict.

Every function works on all files at once. ``rows`` is a table of
``(file, row_no, cells map<string,string>)``; ``columns`` is
``(file, ordinal, column)``. Results are one row per file or per file and field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.constants import (CARD_COLUMN_HINTS, CARD_NAME_WORDS, CARD_TEXT_HINTS,
                                 CARD_WEAK_COLUMN_HINTS, CONTENT_SAMPLE_ROWS, CREDIT_CARD,
                                 DATE_SAMPLE_ROWS, FIELD_PATTERNS, HOUSEHOLD,
                                 HOUSEHOLD_COLUMN_HINTS, HOUSEHOLD_NAME_WORDS,
                                 HOUSEHOLD_TEXT_HINTS, MIN_FILE_ROWS, STATEMENT_MARKERS,
                                 STATEMENT_MIN_MARKERS, STATEMENT_SAMPLE_ROWS)
from tallywise.functions.dates import lenient_date
from tallywise.functions.missing import present
from tallywise.functions.money import lenient_number
from tallywise.operators.ordered import first_rows
from tallywise.session import materialise

SCORE = "decimal(4,1)"
PAIR_FIELDS = ["out", "in", "debit", "credit"]


def statement_layout(grid: DataFrame) -> DataFrame:
    """Whether each file is a bank statement, from marker phrases in its head.

    ``row_no`` is stored at ingest, so the head is a pushed-down filter.
    """
    text = F.upper(F.array_join("cells", " "))
    flags = [F.max(F.contains(text, F.lit(m)).cast("int")) for m in STATEMENT_MARKERS]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return (grid.where(F.col("row_no") < STATEMENT_SAMPLE_ROWS).groupBy("file")
            .agg(total.cast("long").alias("markers"))
            .withColumn("is_statement", F.col("markers") >= STATEMENT_MIN_MARKERS))


def _hits(text: Column, words: list[str]) -> Column:
    total = F.contains(text, F.lit(words[0])).cast("int")
    for w in words[1:]:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def _any(text: Column, words: list[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def source_scores(files: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Household and card scores per file, the chosen source and its confidence.

    ``files`` is ``(file, name)``. Weights are exact decimals.
    """
    low = F.lower(F.col("column"))
    by_column = columns.groupBy("file").agg(
        F.bool_or(_any(low, HOUSEHOLD_COLUMN_HINTS)).alias("h_col"),
        F.bool_or(_any(low, CARD_COLUMN_HINTS)).alias("c_col"),
        F.bool_or(_any(low, CARD_WEAK_COLUMN_HINTS)).alias("c_weak"),
        F.bool_or(low.isin("description", "item")).alias("has_text"),
        F.min_by(F.when(low.isin("description", "item", "details"), F.col("column")),
                 F.when(low.isin("description", "item", "details"), F.col("ordinal")))
         .alias("text_column"))
    # stored row numbers are dense, so the sample is a pushed-down filter
    head = rows.where(F.col("row_no") < CONTENT_SAMPLE_ROWS)
    texts = (head.join(by_column.where("has_text").select("file", "text_column"), "file")
             .select("file", F.lower(F.element_at("cells", F.col("text_column"))).alias("t")))
    flag = lambda w: F.max(F.contains(F.col("t"), F.lit(w)).cast("int"))
    sum_flags = lambda ws: sum((F.coalesce(flag(w), F.lit(0)) for w in ws[1:]),
                               F.coalesce(flag(ws[0]), F.lit(0)))
    by_text = texts.groupBy("file").agg(sum_flags(HOUSEHOLD_TEXT_HINTS).alias("h_text"),
                                        sum_flags(CARD_TEXT_HINTS).alias("c_text"))
    name = F.lower(F.col("name"))
    w = lambda x: F.lit(x).cast(SCORE)
    num = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    scored = (files.join(by_column, "file", "left").join(by_text, "file", "left").select(
        "file", "name",
        (_hits(name, HOUSEHOLD_NAME_WORDS) * w("0.3") + num("h_col") * w("0.4")
         + num("h_text") * w("0.1")).cast(SCORE).alias("household_score"),
        (_hits(name, CARD_NAME_WORDS) * w("0.3") + num("c_col") * w("0.4")
         + num("c_weak") * w("0.2") + num("c_text") * w("0.1")).cast(SCORE).alias("card_score")))
    h, c = F.col("household_score"), F.col("card_score")
    house, card = (h > c) & (h > w("0.3")), (c > h) & (c > w("0.3"))
    best = F.least(F.greatest(h, c).cast("double"), F.lit(0.95))
    return scored.select(
        "*", F.when(house, HOUSEHOLD).otherwise(CREDIT_CARD).alias("source"),
        F.when(house | card, best).otherwise(F.lit(0.5)).alias("source_confidence"))


def confirmation_tier(confidence: Column) -> Column:
    """How the detected source is offered for confirmation."""
    return (F.when(confidence > 0.7, "accept").when(confidence >= 0.5, "offer")
            .otherwise("choose"))


def amount_pairs(columns: DataFrame) -> DataFrame:
    """Per file, the paired amount columns if both halves of a pair exist."""
    low = F.lower(F.col("column"))
    named = lambda n: F.max_by(F.when(low == n, F.col("column")),
                               F.when(low == n, F.col("ordinal")))
    wide = columns.groupBy("file").agg(*[named(n).alias(f"_{n}") for n in PAIR_FIELDS])
    out_in = F.col("_out").isNotNull() & F.col("_in").isNotNull()
    dr_cr = F.col("_debit").isNotNull() & F.col("_credit").isNotNull()
    return wide.where(out_in | dr_cr).select(
        "file", F.when(out_in, "out_in_pair").otherwise("debit_credit_pair").alias("amount"),
        F.coalesce("_out", "_debit").alias("amount_out"),
        F.coalesce("_in", "_credit").alias("amount_in"))


def column_mapping(columns: DataFrame, sources: DataFrame) -> DataFrame:
    """``(file, field, column)`` for every field a file's columns can fill.

    Exact names win by pattern priority, then the first pattern some column
    contains, then column order. A pair of amount columns replaces the single
    amount. The patterns are constants, so matching is an expression per column
    rather than a join.
    """
    by_source = {}
    for source, field, patterns in FIELD_PATTERNS:
        by_source.setdefault(source, []).append((field, patterns))
    low = F.lower(F.col("column"))

    def candidates(source: str) -> Column:
        return F.array(*[
            F.struct(F.lit(field).alias("field"), F.coalesce(
                *[F.when(low == p, F.lit(i)) for i, p in enumerate(patterns)],
                *[F.when(F.contains(low, F.lit(p)), F.lit(1000 + i))
                  for i, p in enumerate(patterns)]).alias("rank"))
            for field, patterns in by_source[source]])

    tagged = columns.join(sources.select("file", "source"), "file")
    options = tagged.select("file", "ordinal", "column", F.explode(
        F.when(F.col("source") == HOUSEHOLD, candidates(HOUSEHOLD))
         .otherwise(candidates(CREDIT_CARD))).alias("c"))
    # of several columns equal in lower case the last one keeps the name
    order = F.struct(F.col("c.rank"), F.when(F.col("c.rank") < 1000, -F.col("ordinal"))
                     .otherwise(F.col("ordinal")))
    single = (options.where(F.col("c.rank").isNotNull())
              .groupBy("file", F.col("c.field").alias("field"))
              .agg(F.min_by("column", order).alias("column")))
    pairs = amount_pairs(columns)
    paired = pairs.select("file", F.explode(F.create_map(
        F.lit("amount"), F.col("amount"), F.lit("amount_out"), F.col("amount_out"),
        F.lit("amount_in"), F.col("amount_in"))).alias("field", "column"))
    lone = single.join(pairs.select("file", F.lit("amount").alias("field")),
                       ["file", "field"], "left_anti")
    return lone.unionByName(paired)


def column_quality(rows: DataFrame) -> DataFrame:
    """Per file and column: rows, filled cells and numeric cells, in one pass."""
    cells = rows.select("file", F.explode("cells").alias("column", "value"))
    v = present(F.col("value"))
    return cells.groupBy("file", "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("filled"),
        F.count_if(lenient_number(v).isNotNull()).alias("numeric"))


def date_sample_quality(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Share of readable dates among the first non-null values of the date column.

    A date column's name holds one of the date patterns, so cells of other columns are left out in the
    scan and the rows need no join. The rank filter lets a task forward only the first few values of
    each (file, column); the mapping then picks one column per file.
    """
    names = sorted({p for _, field, patterns in FIELD_PATTERNS if field == "date" for p in patterns})
    dated = F.map_filter("cells", lambda column, _: _any(F.lower(column), names))
    values = (rows.select("file", "row_no", F.explode(dated).alias("column", "v"))
              .select("file", "row_no", "column", present(F.col("v")).alias("v")).where(F.col("v").isNotNull()))
    head = first_rows(values, ["file", "column"], [F.col("row_no")], DATE_SAMPLE_ROWS)
    samples = head.groupBy("file", "column").agg(
        F.count(F.lit(1)).alias("sampled"),
        F.count_if(lenient_date(F.col("v")).isNotNull()).alias("parsed"))
    chosen = mapping.where(F.col("field") == "date").select("file", "column")
    return samples.join(chosen, ["file", "column"], "left_semi").drop("column")


def detect_files(files: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Verdicts of all files. The per-file scores and mappings are used several
    times, so they are written once to the shared scratch folder."""
    spark = files.sparkSession
    scores = materialise(spark, source_scores(files.select("file", "name"), columns, rows), "scores")
    mapping = materialise(spark, column_mapping(columns, scores), "mapping")
    return file_verdicts(files, scores, mapping, column_quality(rows),
                         date_sample_quality(rows, mapping))


def file_verdicts(files: DataFrame, scores: DataFrame, mapping: DataFrame, quality: DataFrame,
                  dates: DataFrame) -> DataFrame:
    """One verdict per file: issues found and whether the file may be processed.

    ``files`` is ``(file, name, size)``; a file of size zero or without rows is
    invalid on its own. Paired amount columns are checked for numbers too, but
    not for being mostly empty, because each row fills only one of them.
    """
    fields = mapping.groupBy("file").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "column"))))
         .alias("detected_columns"))
    checked = (mapping.where(~F.col("column").isin("out_in_pair", "debit_credit_pair"))
               .join(quality, ["file", "column"]))
    is_pair = F.col("field").isin("amount_out", "amount_in")
    is_amount = is_pair | (F.col("field") == "amount")
    ratio = F.try_divide(F.col("numeric"), F.col("filled"))
    issue = F.array_compact(F.array(
        F.when(~is_pair & (F.col("filled") < F.col("n_rows") * 0.5),
               F.concat(F.lit("mostly empty: "), F.col("column"))),
        F.when((F.col("field") == "amount") & ratio.isNull(), F.concat(F.lit("cannot validate: "), F.col("column"))),
        F.when(is_amount & (ratio < 0.8), F.concat(F.lit("not numeric: "), F.col("column")))))
    # one half of a pair may be empty, for a month without income, but not both
    no_pair = F.when(F.max(F.when(is_pair, F.col("filled"))) == 0,
                     F.array(F.lit("cannot validate: amount pair"))).otherwise(F.array())
    per_file = checked.groupBy("file").agg(
        F.sort_array(F.concat(F.flatten(F.collect_list(issue)), no_pair)).alias("column_issues"))
    counts = quality.groupBy("file").agg(F.max("n_rows").alias("row_count"))
    joined = (files.join(scores.drop("name"), "file", "left").join(fields, "file", "left")
              .join(per_file, "file", "left").join(counts, "file", "left")
              .join(dates, "file", "left"))
    rows_in = F.coalesce(F.col("row_count"), F.lit(0))
    broken = (F.when(F.col("size").isNull(), "File not found")
              .when(F.col("size") == 0, "File is empty")
              .when(rows_in == 0, "File contains no data rows"))
    lacking = F.array_except(F.array(F.lit("date"), F.lit("description"), F.lit("amount")),
                             F.coalesce(F.map_keys("detected_columns"),
                                        F.array().cast("array<string>")))
    found = F.concat(
        F.when(F.size(lacking) > 0, F.array(F.concat(
            F.lit("missing columns: "), F.array_join(lacking, ", ")))).otherwise(F.array()),
        F.coalesce(F.col("column_issues"), F.array().cast("array<string>")),
        F.when(F.col("parsed") < F.col("sampled") * 0.8, F.array(F.lit("unreadable dates")))
         .otherwise(F.array()),
        F.when(rows_in < MIN_FILE_ROWS, F.array(F.concat(
            F.lit("too few rows: "), rows_in.cast("string")))).otherwise(F.array()))
    issues = F.when(broken.isNotNull(), F.array(broken)).otherwise(found)
    confidence = F.when(broken.isNull(), F.col("source_confidence")).otherwise(F.lit(0.0))
    return joined.select(
        "file", "name",
        F.when(broken.isNull(), F.col("source")).alias("source"),
        confidence.alias("confidence"), issues.alias("issues"), "detected_columns",
        rows_in.alias("row_count"), F.coalesce("size", F.lit(0)).alias("file_size"),
        ((F.size(issues) == 0) & (confidence > 0.5)).alias("is_valid"))


def suggestions(issues: Column) -> Column:
    """Advice that goes with each issue."""
    advice = lambda i: (
        F.when(i.startswith("missing columns"), "Add columns for date, description and amount")
        .when(i.startswith("mostly empty"), "Fill the column with data")
        .when(i.startswith("not numeric"), "Write amounts as plain numbers")
        .when(i.startswith("unreadable dates"), "Write dates as YYYY-MM-DD or M/D/YYYY")
        .when(i.startswith("too few rows"), "Give at least 10 transactions")
        .otherwise("Check the file"))
    return F.array_distinct(F.transform(issues, advice))
