"""Row rules and the validation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.constants import MIN_CATEGORY_SAMPLES, RARE_SHARE, SOURCES, TRAINING_MIN_ROWS
from tallywise.functions.dates import lenient_date
from tallywise.functions.money import lenient_number

# columns a report looks at, with the rules that need them
REPORTED_COLUMNS = {
    "Amount": ["all_amounts_zero", "null_amount", "nonzero_amount"],
    "Amount (Negated)": ["all_amounts_zero", "null_negated", "nonzero_negated"],
    "Date": ["bad_date"],
    "Description": ["null_description", "short_description"],
    "Category": ["null_category", "unknown_label"],
    "transaction_source": ["null_source", "bad_source"],
}


def drop_incomplete(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.dropna(subset=fields)


def complete_rows(df: DataFrame, fields: list[str], what: str) -> DataFrame:
    """``drop_incomplete``; a table that keeps no row is an error. Looks for one row only."""
    kept = drop_incomplete(df, fields)
    if kept.isEmpty():
        raise ValueError(f"{what}: no row has all of {', '.join(fields)}")
    return kept


def of_source(df: DataFrame, source: str) -> DataFrame:
    return df.where(F.col("transaction_source") == source)


def keep_frequent(df: DataFrame, label: str, minimum: int | Column = MIN_CATEGORY_SAMPLES,
                  few: bool = False) -> DataFrame:
    """Rows whose label has at least ``minimum`` rows.

    The counts come from a partial aggregate, so a hot label is never gathered;
    the join's small side is broadcast or, past the threshold, sort-merged with
    adaptive skew splitting. ``few`` tells that the labels are a list of classes, which
    is broadcast, so that rows stay where they are.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    kept = counts.where(F.col("_n") >= minimum).select(label)
    return df.join(F.broadcast(kept) if few else kept, label, "left_semi")


def rare_labels(df: DataFrame, label: str, minimum: int = MIN_CATEGORY_SAMPLES) -> DataFrame:
    """Labels below the minimum with their rows and share of all rows."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.select(label, "n", (F.col("n") / total).alias("share"))
            .where(F.col("n") < minimum))


def low_share_labels(df: DataFrame, label: str, limit: float = RARE_SHARE) -> DataFrame:
    """Labels with less than ``limit`` of all labelled rows."""
    counts = (df.where(F.col(label).isNotNull()).groupBy(label)
              .agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).scalar()
    return (counts.select(label, "n", (F.col("n") / total).alias("share"))
            .where(F.col("share") < limit))


def unknown_labels(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    """Distinct non-null labels the dictionary lacks, with their row counts."""
    used = (df.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("n")))
    return used.join(dictionary, used[label] == dictionary["category"], "left_anti")


def amount_checks() -> list[Column]:
    """Aggregates behind the amount rules, for one ``agg`` call."""
    out = lenient_number(F.col("`Amount (Negated)`"))
    inn = lenient_number(F.col("Amount"))
    return [
        F.count_if(inn.isNull()).alias("null_amount"),
        F.count_if(out.isNull()).alias("null_negated"),
        F.count_if(F.coalesce(inn, F.lit(0.0)) != 0).alias("nonzero_amount"),
        F.count_if(F.coalesce(out, F.lit(0.0)) != 0).alias("nonzero_negated"),
    ]


def date_checks() -> list[Column]:
    return [F.count_if(lenient_date(F.col("Date")).isNull()).alias("bad_dates")]


def description_checks() -> list[Column]:
    d = F.col("Description")
    return [F.count_if(d.isNull()).alias("null_descriptions"),
            F.count_if(F.length(d) < 3).alias("short_descriptions")]


def category_checks() -> list[Column]:
    return [F.count_if(F.col("Category").isNull()).alias("null_categories")]


def source_checks() -> list[Column]:
    s = F.col("transaction_source")
    return [F.count_if(s.isNull()).alias("null_sources"),
            F.count_if(s.isNotNull() & ~s.isin(SOURCES)).alias("bad_sources")]


def pair_checks(now: Column) -> list[Column]:
    """Amount must mirror the negated amount, and no date may lie ahead."""
    out = lenient_number(F.col("`Amount (Negated)`"))
    inn = lenient_number(F.col("Amount"))
    return [F.count_if(F.coalesce(inn != -out, F.lit(True))).alias("inconsistent_amounts"),
            F.count_if(lenient_date(F.col("Date")) > now).alias("future_dates")]


def bad_source_values(df: DataFrame) -> DataFrame:
    s = F.col("transaction_source")
    return (df.where(s.isNotNull() & ~s.isin(SOURCES)).groupBy(s)
            .agg(F.count(F.lit(1)).alias("n")))


def purity(df: DataFrame, expected: str, actual: str, group: str) -> DataFrame:
    """Rows per group whose source is not the expected one; a null source counts."""
    wrong = ~F.col(actual).eqNullSafe(F.col(expected))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows"),
                                 F.count_if(wrong).alias("wrong_rows"))


def size_gate(df: DataFrame, minimum: int = TRAINING_MIN_ROWS) -> DataFrame:
    """Rows per source and whether there are more than ``minimum``."""
    n = F.count(F.lit(1))
    return df.groupBy("transaction_source").agg(n.alias("n_rows"), (n > minimum).alias("enough"))


def column_presence(df: DataFrame) -> DataFrame:
    """One error per reported column the frame lacks, in the form of the report; the schema decides, not the rows."""
    lacking = [(None, f"missing_column: {c}", "error", 1) for c in REPORTED_COLUMNS if c not in df.columns]
    return df.sparkSession.createDataFrame(lacking, "transaction_source string, rule string, severity string, n long")


def validation_report(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per source and rule with its severity and count.

    All counts of a source come from a single aggregate over the rows; only the
    unknown-label count needs a second, much smaller one. A column that the frame
    lacks is one error of its own, and the rules that read it are left out.
    """
    missing = column_presence(df)
    lacking = [c for c in REPORTED_COLUMNS if c not in df.columns]
    df = df.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else df
    known = dictionary.select(F.col("category").alias("Category"), F.lit(True).alias("_known"))
    per_label = df.groupBy("transaction_source", "Category").agg(
        F.count(F.lit(1)).alias("n_rows"), *amount_checks(), *date_checks(),
        *description_checks(), *category_checks(), *source_checks())
    sums = [c for c in per_label.columns if c not in ("transaction_source", "Category")]
    joined = per_label.join(known, "Category", "left")
    unknown = F.count_if(F.col("Category").isNotNull() & F.col("_known").isNull())
    wide = joined.groupBy("transaction_source").agg(
        *[F.sum(c).alias(c) for c in sums], unknown.alias("unknown_labels"))
    all_zero = ((F.col("nonzero_amount") == 0) & (F.col("nonzero_negated") == 0)).cast("long")
    rules = [
        ("all_amounts_zero", "error", all_zero),
        ("null_source", "error", F.col("null_sources")),
        ("bad_source", "error", F.col("bad_sources")),
        ("null_category", "error", F.col("null_categories")),
        ("null_description", "error", F.col("null_descriptions")),
        ("bad_date", "warning", F.col("bad_dates")),
        ("short_description", "warning", F.col("short_descriptions")),
        ("unknown_label", "warning", F.col("unknown_labels")),
        ("null_amount", "info", F.col("null_amount")),
        ("null_negated", "info", F.col("null_negated")),
        ("nonzero_amount", "info", F.col("nonzero_amount")),
        ("nonzero_negated", "info", F.col("nonzero_negated")),
    ]
    left_out = {r for c in lacking for r in REPORTED_COLUMNS[c]}
    entries = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"),
                                 c.cast("long").alias("n")) for r, s, c in rules if r not in left_out])
    found = wide.select("transaction_source", F.explode(entries).alias("e")).select(
        "transaction_source", "e.rule", "e.severity", "e.n")
    return found.unionByName(missing) if lacking else found


def fold_sources(report: DataFrame) -> DataFrame:
    """All sources that are not known as one, so that a report of any rows has few lines."""
    s = F.col("transaction_source")
    folded = F.when(s.isNull() | s.isin(SOURCES), s).otherwise("unknown")
    return (report.groupBy(folded.alias("transaction_source"), "rule", "severity")
            .agg(F.sum("n").alias("n")))


def blocking_errors(report: DataFrame) -> DataFrame:
    """Sources whose report holds at least one error."""
    return (report.where((F.col("severity") == "error") & (F.col("n") > 0))
            .groupBy("transaction_source").agg(F.count(F.lit(1)).alias("error_rules")))
