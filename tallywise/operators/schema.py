"""Schema operators: column resolving, projections and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallywise.constants import (CANONICAL_ALIASES, CREDIT_CARD, DEFAULT_ACCOUNT, GRID_PATTERNS, HOUSEHOLD,
                                 STAGE_RENAMES)
from tallywise.functions.dates import lenient_date
from tallywise.functions.missing import first_present
from tallywise.functions.money import MONEY, any_money, lenient_money, split_signed

HOUSEHOLD_COLUMNS = ["Date", "Description", "Out", "In"]
LINEAGE_COLUMNS = ["correction_timestamp", "source_model_version"]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """Required columns the frame lacks, in the given order."""
    return [c for c in required if c not in df.columns]


def missing_by_file(columns: DataFrame, required: list[str]) -> DataFrame:
    """``(file, missing)`` for files that lack required columns; a flag per name, no list of all names."""
    lacks = [F.when(~F.bool_or(F.coalesce(F.col("column") == c, F.lit(False))), F.lit(c)) for c in required]
    return columns.groupBy("file").agg(F.array_compact(F.array(*lacks)).alias("missing")).where(F.size("missing") > 0)


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    lacking = missing_columns(df, required)
    if lacking:
        raise ValueError("Missing required columns: " + ", ".join(lacking))
    return df


def transform_household(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Household log with Out and In to canonical ledger rows.

    Unreadable money becomes zero; ``money_as_zero`` counts how many of the
    row's two filled cells were unreadable, so the loss can be reported.
    """
    require_columns(df, HOUSEHOLD_COLUMNS)
    zero = F.lit(0).cast(MONEY)
    unread = lambda c: (F.col(c).isNotNull() & (F.trim(F.col(c)) != "")
                        & lenient_money(F.col(c)).isNull()).cast("int")
    return df.select(
        *(extra or []), "Date", "Description",
        F.coalesce(lenient_money(F.col("Out")), zero).alias("Amount (Negated)"),
        F.coalesce(lenient_money(F.col("In")), zero).alias("Amount"),
        F.lit(HOUSEHOLD).alias("transaction_source"),
        (F.coalesce(unread("Out"), F.lit(0)) + F.coalesce(unread("In"), F.lit(0)))
        .alias("money_as_zero"))


def rename_description(df: DataFrame) -> DataFrame:
    """Rename the first column called description in any case."""
    for c in df.columns:
        if c.lower() == "description":
            return df if c == "Description" else df.withColumnRenamed(c, "Description")
    raise ValueError("no 'Description' or 'description' column")


def resolve_grid_columns(columns: list[str]) -> dict[str, str]:
    """Field to column for a spreadsheet of unknown layout.

    Exact names in any case win by priority; when some fields match, the others
    fall back to the first, second and last column.
    """
    by_low: dict[str, str] = {}
    for c in columns:
        by_low[c.lower()] = c
    found = {}
    for field, names in GRID_PATTERNS.items():
        hit = next((by_low[n] for n in names if n in by_low), None)
        if hit is not None:
            found[field] = hit
    if not found:
        raise ValueError("no date, description or amount column found")
    positions = {"date": 0, "description": 1, "amount": -1}
    return {f: found.get(f, columns[p]) for f, p in positions.items()}


def rename_stage(df: DataFrame) -> DataFrame:
    """Spreadsheet and prediction names to canonical names, in place."""
    mapping = {**STAGE_RENAMES, "predicted_category": "Category"}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def add_canonical(df: DataFrame) -> DataFrame:
    """Add a canonical column where only another accepted name is present.

    Out and In count as accepted names, so household files keep their amounts.
    """
    added = {}
    for target, aliases in CANONICAL_ALIASES.items():
        if target not in df.columns:
            hit = next((a for a in aliases if a in df.columns), None)
            if hit:
                added[target] = F.col(f"`{hit}`")
    return df.withColumns(added) if added else df


def choose_category(df: DataFrame) -> DataFrame:
    """Category column by presence: Category, Corrected Category, predicted_category."""
    if "Category" in df.columns:
        return df
    if "Corrected Category" in df.columns:
        return df.withColumnRenamed("Corrected Category", "Category")
    if "predicted_category" in df.columns:
        return df.withColumn("Category", F.col("predicted_category"))
    raise ValueError("no category column")


def default_account() -> Column:
    """Account that a source's rows are booked on when they name none."""
    source = F.col("transaction_source")
    return (F.when(source == CREDIT_CARD, DEFAULT_ACCOUNT[CREDIT_CARD])
            .otherwise(DEFAULT_ACCOUNT[HOUSEHOLD]))


def align_to(df: DataFrame, target: T.StructType) -> DataFrame:
    """Add the target's missing columns with their defaults, and match types.

    A value that cannot take the target type becomes null; ``cast_losses``
    counts these. Rows of several sources are aligned together.
    """
    added = {}
    for field in target.fields:
        if field.name in df.columns or field.name in LINEAGE_COLUMNS:
            continue
        if field.name == "Account":
            added[field.name] = default_account()
        elif field.name == "Amount (Raw)":
            added[field.name] = F.col("Amount") if "Amount" in df.columns else F.lit(0)
        elif field.name == "Entered":
            added[field.name] = F.lit(True)
        elif field.name == "Reconciled":
            added[field.name] = F.lit(False)
        else:
            added[field.name] = F.lit(None)
    return cast_to(df.withColumns(added) if added else df, target)


def convert(c: Column, have: T.DataType, want: T.DataType) -> Column:
    """Cast; texts are read leniently as dates (any known layout) and as money (grouping marks, signs)."""
    if isinstance(have, T.StringType) and isinstance(want, T.DateType):
        return lenient_date(c)
    if isinstance(have, T.StringType) and isinstance(want, T.DecimalType):
        return any_money(c).try_cast(want)
    return c.try_cast(want)


def cast_to(df: DataFrame, target: T.StructType) -> DataFrame:
    """Cast each shared column to the target's type."""
    types = {f.name: f.dataType for f in target.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    changed = {n: convert(F.col(f"`{n}`"), have[n], types[n])
               for n in df.columns if n in types and types[n] != have[n]}
    return df.withColumns(changed) if changed else df


def cast_losses(df: DataFrame, target: T.StructType) -> DataFrame:
    """One row per shared column of another type: values the cast would lose."""
    types = {f.name: f.dataType for f in target.fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    names = [n for n in df.columns if n in types and types[n] != have[n]]
    lost = [F.count_if(F.col(f"`{n}`").isNotNull()
                       & convert(F.col(f"`{n}`"), have[n], types[n]).isNull()).alias(n) for n in names]
    if not names:
        return df.sparkSession.createDataFrame([], "column_name string, lost_values long")
    return df.agg(*lost).unpivot([], names, "column_name", "lost_values")


def inject_source(df: DataFrame, default: Column) -> DataFrame:
    """Add the source column when the frame has none."""
    if "transaction_source" in df.columns:
        return df
    return df.withColumn("transaction_source", default)


def canonical(name: str, columns: list[str], default: Column) -> Column:
    """First present value over the accepted names the frame has."""
    names = [c for c in CANONICAL_ALIASES[name] if c in columns]
    return first_present([F.col(f"`{c}`") for c in names], default) if names else default


def prediction_projection(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Date, text, category, confidence and both amounts; absent amounts are null."""
    money = lambda n: (F.col(f"`{n}`") if n in df.columns
                       else F.lit(None).cast(MONEY)).alias(n)
    return df.select(*(extra or []), "Date", "Description", "Category", "Prediction_Confidence",
                     money("Amount (Negated)"), money("Amount"))


def accounting_projection(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Rows in the accounting system's import form."""
    cols = df.columns
    labels = [F.col(c) for c in ("Category", "predicted_category") if c in cols]
    empty, zero = F.lit(""), F.lit("0")
    return df.select(
        *(extra or []),
        canonical("Date", cols, empty).alias("Date"),
        canonical("Description", cols, empty).alias("Description"),
        lenient_money(canonical("Amount (Negated)", cols, zero)).alias("Amount (Negated)"),
        lenient_money(canonical("Amount", cols, zero)).alias("Amount"),
        (first_present(labels, empty) if labels else empty).alias("Classification"))


def review_view(df: DataFrame, keys: list[str]) -> DataFrame:
    """Prediction rows with names resolved and the correction pre-filled."""
    cols = df.columns
    return df.select(
        *keys,
        canonical("Date", cols, F.lit("")).alias("Date"),
        canonical("Description", cols, F.lit("")).alias("Description"),
        lenient_money(canonical("Amount (Negated)", cols, F.lit("0"))).alias("Amount (Negated)"),
        lenient_money(canonical("Amount", cols, F.lit("0"))).alias("Amount"),
        "predicted_category", F.col("predicted_category").alias("corrected_category"),
        "confidence", "transaction_source")


def debit_credit(df: DataFrame, amount: str) -> DataFrame:
    """Replace a signed amount by DEBIT and CREDIT."""
    out, inn = split_signed(F.col(amount))
    return df.withColumns({"DEBIT": out, "CREDIT": inn}).drop(amount)


def stamp_lineage(df: DataFrame, at: Column, version: Column) -> DataFrame:
    """Add when a correction was taken in and which model version it corrects."""
    return df.withColumns({"correction_timestamp": at,
                           "source_model_version": F.coalesce(version, F.lit("unknown"))})
