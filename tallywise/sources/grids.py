"""Cell grids of spreadsheets and statements to typed ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.constants import STATEMENT_PREAMBLE_ROWS
from tallywise.functions.dates import lenient_date
from tallywise.functions.money import any_money, bank_money
from tallywise.functions.text import normal_description
from tallywise.operators.schema import resolve_grid_columns
from tallywise.operators.validate import drop_incomplete

FIELDS = ["date", "description", "amount"]


def statement_rows(grid: DataFrame) -> DataFrame:
    """Bank statement rows: after the preamble, first three cells by position."""
    body = grid.where(F.col("row_no") >= STATEMENT_PREAMBLE_ROWS)
    return body.select("file", "row_no", *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)])


def normalise_statement(grid: DataFrame) -> DataFrame:
    """Typed bank statement rows with incomplete ones removed."""
    typed = statement_rows(grid).select(
        "file", "row_no", lenient_date(F.col("date")).alias("date"),
        normal_description(F.col("description")).alias("description"),
        bank_money(F.col("amount")).alias("amount"))
    return drop_incomplete(typed, FIELDS)


def normalise_grid(df: DataFrame, keys: list[str]) -> DataFrame:
    """Typed rows of a spreadsheet whose header names are only roughly known."""
    names = resolve_grid_columns([c for c in df.columns if c not in keys])
    typed = df.select(*keys, lenient_date(F.col(f"`{names['date']}`")).alias("date"),
                      normal_description(F.col(f"`{names['description']}`")).alias("description"),
                      any_money(F.col(f"`{names['amount']}`")).alias("amount"))
    return drop_incomplete(typed, FIELDS)


def unique_names(head: Column) -> Column:
    """Names of a header row: the second ``x`` is ``x.1``, a cell without text is ``Unnamed: 3`` by its ordinal."""
    named = F.transform(head, lambda c, i: F.coalesce(c, F.concat(F.lit("Unnamed: "), i.cast("string"))))

    def distinct(name: Column, i: Column) -> Column:
        earlier = F.size(F.filter(F.slice(named, F.lit(1), i), lambda other: other == name))
        counted = F.concat(name, F.lit("."), earlier.cast("string"))
        clash = F.array_contains(named, counted)
        return F.when(earlier == 0, name).when(clash, F.concat(counted, F.lit("#"), i.cast("string"))).otherwise(counted)

    return F.transform(named, distinct)


def heads(grid: DataFrame) -> DataFrame:
    """``(file, head_row, names)`` from the first row of each file that isn't blank."""
    first = grid.groupBy("file").agg(F.min("row_no").alias("head_row"), F.min_by("cells", "row_no").alias("head"))
    return first.select("file", "head_row", unique_names(F.col("head")).alias("names"))


def header_cells(grid: DataFrame) -> DataFrame:
    """``(file, ordinal, column)`` of each file's header."""
    return heads(grid).select("file", F.posexplode("names").alias("ordinal", "column"))


def body_cells(grid: DataFrame) -> DataFrame:
    """``(file, row_no, cells)`` with cells named by the file's own header, and rows numbered from the line after it.

    A short row has null for what it lacks; cells beyond the header are named by their ordinals.
    """
    more = F.transform(F.sequence(F.size("names"), F.greatest(F.size("names"), F.size("cells"))),
                       lambda i: F.concat(F.lit("Unnamed: "), i.cast("string")))
    width = F.greatest(F.size("names"), F.size("cells"))
    keys = F.slice(F.concat("names", more), F.lit(1), width)
    values = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.get("cells", i))
    body = grid.join(heads(grid), "file").where(F.col("row_no") > F.col("head_row"))
    return body.select("file", (F.col("row_no") - F.col("head_row") - 1).alias("row_no"), F.map_from_arrays(keys, values).alias("cells"))
