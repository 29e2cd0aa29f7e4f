"""Category dictionary: generation from account lists, and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallywise.constants import (BANK_FOREIGN_BASE, BANK_LOCAL_BASE, INVESTMENT_BASE,
                                 LOAN_ASSET_BASE, LOAN_LIABILITY_BASE, STAFF_BASE)

DEFAULT_FAMILIES = ("household_staff", "personal_loans", "bank_accounts", "investments")


def _path(*parts: str | Column) -> Column:
    return F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _names(config: DataFrame, field: str) -> DataFrame:
    return config.select(F.explode(field).alias("e"))


def title(c: Column) -> Column:
    """Upper-case first letter of every run of letters, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def staff_categories(config: DataFrame) -> DataFrame:
    e = _names(config, "household_staff")
    base = _path(STAFF_BASE, F.col("e.name"))
    roles = F.transform(F.coalesce("e.roles", F.array().cast("array<string>")),
                        lambda r: F.concat_ws(":", base, title(r)))
    return e.select(F.explode(F.concat(F.array(base), roles)).alias("category"))


def loan_categories(config: DataFrame) -> DataFrame:
    e = _names(config, "personal_loans")
    owed = _path(LOAN_LIABILITY_BASE, F.col("e.name"))
    kinds = F.transform(F.coalesce("e.types", F.array().cast("array<string>")),
                        lambda t: F.concat_ws(":", owed, title(t)))
    return e.select(F.explode(F.concat(
        F.array(_path(LOAN_ASSET_BASE, F.col("e.name")), owed), kinds)).alias("category"))


def bank_categories(config: DataFrame) -> DataFrame:
    e = _names(config, "bank_accounts")
    local = F.coalesce(F.col("e.type"), F.lit("local")) == "local"
    return e.select(F.when(local, _path(BANK_LOCAL_BASE, F.col("e.name")))
                    .otherwise(_path(BANK_FOREIGN_BASE, F.col("e.name"))).alias("category"))


def investment_categories(config: DataFrame) -> DataFrame:
    return _names(config, "investments").select(
        _path(INVESTMENT_BASE, F.col("e.name")).alias("category"))


def other_categories(config: DataFrame) -> DataFrame:
    return _names(config, "other_accounts").select(
        _path(LOAN_LIABILITY_BASE, F.col("e.name")).alias("category"))


def generate_categories(config: DataFrame, generic: DataFrame,
                        families: tuple[str, ...] = DEFAULT_FAMILIES) -> DataFrame:
    """Distinct categories of the enabled families, the other accounts and the generic list."""
    makers = {"household_staff": staff_categories, "personal_loans": loan_categories,
              "bank_accounts": bank_categories, "investments": investment_categories}
    parts = [generic.select("category")]
    parts += [makers[f](config) for f in DEFAULT_FAMILIES if f in families]
    parts.append(other_categories(config))
    return reduce(DataFrame.union, parts).distinct()


def dictionary_from_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct non-blank stripped lines."""
    text = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return lines.select(text.alias("category")).where(F.col("category") != "").distinct()


def with_path(dictionary: DataFrame) -> DataFrame:
    parts = F.split("category", ":")
    return dictionary.withColumns({"path": parts, "depth": F.size(parts)})


def valid_rows(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    return df.join(dictionary, df[label] == dictionary["category"], "left_semi")


def unknown_rows(df: DataFrame, label: str, dictionary: DataFrame) -> DataFrame:
    return df.join(dictionary, df[label] == dictionary["category"], "left_anti")
