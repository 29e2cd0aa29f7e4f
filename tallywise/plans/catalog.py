"""Registry of bound queries and the form their results are compared in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Plain result types: double for money, long for counts, ISO text for dates."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a bound query, with the SQL that gives the same rows."""
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, d: plain(fn(spark, d))
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def text_of_list(c: Column, sep: str = "|") -> Column:
    return F.array_join(c, sep)


def text_of_map(c: Column) -> Column:
    """``k=v`` pairs sorted by key."""
    entries = F.array_sort(F.map_entries(c))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(
        "=", e["key"].cast("string"), e["value"].cast("string"))), ";")
