"""Missing-value rules and flexible coalescing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallywise.functions.dates import strip


def present(c: Column) -> Column:
    """The value itself, or null when it is blank or the text ``nan``."""
    s = c.cast("string")
    return F.when((strip(s) != "") & (F.lower(s) != "nan"), c)


def first_present(columns: list[Column], default: Column) -> Column:
    """First value that is not missing, else the default."""
    return F.coalesce(*[present(c) for c in columns], default)
