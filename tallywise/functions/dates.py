"""Lenient date parsing."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# fixed values: accepted date layouts, in order
DATE_FORMATS = ["yyyy-MM-dd", "M/d/yyyy", "yyyy-MM-dd HH:mm:ss"]


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# fixed values: the digits each format letter run stands for
FIELD_SHAPES = {
    "yyyy": r"\d{4}", "M": r"(0?[1-9]|1[0-2])", "MM": r"(0[1-9]|1[0-2])",
    "d": r"(0?[1-9]|[12]\d|3[01])", "dd": r"(0[1-9]|[12]\d|3[01])",
    "HH": r"([01]\d|2[0-3])", "mm": r"[0-5]\d", "ss": r"[0-5]\d",
}


def shape_of(fmt: str) -> str:
    """Pattern of the texts a numeric format can read."""
    runs = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", fmt)
    return "^" + "".join(re.escape(other) if other else FIELD_SHAPES[a + more]
                         for a, more, other in runs) + "$"


def parse_with(s: Column, fmt: str) -> Column:
    """Timestamp read in one format, else null.

    The shape is tested first, because a failed parse costs an exception per
    row and most failures are texts of another layout.
    """
    return F.when(s.rlike(shape_of(fmt)), F.try_to_timestamp(s, F.lit(fmt)))


def lenient_date(c: Column, formats: list[str] | None = None) -> Column:
    """Date of the first layout that fits, else null. Formats are numeric."""
    s = strip(c.cast("string"))
    return F.coalesce(*[parse_with(s, f) for f in (formats or DATE_FORMATS)]).cast("date")
