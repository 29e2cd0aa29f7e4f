"""Numbers and money in text form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallywise.constants import CURRENCY_MARKS, NUMBER_PATTERN
from tallywise.functions.dates import strip

MONEY = "decimal(18,2)"


def lenient_number(c: Column, kind: str = "double") -> Column:
    """Number when the stripped text is a plain decimal number, else null."""
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast(kind))


def lenient_money(c: Column) -> Column:
    return lenient_number(c, MONEY)


def bank_money(c: Column) -> Column:
    """``PHP 1,234.50`` to a number."""
    return lenient_money(F.replace(F.replace(c, F.lit("PHP "), F.lit("")), F.lit(","), F.lit("")))


def any_money(c: Column) -> Column:
    """Money text with any known currency mark; parentheses mean negative."""
    bare = reduce(lambda s, m: F.replace(s, F.lit(m), F.lit("")), CURRENCY_MARKS, c)
    return lenient_money(F.translate(bare, "(,)", "-"))


def percent_to_ratio(c: Column) -> Column:
    """``52.33%`` to 0.5233."""
    return lenient_number(F.replace(c, F.lit("%"), F.lit(""))) / F.lit(100.0)


def ratio_to_percent(c: Column, digits: int = 2) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100.0), F.lit("%"))


def human_size(size: Column) -> Column:
    """Bytes as ``KB`` below one MiB, else ``MB``, with one decimal."""
    mib = 1024 * 1024
    # half-even, as C and Python format an exact tie
    kb, mb = F.bround(size / F.lit(1024.0), 1), F.bround(size / F.lit(float(mib)), 1)
    return (F.when(size < mib, F.format_string("%.1f KB", kb))
            .otherwise(F.format_string("%.1f MB", mb)))


def split_signed(amount: Column) -> tuple[Column, Column]:
    """Signed amount to (money out, money in); a null gives zero on both sides."""
    zero = F.lit(0).cast(MONEY)
    return (F.when(amount > 0, amount).otherwise(zero),
            F.when(amount < 0, -amount).otherwise(zero))
