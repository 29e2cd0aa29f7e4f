"""File-name conventions: ``{source}[_{period}]_{stage}_{yyyyMMdd_HHmmss}.{ext}``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tallywise.constants import SOURCE_NAME_MAP, STAGES
from tallywise.functions.dates import parse_with, strip

STAMP = "yyyyMMdd_HHmmss"
PERIOD = r"\d{4}-\d{2}"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(name: Column) -> Column:
    """Name without folder and without its last extension."""
    return F.regexp_replace(base_name(name), r"^(.+)\.[^.]+$", "$1")


def extension(name: Column) -> Column:
    """Lower-case last extension with its dot, or the empty text."""
    return F.lower(F.regexp_extract(base_name(name), r"^.+(\.[^.]+)$", 1))


def period_of(name: Column) -> Column:
    return blank_to_null(F.regexp_extract(F.lower(stem(name)), f"({PERIOD})", 1))


def _case(pairs, test, default: Column) -> Column:
    branches = [(test(key), F.lit(value)) for key, value in pairs]
    first = F.when(*branches[0])
    return reduce(lambda acc, b: acc.when(*b), branches[1:], first).otherwise(default)


def standard_source(text: Column) -> Column:
    """Free bank text to its standard lower-case name."""
    clean = F.regexp_replace(F.lower(strip(text)), r"[^\p{L}\p{N}_\s]", "")
    joined = F.regexp_replace(clean, r"\s+", "_")
    has = lambda word: F.contains(joined, F.lit(word))
    loose = (F.when(has("union") & has("bank"), "unionbank_visa")
             .when(has("bpi"), "bpi_mastercard")
             .when(has("house") | has("kitty") | has("cash"), "household_cash")
             .otherwise(F.coalesce(blank_to_null(joined), F.lit("unknown"))))
    return _case(SOURCE_NAME_MAP, lambda key: clean == key, loose)


def source_of(name: Column) -> Column:
    """Standard source of a statement file name."""
    low = F.lower(stem(name))
    bank = F.regexp_extract(low, r"automl.*statement.*?([a-z]+(?:\s+[a-z]+)?)", 1)
    other = F.when(bank != "", standard_source(bank)).otherwise(F.lit("unknown"))
    return _case(SOURCE_NAME_MAP, lambda key: F.contains(low, F.lit(key)), other)


def build_name(source: Column, period: Column, stage: Column, stamp: Column,
               ext: str = "csv") -> Column:
    """Standard name; ``stamp`` is already in ``yyyyMMdd_HHmmss`` form."""
    return F.concat(F.concat_ws("_", source, blank_to_null(period), stage, stamp),
                    F.lit(f".{ext}"))


def parse_name(name: Column) -> Column:
    """Struct of source, period, stage, timestamp; nulls when too few parts."""
    parts = F.split(stem(name), "_")
    n = F.size(parts)
    head = F.slice(parts, F.lit(1), F.greatest(n - 3, F.lit(0)))
    period = F.try_element_at(F.filter(head, lambda p: p.rlike(f"^{PERIOD}")), F.lit(1))
    before = F.coalesce(F.array_position(head, period) - 1, F.size(head).cast("long"))
    source = blank_to_null(F.array_join(F.slice(head, F.lit(1), before.cast("int")), "_"))
    enough = n >= 4
    return F.struct(
        F.when(enough, source).alias("source"),
        F.when(enough, period).alias("period"),
        F.when(enough, F.try_element_at(parts, F.lit(-3))).alias("stage"),
        F.when(enough, F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), "_"))
         .alias("timestamp"),
    )


def stamp_is_valid(stamp: Column) -> Column:
    return parse_with(stamp, STAMP).isNotNull()


def name_is_standard(name: Column) -> Column:
    p = parse_name(name)
    ok = (p["source"].isNotNull() & p["stage"].isin(STAGES) & stamp_is_valid(p["timestamp"]))
    return F.coalesce(ok, F.lit(False))


def legacy_stamp(name: Column) -> Column:
    """Date and time parts of an old job file name, or null."""
    parts = F.split(stem(name), "_")
    dated = F.filter(parts, lambda p: p.rlike(r"^\d{8}"))
    day = F.try_element_at(dated, F.lit(1))
    time = F.try_element_at(parts, (F.array_position(parts, day) + 1).cast("int"))
    stamp = F.when(time.rlike(r"^\d{6}"), F.concat_ws("_", day, time))
    return F.when(stamp_is_valid(stamp), stamp)


def legacy_name(name: Column, stage: Column, now_stamp: Column) -> Column:
    return build_name(F.lit("legacy_file"), F.lit(None).cast("string"), stage,
                      F.coalesce(legacy_stamp(name), now_stamp))


def next_stage_name(name: Column, stage: str, now_stamp: Column) -> Column:
    """The same run's name at another stage.

    An accounting name can also come from a name that doesn't follow the
    convention; other stages need a standard name and give null without one.
    """
    p = parse_name(name)
    usable = p["source"].isNotNull() & p["stage"].isNotNull() & stamp_is_valid(p["timestamp"])
    usable = F.coalesce(usable, F.lit(False))
    moved = F.when(usable, build_name(p["source"], p["period"], F.lit(stage), p["timestamp"]))
    if stage == "accounting":
        return F.coalesce(moved, legacy_name(name, F.lit(stage), now_stamp))
    return moved


def strip_upload_prefix(name: Column) -> Column:
    """Fourth part of a name split into at most four at underscores."""
    return F.coalesce(F.try_element_at(F.split(name, "_", 4), F.lit(4)), name)


def household_output_name(name: Column, this_month: Column) -> Column:
    month = blank_to_null(F.regexp_extract(
        base_name(name), rf"House Kitty Transactions - Cash ({PERIOD})\.csv", 1))
    return F.concat(F.lit("House Kitty Transactions - Cash - Corrected "),
                    F.coalesce(month, this_month), F.lit(".csv"))


def version_in(name: Column) -> Column:
    """Number after the first ``v`` that digits follow, else null."""
    return blank_to_null(F.regexp_extract(name, r"v(\d+)", 1)).try_cast("int")
