"""Ordered computations that never put a whole hot key into one task.

A plain window sorts all rows of a key in one task, which is right for ordinary
keys. Keys with more than ``HOT_ROWS`` rows are cut into buckets of their order
column: totals per (key, bucket) give every bucket its starting value, and the
row-level window then runs per (key, bucket). Buckets must follow the order: a
row in a smaller bucket comes before every row in a larger one. Several bucket
levels, coarse to fine, keep both the row groups and the lists of totals small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallywise.session import materialise

Buckets = Column | list[Column]

# rows of one key that one task may sort
HOT_ROWS = 2_000_000


def _levels(bucket: Buckets) -> dict[str, Column]:
    columns = bucket if isinstance(bucket, list) else [bucket]
    return {f"_bucket{i}": c for i, c in enumerate(columns)}


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows.

    There is at most one such key per ``hot_rows`` rows of the table, which
    bounds the list well enough to broadcast it.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return F.broadcast(counts.where(F.col("_rows") > hot_rows).select(*keys, F.lit(True).alias("_hot")))


def mark_hot(df: DataFrame, keys: list[str], levels: dict[str, Column], hot_rows: int) -> DataFrame:
    """Add the bucket columns, filled for hot keys and null for all others."""
    marked = df.join(hot_keys(df, keys, hot_rows), keys, "left")
    return marked.withColumns({n: F.when(F.col("_hot"), c) for n, c in levels.items()})


def running_sums(df: DataFrame, keys: list[str], bucket: Buckets, order: list[Column],
                 sums: dict[str, Column], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add inclusive running sums per key. Keys must not be null."""
    levels = _levels(bucket)
    names = list(levels)
    cut = mark_hot(df, keys, levels, hot_rows)
    finest = cut.where("_hot").groupBy(*keys, *names).agg(
        *[F.sum(e).alias(f"_sum_{n}") for n, e in sums.items()])
    starts = None
    for depth, level in enumerate(names):
        above = [*keys, *names[:depth]]
        totals = finest if depth == len(names) - 1 else finest.groupBy(*above, level).agg(
            *[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums])
        earlier = (Window.partitionBy(*above).orderBy(level)
                   .rowsBetween(Window.unboundedPreceding, -1))
        here = totals.select(*above, level, *[
            F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_start{depth}_{n}")
            for n in sums])
        starts = here if starts is None else here.join(starts, above)
    inside = (Window.partitionBy(*keys, *names).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = cut.select("*", *[F.coalesce(F.sum(e).over(inside), F.lit(0)).alias(f"_local_{n}")
                              for n, e in sums.items()])
    joined = local.join(starts, [*keys, *names], "left")
    start = lambda d, n: F.coalesce(F.col(f"_start{d}_{n}"), F.lit(0))
    return joined.select(*df.columns, *[
        reduce(lambda a, d: a + start(d, n), range(len(names)), F.col(f"_local_{n}")).alias(n)
        for n in sums])


def row_ordinals(df: DataFrame, keys: list[str], bucket: Buckets, order: list[Column],
                 name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sums(df, keys, bucket, order, {name: F.lit(1).cast("long")}, hot_rows)


def positions(df: DataFrame, order: list[Column], name: str, ranges: int | None = None) -> DataFrame:
    """Add the 1-based position of each row in one order over the whole table.

    Rows are dealt into ranges of the order, sorted there and written once with their range and place. The
    sizes of the ranges, one line each, give every range its start. No window runs over rows, and the only
    exchange of rows is the one into ranges. Ranges are cut between different values of ``order``, so it
    should end in a row key; rows equal in all of it stay in one task, in any order.
    """
    place = F.monotonically_increasing_id()  # the task in the upper bits, the row within the task below
    dealt = df.repartitionByRange(ranges, *order) if ranges else df.repartitionByRange(*order)
    stored = materialise(df.sparkSession, dealt.sortWithinPartitions(*order).withColumn("_place", place), "positions")
    row, task = F.col("_place").bitwiseAND(2**33 - 1), F.shiftright("_place", 33)
    sizes = stored.groupBy(task.alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    # one line per task of the exchange: one partition is enough
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    placed = stored.join(F.broadcast(starts), task == F.col("_range"))
    return placed.select(*df.columns, (F.col("_start") + row + 1).alias(name))


def previous_values(df: DataFrame, keys: list[str], bucket: Column, order: list[str],
                    columns: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the previous row's value of each column within its key.

    ``columns`` maps new name to source column. The first row of a hot key's
    bucket takes the last row of the nearest earlier bucket.
    """
    cut = mark_hot(df, keys, {"_bucket": bucket}, hot_rows)
    names = [*keys, "_bucket"]
    last = F.max_by(F.struct(*[F.col(s).alias(n) for n, s in columns.items()]),
                    F.struct(*order))
    ends = cut.where("_hot").groupBy(*names).agg(last.alias("_last"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")
    carried = ends.select(*names, F.lag("_last").over(by_bucket).alias("_carried"))
    inside = Window.partitionBy(*names).orderBy(*order)
    local = cut.select("*", F.row_number().over(inside).alias("_pos"),
                       *[F.lag(s).over(inside).alias(f"_lag_{n}") for n, s in columns.items()])
    joined = local.join(carried, names, "left")
    return joined.select(*df.columns, *[
        F.when(F.col("_pos") == 1, F.col(f"_carried.{n}")).otherwise(F.col(f"_lag_{n}")).alias(n)
        for n in columns])


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int,
               name: str = "_pos") -> DataFrame:
    """First ``n`` rows per key, with their position.

    The rank filter is pushed below the shuffle, so each task forwards at most
    ``n`` rows of a key.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= n)


def exact_median(df: DataFrame, keys: list[str], value: str, bucket: Buckets,
                 name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median per key; nulls are skipped.

    The built-in exact percentile holds all distinct values of a group in one
    task, so it serves only keys of ordinary size; hot keys are narrowed down.
    """
    filled = df.where(F.col(value).isNotNull()).select(*keys, value, *[
        c.alias(n) for n, c in _levels(bucket).items()])
    hot = hot_keys(filled, keys, hot_rows)
    plain = (filled.join(hot, keys, "left_anti").groupBy(*keys)
             .agg(F.median(value).alias(name)))
    return plain.unionByName(narrowed_median(
        filled.join(hot, keys, "left_semi"), keys, value, list(_levels(bucket)), name))


def narrowed_median(df: DataFrame, keys: list[str], value: str, levels: list[str],
                    name: str) -> DataFrame:
    """Exact median by narrowing down through the bucket columns ``levels``.

    Each step counts rows per bucket, which combines on the map side to one
    number per bucket, and keeps only the one or two buckets that hold the
    middle positions. Only their rows are ever sorted.
    """
    rows = df.withColumnRenamed(value, "_v")
    low, high = F.expr("(_total + 1) div 2"), F.expr("(_total + 2) div 2")
    holds = lambda k: (F.col("_upto") >= k) & (F.col("_upto") - F.col("_n") < k)

    def place(counts: DataFrame, above: list[str], level: str) -> DataFrame:
        upto = (Window.partitionBy(*above).orderBy(level)
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return counts.withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))

    seen, held = list(keys), None
    for level in levels:
        near = rows if held is None else rows.join(held, seen)
        carried = [] if held is None else ["_before", "_total"]
        counts = near.groupBy(*seen, level, *carried).agg(F.count(F.lit(1)).alias("_n"))
        if held is None:
            counts = counts.withColumns({
                "_before": F.lit(0).cast("long"),
                "_total": F.sum("_n").over(Window.partitionBy(*keys))})
        held = (place(counts, seen, level).where(holds(low) | holds(high))
                .select(*seen, level, (F.col("_upto") - F.col("_n")).alias("_before"), "_total"))
        seen = [*seen, level]
    counts = rows.join(held, seen).groupBy(*seen, "_v", "_before", "_total").agg(
        F.count(F.lit(1)).alias("_n"))
    last = place(counts, seen, "_v")
    return last.groupBy(*keys).agg(
        ((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2)
        .alias(name))
