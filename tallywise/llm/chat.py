"""Chat formatting: collapse cumulative snapshots, then render.

A chat log often stores a conversation again after every turn. A rolling hash
over (place, role, text) names every turn prefix of a conversation; one whose
last hash occurs as a prefix of a longer one is a snapshot and goes. Column
functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallywise.llm.common import save

BLOCK = 512  # turns of one conversation that a window or a rendered row holds


def number_turns(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """conv, place (from 0, by turn, role, text), role, body, and the rolling prefix hashes h1, h2.

    A conversation of any length is spread: turns are first dealt into blocks
    by rank-free turn ranges, totals per block give each block its first place
    and the hash of all before it, then windows run inside the blocks.
    """
    rows = turns.select(F.col("conv_id").alias("conv"), F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("body"), F.floor(F.col("turn") / BLOCK).alias("block"),
                        F.monotonically_increasing_id().alias("row"))
    rows = save(spark, rows, "turns")
    key = ["conv", "block"]
    order = [F.col("turn").asc_nulls_first(), "role", "body", "row"]
    before = Window.partitionBy("conv").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.count("*").alias("n"))
    starts = starts.select(F.col("conv").alias("conv_s"), F.col("block").alias("block_s"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_place"))
    same = F.col("conv").eqNullSafe(F.col("conv_s")) & F.col("block").eqNullSafe(F.col("block_s"))
    placed = (rows.join(starts, same).withColumn("place", F.col("first_place") + F.row_number().over(
        Window.partitionBy(*key).orderBy(*order)) - 1))
    placed = save(spark, placed.select("conv", "block", "place", "role", "body",
                                       *[F.xxhash64(F.lit(seed), "place", "role", "body").alias(f"t{seed}") for seed in (1, 2)]),
                  "places")
    heads = placed.groupBy(*key).agg(*[F.bit_xor(f"t{s}").alias(f"x{s}") for s in (1, 2)])
    heads = heads.select(F.col("conv").alias("conv_s"), F.col("block").alias("block_s"),
                         *[F.coalesce(F.bit_xor(f"x{s}").over(before), F.lit(0)).alias(f"b{s}") for s in (1, 2)])
    run = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(heads, same).select(
        "conv", "place", "role", "body",
        *[F.col(f"b{s}").bitwiseXOR(F.bit_xor(f"t{s}").over(run)).alias(f"h{s}") for s in (1, 2)])


def collapse(spark: SparkSession, numbered: DataFrame) -> DataFrame:
    """Maximal conversations: conv, n_turns. Of equal ones the smallest id stays (a null id only if alone)."""
    ends = numbered.groupBy("conv").agg(F.count("*").alias("n_turns"),
                                        *[F.max_by(h, "place").alias(h) for h in ("h1", "h2")])
    whole = ends.groupBy("n_turns", "h1", "h2").agg(F.min("conv").alias("conv"))
    # prefixes that end before the last turn; equal ones are one row
    last = ends.select(F.col("conv").alias("conv_e"), F.col("n_turns").alias("n_e"))
    inner = (numbered.join(last, F.col("conv").eqNullSafe(F.col("conv_e"))).where("place + 1 < n_e")
             .select((F.col("place") + 1).alias("n_turns"), "h1", "h2").distinct())
    return whole.join(inner, ["n_turns", "h1", "h2"], "left_anti").select("conv", "n_turns")


def format_chats(spark: SparkSession, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns, first_turn_place, turns_in_part, rendered.

    ``turns`` has conv_id, turn, role, text. A turn is rendered as
    ``<|role|>``, a line break, the text, ``<|end|>`` and a line break. A
    conversation of more than ``block`` turns comes in several parts, in order,
    so that no row grows without bound; the parts joined are the whole. Null
    roles read ``unknown``, null texts are empty; turns order by number (nulls
    first), then role, then text; repeated turns are all kept. Rows with a null
    conv_id are one conversation. An empty table gives an empty result; other
    columns are ignored.
    """
    numbered = save(spark, number_turns(spark, turns), "prefixes")
    kept = collapse(spark, numbered).select(F.col("conv").alias("conv_k"), "n_turns")
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("<|end|>\n"))
    parts = (numbered.join(kept, F.col("conv").eqNullSafe(F.col("conv_k")))
             .select("conv", "n_turns", F.floor(F.col("place") / block).alias("part"), "place", piece.alias("piece"))
             .groupBy("conv", "n_turns", "part")
             .agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("pieces")))  # at most ``block``
    return parts.select(F.col("conv").alias("conv_id"), "part", "n_turns", F.col("pieces")[0]["place"].alias("first_place"),
                        F.size("pieces").cast("long").alias("turns_in_part"),
                        F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"))
