"""SimHash near-dedup with deletion-variant signatures.

A fingerprint is cut into segments of at most 32 bits, so many that of two
fingerprints within the radius one segment differs by at most one bit: two of
32 bits for radius 2, 13 of about 20 bits for radius 24 in 256. Every segment
is indexed under its variants with one wildcard bit; fingerprints that share a
variant are joined by equality and verified.
Only distinct fingerprints are indexed, so copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tallywise.llm.common import components, cross_pairs, id_and_bytes, save, prepare_workers, sized

SEED = 42
SEGMENT = 32
PAIRED = 64  # buckets of up to so many fingerprints are paired; larger ones are split exactly
LEADERS = 32  # of a large bucket: met by all its members first
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
LANES = np.uint64(0x0101010101010101)
STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(body: bytes, words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` words, repeats included; of the whole sequence if it is shorter."""
    tokens = body.translate(LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:len(tokens) - words + 1].tolist(), ends[words - 1:].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set; bit 0 is the lowest."""
    cuts = np.arange(0, len(hashes), 255)  # eight counters of a byte each in one word
    out = np.empty(64, np.int64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cuts)
        out[bit::8] = sums.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out


def fingerprint(body: bytes, words: int, lanes: int) -> list[int]:
    """``lanes`` signed 64-bit numbers; a bit is set if over half the shingle hashes have it. No word: zeros."""
    hashes = shingle_hashes(body, words)
    if not len(hashes):
        return [0] * lanes
    out = []
    for lane in range(lanes):
        if lane:  # further hashes of a shingle are mixes of its first
            mixed = hashes + STEP * np.uint64(lane)
            mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            mixed ^= mixed >> np.uint64(31)
        else:
            mixed = hashes
        bits = (2 * bit_counts(mixed) > len(hashes)).astype(np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def fingerprints(spark: SparkSession, docs: DataFrame, words: int, lanes: int = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id and print (array of ``lanes`` longs) of every row."""
    prepare_workers(spark)
    rows = id_and_bytes(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(b, words, lanes) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.list_(pa.int64()))],
                                             names=["doc_id", "print"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("print", T.ArrayType(T.LongType())))


def distance(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def segment_ends(lanes: int, radius: int) -> list[int]:
    """Where to cut 64 * lanes bits: over radius / 2 segments, of which one differs by at most one bit; none over 32 bits."""
    count = max(2 * lanes, radius // 2 + 1)
    if count > 64 * lanes:
        raise ValueError("the radius is too wide for so few lanes")
    return [64 * lanes * k // count for k in range(count + 1)]


def segment_variants(nodes: DataFrame, ends: list[int]) -> DataFrame:
    """(variant, node): every segment of every fingerprint with each of its bits masked in turn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            prints = np.array(batch.column("print").to_pylist(), "<i8")
            bits = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little")
            node = batch.column("node").to_numpy()
            for segment, (low, high) in enumerate(zip(ends, ends[1:])):
                held = np.zeros((len(bits), SEGMENT), np.uint8)
                held[:, :high - low] = bits[:, low:high]
                value = np.packbits(held, axis=1, bitorder="little").view("<u4")  # one column
                bit = np.arange(high - low, dtype=np.uint64)[None, :]
                masked = value.astype(np.uint64) & ~(np.uint64(1) << bit)
                keys = ((np.uint64(segment * SEGMENT) + bit) << np.uint64(SEGMENT)) | masked
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).astype(np.int64)), pa.array(np.repeat(node, high - low))],
                                                 names=["variant", "node"])

    return nodes.mapInArrow(run, "variant long, node long")


def ball_edges(nodes: DataFrame) -> DataFrame:
    """Links of two or fewer bits among one-lane fingerprints, as stars.

    Two fingerprints are that close exactly when some value lies within one bit
    of both. All fingerprints around one value, at most 65, are linked to each
    other, so an edge to the smallest node loses no link.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(-(1 << 63) if b == 63 else 1 << b).cast("long") for b in range(64)])
    points = nodes.select("node", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("print")[0]))).alias("point"))
    stars = points.groupBy("point").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").drop("n")
    return points.join(sized(stars), "point").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()


def large_edges(spark: SparkSession, members: DataFrame, edges: DataFrame, radius: int, lanes: int, paired: int) -> DataFrame:
    """``edges`` and what large buckets add to their groups.

    All members meet some leaders of their bucket. After that only pairs of
    different groups can add anything: these are all compared, in blocks.
    """
    place = F.row_number().over(Window.partitionBy("variant").orderBy("node"))
    lead = (members.withColumn("place", place).where(F.col("place") <= LEADERS)
            .groupBy("variant").agg(F.collect_list(F.struct("node", "print")).alias("leaders")))
    rows = members.count()
    near = F.filter("leaders", lambda x: (x["node"] != F.col("node")) & (distance("print", x["print"]) <= radius))
    met = members.join(sized(lead, rows), "variant").select(F.col("node").alias("a"), F.explode(F.transform(near, lambda x: x["node"])).alias("b"))
    edges = save(spark, edges.union(met.distinct()), "met")
    roots = save(spark, components(spark, edges), "roots")
    placed = members.join(sized(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = (placed.groupBy("variant").agg(F.count("*").alias("size"), F.min("root").alias("r"), F.max("root").alias("s"))
             .where("r < s").drop("r", "s"))
    rest = placed.join(sized(mixed, rows), "variant").withColumnRenamed("variant", "bucket")

    def close(a: str, b: str) -> Column:
        bits = (F.bit_count(F.col(f"{a}.print")[k].bitwiseXOR(F.col(f"{b}.print")[k])) for k in range(lanes))
        return sum(bits, F.lit(0)) <= radius

    return edges.union(cross_pairs(rest, paired, close))


def pair_edges(members: DataFrame, radius: int) -> DataFrame:
    """Equality self-join on the variant, then the distance of the whole fingerprints."""
    left = members.select("variant", F.col("node").alias("a"), F.col("print").alias("print_a"))
    right = members.select("variant", F.col("node").alias("b"), F.col("print").alias("print_b"))
    return (left.join(sized(right, members.count()), "variant").where("a > b").where(distance("print_a", "print_b") <= radius)
            .select("a", "b").distinct())


def links(spark: SparkSession, nodes: DataFrame, lanes: int, radius: int, paired: int) -> DataFrame:
    """Edges (a, b) of ``radius`` or fewer bits that give the same groups as all such pairs."""
    variants = segment_variants(nodes, segment_ends(lanes, radius))
    shared = variants.groupBy("variant").agg(F.count("*").alias("n")).where("n > 1")
    members = save(spark, variants.join(sized(shared), "variant").join(sized(nodes, nodes.count()), "node"), "members")
    edges = pair_edges(members.where(F.col("n") <= paired), radius)
    large = members.where(F.col("n") > paired).drop("n")
    if large.isEmpty():
        return edges
    if radius <= 2 and lanes == 1:
        return edges.union(ball_edges(large.select("node", "print").distinct()))
    return large_edges(spark, large, edges, radius, lanes, paired)


def near_groups(spark: SparkSession, docs: DataFrame, words: int = 3, lanes: int = 1, radius: int = 2,
                id_col: str = "doc_id", text_col: str = "text", paired: int = PAIRED) -> DataFrame:
    """One row per input row: doc_id, fingerprint (lower-case hex, highest bit first), component_id.

    Fingerprints are linked when they differ in ``radius`` or fewer bits.
    ``component_id`` is the smallest id that links reach. With a radius
    of 2 or less large buckets are searched by :func:`ball_edges`, else by
    :func:`large_edges`; neither loses a group, whatever the size of a bucket.

    A-Z are lower-cased; words are separated by ASCII white space; a text of
    fewer words than a shingle is one shingle; null, empty and blank texts have
    fingerprint zero and are linked like any other. Null ids get the component
    of their text and never name one, unless no other id is in it. An empty
    table gives an empty result; other columns are ignored.
    """
    prints = save(spark, fingerprints(spark, docs, words, lanes, id_col, text_col), "prints")
    nodes = save(spark, prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"))
                 .withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = links(spark, nodes.select("node", "print"), lanes, radius, paired)
    roots = components(spark, edges).select("node", "root")
    rows = nodes.count()  # no table below has more, but for the result
    classed = nodes.join(sized(roots, rows), "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classed = save(spark, classed.join(sized(low, rows), "root").select("print", "component_id"), "classes")
    text = F.lower(F.array_join(F.transform("print", lambda p: F.lpad(F.hex(p), 16, "0")), ""))
    return prints.join(sized(classed, rows), "print").select("doc_id", text.alias("fingerprint"), "component_id")
