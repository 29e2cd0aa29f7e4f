"""Near copies by the exact Jaccard similarity of five-word shingle sets.

Two sets of similarity 4/5 or more share a shingle among the first
``n - ceil(4n/5) + 1`` of each, whatever order all sets are sorted in (prefix
filter). SimHash fingerprints within two bits and shared shingles bring sets
together, a parity sketch rules out pairs that differ in too many shingles for
certain, and every other pair is counted shingle by shingle. Rows that links already hold together are not compared
again, which loses no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise.llm import simhash
from tallywise.llm.common import components, cross_pairs, prepare_workers, remove, save, saved, shuffles_dropped, sized, text_or_empty
from tallywise.llm.simhash import LOWER, SEED, bit_counts

WORDS = 5
SKETCH = 16  # longs of a parity sketch; sets of over 1,024 shingles have longer ones
PAIRED = 64  # shingles shared by so many sets are paired at once; others after rounds of stars
ROUNDS = 3
RADIUS = 2  # of SimHash fingerprints that propose a pair
SAMPLED, COMMON, MOST_COMMON = 16, 3, 250_000  # every so manyth text is read to find common shingles; seen in so many; kept
KNOWN_WORDS = 200_000
BROADCAST_MARKS = 1_000_000  # hashes of texts, 8 bytes each; with more, texts are shuffled to them
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(body: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct runs of five words; of the whole sequence if it is shorter."""
    tokens = body.translate(LOWER).split()  # bytes split at 0x20 and 0x09 to 0x0D
    if not tokens:
        return np.zeros(0, np.int64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for t in set(tokens).difference(known):
        known[t] = xxhash.xxh64_intdigest(t, SEED)
    words = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    runs = max(len(tokens) - WORDS + 1, 1)
    hashes = np.full(runs, min(len(tokens), WORDS), np.uint64)
    for k in range(min(len(tokens), WORDS)):
        hashes = mix(hashes * MULTIPLIER + words[k:k + runs])
    return np.unique(hashes.view(np.int64))


def held_in(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in an ascending list; the list is searched, not sorted anew for every text."""
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def prefix(shingles: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which a set of similarity 4/5 has one in its own prefix; common shingles come last."""
    n = len(shingles)
    if n < 4:  # similar to equal sets only
        return shingles[:0]
    late = held_in(shingles, common)
    return np.concatenate([shingles[~late], shingles[late]])[:n - (4 * n + 4) // 5 + 1]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity of the shingles in each of 1,024 places or more; two sketches differ in no more bits than the sets in shingles."""
    places = max(64 * SKETCH, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount(shingles.view(np.uint64).astype(np.int64) & (places - 1), minlength=places) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def fingerprint(shingles: np.ndarray) -> int:
    """SimHash of the set: a bit is set if over half of the shingle hashes have it."""
    if not len(shingles):
        return 0
    bits = (2 * bit_counts(shingles.view(np.uint64)) > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def signatures(spark: SparkSession, texts: DataFrame, common: np.ndarray) -> DataFrame:
    """From rows of id, mark and body: node (hash of the set), n, fingerprint, sketch and prefix instead of body."""
    prepare_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(b, known) for b in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"),
                 pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([fingerprint(s) for s in sets], pa.int64()),
                 pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                 pa.array([prefix(s, common) for s in sets], pa.list_(pa.int64()))],
                names=["doc_id", "mark", "node", "n", "print", "sketch", "prefix"])

    schema = ", ".join(["mark long", "node long", "n long", "print long", "sketch array<long>", "prefix array<long>"])
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, {schema}")


def shingle_sets(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """node and shingles of every text."""
    prepare_workers(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(b, known) for b in batch.column("body").to_pylist()]
            nodes = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    return texts.select("body").mapInArrow(run, "node long, shingles array<long>")


def common_shingles(spark: SparkSession, texts: DataFrame) -> np.ndarray:
    """Shingles that many texts hold, by a share of all texts. They only set the order, so no link depends on the sample."""
    seen = shingle_sets(spark, texts.where(F.pmod("mark", F.lit(SAMPLED)) == 0)).select(F.explode("shingles").alias("s"))
    counts = seen.groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.array(sorted(r.s for r in counts.orderBy(F.desc("n"), "s").limit(MOST_COMMON).collect()), np.int64)


def folded(sketch_: Column, longs: Column) -> Column:
    """A sketch of half as many places, or the sketch itself where it has ``longs`` already."""
    half = F.transform(F.sequence(F.lit(0), longs - 1), lambda i: F.get(sketch_, i).bitwiseXOR(F.get(sketch_, i + longs)))
    return F.when(F.size(sketch_) > longs, half).otherwise(sketch_)


def apart(a: str, b: str) -> Column:
    """Bits in which the sketches of two sets differ whose sizes are within 4/5, so that one is folded once at most."""
    x, y = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")
    short = sum((F.bit_count(x[k].bitwiseXOR(y[k])) for k in range(SKETCH)), F.lit(0))
    longs = F.least(F.size(x), F.size(y))
    bits = F.zip_with(folded(x, longs), folded(y, longs), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.when((F.size(x) == SKETCH) & (F.size(y) == SKETCH), short).otherwise(F.aggregate(bits, F.lit(0), lambda s, v: s + v))


def sizes_fit(a: str, b: str) -> Column:
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def can_be_near(a: str, b: str) -> Column:
    """False only if sizes or sketches rule out a similarity of 4/5."""
    return sizes_fit(a, b) & (9 * apart(a, b) <= F.col(f"{a}.n") + F.col(f"{b}.n"))


def simhash_pairs(spark: SparkSession, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints differ in ``RADIUS`` bits or fewer, as far as they join groups."""
    prints = save(spark, sets.groupBy("print").agg(F.min("node").alias("node")).select("node", F.array("print").alias("print")), "prints")
    equal = sets.join(sized(prints.select(F.col("print")[0].alias("print"), F.col("node").alias("b")), prints.count()), "print")
    return (equal.where("node <> b").select(F.col("node").alias("a"), "b")
            .union(simhash.links(spark, prints, 1, RADIUS, simhash.PAIRED))).distinct()


def settle(spark: SparkSession, texts: DataFrame, traits: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Components (node, root) after adding those of the pairs (a, b) whose sets have a similarity of 4/5 or more.

    Sizes and sketches rule pairs out first. Only sets of what is left are made. Every node meets its most similar
    partner; of the rest only pairs of different groups are counted. So few sets travel with more than one pair.
    """
    of_a, of_b = (sized(traits.drop("mark"), traits.count()).alias(n) for n in "xy")
    close = (pairs.join(of_a, F.col("a") == F.col("x.node")).join(of_b, F.col("b") == F.col("y.node"))
             .where(can_be_near("x", "y")).select("a", "b", apart("x", "y").alias("bits")))
    close, path = saved(spark, close, "pairs")
    if close.isEmpty():
        remove(spark, path)
        return roots
    full, lists = saved(spark, chosen_sets(spark, texts, traits, close), "sets")
    best = close.groupBy("a").agg(F.min_by("b", F.struct("bits", "b")).alias("b"))
    roots = components(spark, roots.union(verified(full, best)))
    of_a, of_b = (sized(roots, roots.count()).toDF(n, f"root_{n}") for n in "ab")
    rest = (close.join(sized(best, close.count()), ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left")
            .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    rest, left = saved(spark, rest, "pairs")
    if not rest.isEmpty():
        roots = components(spark, roots.union(verified(full, rest)))
    remove(spark, path, lists, left)
    return roots


def chosen_sets(spark: SparkSession, texts: DataFrame, traits: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and shingles of all nodes in ``pairs``, from one text of each."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    marks = traits.select("node", "mark").join(sized(nodes, 2 * pairs.count()), "node", "left_semi").select("mark")
    found = marks.count()
    if found <= BROADCAST_MARKS:
        rows = texts.join(F.broadcast(marks), "mark", "left_semi")  # texts stay where they are
    else:
        rows = texts.join(sized(marks, found), "mark", "left_semi")
    return shingle_sets(spark, rows).dropDuplicates(["node"])


def verified(full: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a similarity of 4/5 or more."""
    left, right = (sized(full, full.count()).toDF(n, f"of_{n}") for n in "ab")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").where(9 * shared >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def one_of_equals(members: DataFrame) -> DataFrame:
    """Rows of the buckets (bucket, node) less those of buckets that hold the same nodes as a smaller one, so the same pairs."""
    marks = members.groupBy("bucket").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"),
                                          F.sum(F.xxhash64(F.lit(1), "node").bitwiseAND(2**31 - 1)).alias("s"))
    first = marks.groupBy("size", "x", "s").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(sized(first, members.count()), "bucket", "left_semi")


def jaccard_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   paired: int = PAIRED, rounds: int = ROUNDS) -> DataFrame:
    """One row per input row: doc_id, component_id, the smallest id that links reach.

    Two texts are linked when their sets of five-word shingles have a Jaccard
    similarity of 0.8 or more. A-Z are lower-cased; words are separated by ASCII
    white space; a text of fewer words is one shingle; null, empty and blank
    texts have none and are linked to nothing. Null ids get the component of
    their text and never name one, unless no other id is in it.

    SimHash proposes the first pairs: fingerprints of the same shingles that
    differ in two bits or fewer, found under their one-wildcard segments. Sets
    that share a shingle of their prefixes then meet the smallest set of that
    shingle and, as long as a large bucket holds several groups, others at
    random. What is left is paired whole, block against block, but only across
    groups. Every pair is counted before it links.
    """
    with shuffles_dropped(spark):  # each of the many steps is written, and no plan runs twice
        return _groups(spark, docs, id_col, text_col, paired, rounds)


def _groups(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, paired: int, rounds: int) -> DataFrame:
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("mark"),
                        text_or_empty(text_col).cast("binary").alias("body"))
    rows, signed = saved(spark, signatures(spark, texts, common_shingles(spark, texts)), "signatures")
    sets, total = rows.where("n > 0"), rows.count()
    proposed, proposals = saved(spark, simhash_pairs(spark, sets), "proposed")
    entries = sets.select(F.explode("prefix").alias("bucket"), "node").repartition("bucket")  # one exchange for both uses
    shared = entries.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members, place = saved(spark, entries.join(sized(shared.select("bucket", "low")), "bucket").distinct(), "members")
    wanted = members.select("node").union(proposed.select("a")).union(proposed.select("b")).distinct()
    chosen = sets.select("node", "n", "sketch", "mark").join(sized(wanted, total), "node", "left_semi")
    traits = save(spark, chosen.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"),
                                                    F.first("mark").alias("mark")), "traits")
    rows = save(spark, rows.select("doc_id", "node", "n"), "rows")
    remove(spark, signed)
    sets = rows.where("n > 0")

    roots = settle(spark, texts, traits, proposed, spark.createDataFrame([], "node long, root long"))
    stars = members.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")).distinct()
    roots = settle(spark, texts, traits, stars, roots)
    members = members.where("node <> low").select("bucket", "node")  # the smallest has met all others
    for k in range(rounds + 1):
        placed = members.join(sized(roots, roots.count()), "node", "left").withColumn("root", F.coalesce("root", "node")).repartition("bucket")
        sizes = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("root").alias("r"), F.max("root").alias("s"),
                                             F.min_by("node", F.xxhash64("node", F.lit(k))).alias("lead"))
        open_, opened = saved(spark, placed.join(sizes.where("r < s").drop("r", "s"), "bucket"), "open")
        remove(spark, place)
        place = opened
        large = open_.where(F.col("size") > paired)
        if k == rounds or large.isEmpty():
            break
        # of a pair in one group nothing more is to be learned
        stars = large.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
        roots = settle(spark, texts, traits, stars, roots)
        members = open_.where((F.col("size") <= paired) | (F.col("node") != F.col("lead"))).select("bucket", "node")
    if not open_.isEmpty():
        # sketches go along, so that of a large bucket only the pairs leave the join that may be near
        known = one_of_equals(open_).select("bucket", "node", "root", "size").join(sized(traits.select("node", "n", "sketch"), traits.count()), "node")
        roots = settle(spark, texts, traits, cross_pairs(known, paired, can_be_near), roots)
    remove(spark, place, proposals)
    classed = (sets.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(sized(roots, total), "node", "left")
               .withColumn("root", F.coalesce("root", "node")))
    low = classed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classed = save(spark, classed.join(sized(low, total), "root").select("node", "component_id"), "classes")
    found = sets.select("doc_id", "node").join(sized(classed, total), "node").select("doc_id", "component_id")
    return found.union(rows.where("n = 0").select("doc_id", F.col("doc_id").alias("component_id")))
