"""Benchmark decontamination by pigeonhole edit matching.

An item with a budget of e edits is split into e + 1 pieces: a passage within
the budget holds one of them unchanged. All pieces of a block of items go into
one automaton, every document is scanned once per block, and the places that a
hit points to are verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallywise.llm.common import prepare_workers, text_or_empty

EDIT_SHARE = 0.06
BLOCK_CHARS = 1_000_000  # of item text in one automaton; more items mean more scans, not a larger automaton

Item = tuple[object, str, int]  # id, normalised text, edit budget


def normalise(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(text: str, budget: int) -> Iterator[tuple[int, str]]:
    """``budget`` + 1 contiguous pieces of nearly equal length, with their offsets."""
    n = budget + 1
    cuts = [len(text) * i // n for i in range(n + 1)]
    return ((a, text[a:b]) for a, b in zip(cuts, cuts[1:]))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        out[c] |= 1 << i
    return out


def distances(peq: dict[str, int], m: int, text: str) -> Iterator[int]:
    """Myers: after each character of ``text`` the least distance of the pattern to a substring that ends there."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        yield score


def best_match(pattern: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """distance, start, stop of the first best passage within the budget."""
    m = len(pattern)
    found = min(((d, i + 1) for i, d in enumerate(distances(masks(pattern), m, text))), default=None)
    if found is None or found[0] > budget:
        return None
    distance, stop = found
    back = text[max(0, stop - m - distance):stop][::-1]
    length = next(i + 1 for i, d in enumerate(distances(masks(pattern[::-1]), m, back)) if d == distance)
    return distance, stop - length, stop


def automaton(items: list[Item]) -> ahocorasick.Automaton:
    places: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for number, (_, text, budget) in enumerate(items):
        for offset, piece in pieces(text, budget):
            places[piece].append((number, offset))
    out = ahocorasick.Automaton()
    for piece, where in places.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def matches(text: str, finder: ahocorasick.Automaton, items: list[Item]) -> Iterator[tuple[int, int, int, int]]:
    """number of the item, distance, start, stop in the normalised text; the best passage of each item."""
    spots: dict[int, set[int]] = defaultdict(set)
    for end, (size, where) in finder.iter(text):
        for number, offset in where:
            spots[number].add(end + 1 - size - offset)
    for number, begins in spots.items():
        _, pattern, budget = items[number]
        regions: list[list[int]] = []
        for at in sorted(begins):
            a, b = max(0, at - budget), min(len(text), at + len(pattern) + budget)
            if regions and a <= regions[-1][1]:
                regions[-1][1] = max(b, regions[-1][1])
            else:
                regions.append([a, b])
        best = min(((m[0], a + m[1], a + m[2]) for a, b in regions
                    if (m := best_match(pattern, text[a:b], budget))), default=None)
        if best:
            yield number, *best


def item_blocks(items: DataFrame, share: float, id_col: str, text_col: str) -> Iterator[list[Item]]:
    """Items in blocks of bounded size, in the order of their ids; blank items match nothing."""
    block: list[Item] = []
    size = 0
    for item_id, text in items.select(id_col, text_or_empty(text_col)).orderBy(id_col).toLocalIterator():
        text = normalise(text)
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((item_id, text, int(len(text) * share)))
        size += len(text)
    if block:
        yield block


_FINDER: list = [None, None]  # the block a worker saw last, and its automaton


def finder_of(block: list[Item]) -> ahocorasick.Automaton:
    if _FINDER[0] is not block:
        _FINDER[:] = [block, automaton(block)]
    return _FINDER[1]


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, share: float = EDIT_SHARE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, distance, start, stop.

    Texts are compared in lower case with each run of white space as one space;
    start and stop count characters of that form. A passage may differ from the
    item in ``share`` of the item's characters. Of equally good passages the
    first is reported. Null and blank texts match nothing; repeated documents
    and items give a row each; null ids pass through. Empty tables give an empty
    result; other columns are ignored.
    """
    prepare_workers(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("body"))
    out = rows.select("doc_id").schema.add("item_id", items.schema["item_id"].dataType)
    for name in ("distance", "start", "stop"):
        out = out.add(name, T.LongType())
    item_kind, kinds = to_arrow_type(items.schema["item_id"].dataType), [pa.int64()] * 3

    def scan(block: list[Item]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)  # at most BLOCK_CHARS characters, or one item

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            finder = finder_of(own)
            for batch in batches:
                hits = [(i, *m) for i, text in enumerate(batch.column("body").to_pylist())
                        for m in matches(normalise(text), finder, own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array([h[0] for h in hits], pa.int64())),
                     pa.array([own[h[1]][0] for h in hits], item_kind),
                     *(pa.array([h[k + 2] for h in hits], kind) for k, kind in enumerate(kinds))],
                    names=["doc_id", "item_id", "distance", "start", "stop"])

        return rows.mapInArrow(run, out)

    found = [scan(block) for block in item_blocks(items, share, "item_id", "text")]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], out)
