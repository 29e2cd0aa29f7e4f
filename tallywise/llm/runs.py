"""Periodic runs of words, found in a grammar.

The word ids of a document are compressed by Re-Pair: the most frequent pair of
neighbours becomes a new symbol until no pair repeats. What is left is joined
by a balanced tree. Every run lies in some symbol and crosses the boundary
between the two halves of the smallest such symbol, so runs are searched once
for each boundary, translated to all places that the symbol derives, and merged
into maximal intervals.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.llm.common import id_and_bytes, prepare_workers

REPEATS, SHORTEST = 4, 6  # a run has at least so many periods, and at least so many words

Runs = tuple[np.ndarray, np.ndarray, np.ndarray]  # start, end, period
NO_RUNS: Runs = (np.zeros(0, np.int64),) * 3


def stretches(flags: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of ``least`` or more true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]


def pieces(words: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run can lie: a run holds each of its words four times and each triple thrice."""
    often = np.bincount(words)[words] >= REPEATS
    if not stretches(often, SHORTEST):
        return []
    # triples as numbers; those with a rare word get one of their own
    codes = words[:-2].astype(np.int64)
    for k in (1, 2):
        size = int(words.max()) + 1
        _, codes = np.unique(codes * size + words[k:len(words) - 2 + k], return_inverse=True)
    alive = np.bincount(codes)[codes] >= REPEATS - 1
    alive &= often[:-2] & often[1:-1] & often[2:]
    return [(a, b + 2) for a, b in stretches(alive, SHORTEST - 2)]


def re_pair(symbols: list[int], first_new: int) -> tuple[list[int], list[tuple[int, int]]]:
    """What is left of the symbols, and the rules: number ``first_new + k`` stands for the k-th pair."""
    n = len(symbols)
    at, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = {}
    for i, pair in enumerate(zip(symbols, symbols[1:])):
        places.setdefault(pair, []).append(i)
    counts = {pair: len(spots) for pair, spots in places.items()}
    # the most frequent first, of these the oldest; counts only fall, so that a stale entry is put back lower
    heap = [(-len(spots), spots[0], pair) for pair, spots in places.items() if len(spots) > 1]
    heapq.heapify(heap)
    rules: list[tuple[int, int]] = []
    clock = n
    while heap:
        count, age, pair = heapq.heappop(heap)
        now = counts[pair]
        if now < 2:
            continue
        if now < -count:
            heapq.heappush(heap, (-now, age, pair))
            continue
        a, b = pair
        new = first_new + len(rules)
        replaced = []
        for i in places.pop(pair):
            if at[i] != a or (j := after[i]) >= n or at[j] != b:
                continue
            left, right = before[i], after[j]
            if left >= 0:
                counts[at[left], a] = counts.get((at[left], a), 1) - 1
            if right < n:
                counts[b, at[right]] = counts.get((b, at[right]), 1) - 1
                before[right] = i
            at[i], at[j], after[i] = new, -1, right
            replaced.append(i)
        counts[pair] = 0
        if not replaced:
            continue
        rules.append(pair)
        fresh: dict[tuple[int, int], list[int]] = {}
        for i in replaced:
            left, right = before[i], after[i]
            if left >= 0 and at[left] != new:
                fresh.setdefault((at[left], new), []).append(left)
            if right < n:
                fresh.setdefault((new, at[right]), []).append(i)
        for pair, spots in fresh.items():
            places[pair], counts[pair] = spots, len(spots)
            if len(spots) > 1:
                clock += 1
                heapq.heappush(heap, (-len(spots), clock, pair))
    return [s for s in at if s >= 0], rules


def derivations(rest: list[int], rules: list[tuple[int, int]], first_new: int, stops: int) -> tuple[list[int], list[int], list[list[int]]]:
    """Of each symbol that stands for several words: words in its left half, words in all, and every place.

    Symbols from ``stops`` up to ``first_new`` part the pieces. The symbols of a
    piece that pairing left over are joined two by two.
    """
    rules = list(rules)
    half, size = [], []

    def words_in(s: int) -> int:
        return 1 if s < first_new else size[s - first_new]

    for a, b in rules:
        half.append(words_in(a))
        size.append(half[-1] + words_in(b))
    tops, row, at = [], [], 0
    for s in [*rest, stops]:
        if not stops <= s < first_new:
            row.append(s)
            continue
        while len(row) > 1:
            joined = []
            for a, b in zip(row[::2], row[1::2]):
                joined.append(first_new + len(rules))
                rules.append((a, b))
                half.append(words_in(a))
                size.append(half[-1] + words_in(b))
            row = joined + row[len(row) & ~1:]
        for s in row:
            tops.append((s, at))
            at += words_in(s)
        row, at = [], at + 1
    places: list[list[int]] = [[] for _ in rules]
    for s, start in tops:
        if s >= first_new:
            places[s - first_new].append(start)
    for k in range(len(rules) - 1, -1, -1):
        (a, b), starts, shift = rules[k], places[k], half[k]
        if a >= first_new:
            places[a - first_new].extend(starts)
        if b >= first_new:
            places[b - first_new].extend([p + shift for p in starts])
    return half, size, places


def ranks(words: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: numbers that are equal where 2^k words from there on are equal, as long as any repeat."""
    out, step = [words.astype(np.int64)], 1
    while 2 * step <= len(words):
        last = out[-1]
        values, codes = np.unique(last[:-step] * (int(last.max()) + 1) + last[step:], return_inverse=True)
        out.append(codes)
        if len(values) == len(codes):
            break
        step *= 2
    return out


def common_length(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from x and y (x < y) on agree, to the right or, with x and y themselves, to the left."""
    out = np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level, step = levels[k], 1 << k
        a, b = (x, y) if forward else (x - step + 1, y - step + 1)
        fits = (a >= 0) & (b < len(level))
        fits[fits] = level[a[fits]] == level[b[fits]]
        out += step * fits
        move = step * fits if forward else -step * fits
        x, y = x + move, y + move
    return out


def crossing(words: np.ndarray, half: np.ndarray, size: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, Runs]:
    """Runs inside each symbol that cross the boundary of its halves: numbers of the symbols, and the runs.

    ``start`` is some place of each symbol. The two words at the boundary come
    again one period to the left or to the right, as a run has four periods.
    """
    pair = np.unique(words[:-1].astype(np.int64) * (int(words.max()) + 1) + words[1:], return_inverse=True)[1]
    n = len(words)
    sorted_pairs = np.sort(pair * n + np.arange(n - 1))
    edge, far = start + half - 1, size // REPEATS
    low = np.searchsorted(sorted_pairs, pair[edge] * n + np.maximum(start, edge - far))
    high = np.searchsorted(sorted_pairs, pair[edge] * n + np.minimum(start + size - 2, edge + far), "right")
    symbol = np.repeat(np.arange(len(half)), high - low)
    if len(symbol) == len(half):  # the boundary itself and nothing else
        return symbol[:0], NO_RUNS
    again = sorted_pairs[np.arange(len(symbol)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)] % n
    moved = again != edge[symbol]
    symbol, again = symbol[moved], again[moved]
    x, y = np.minimum(again, edge[symbol]) + 1, np.maximum(again, edge[symbol]) + 1
    levels = ranks(words)
    first, end = start[symbol], start[symbol] + size[symbol]
    right = np.minimum(common_length(levels, x, y, True), end - y)
    left = np.minimum(common_length(levels, x - 1, y - 1, False), x - first)
    begin, stop, period = x - left, y + right, y - x
    keep = stop - begin >= np.maximum(SHORTEST, REPEATS * period)
    symbol, begin, stop, period = symbol[keep], begin[keep], stop[keep], period[keep]
    order = np.lexsort((period, stop, begin, symbol))  # of one interval only its smallest period counts
    symbol, begin, stop, period = symbol[order], begin[order], stop[order], period[order]
    new = np.ones(len(symbol), bool)
    new[1:] = (np.diff(symbol) != 0) | (np.diff(begin) != 0) | (np.diff(stop) != 0)
    return symbol[new], (begin[new], stop[new], period[new])


def merged(begin: np.ndarray, stop: np.ndarray, period: np.ndarray) -> Runs:
    """Maximal intervals of each period, and of each interval its smallest period; by start, then period."""
    order = np.lexsort((-stop, begin, period))
    begin, stop, period = begin[order], stop[order], period[order]
    reach = np.maximum.accumulate(period * (int(stop.max()) + 1) + stop)
    keep = np.ones(len(begin), bool)
    keep[1:] = reach[1:] > reach[:-1]
    begin, stop, period = begin[keep], stop[keep], period[keep]
    order = np.lexsort((period, stop, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    keep = np.ones(len(begin), bool)
    keep[1:] = (np.diff(begin) != 0) | (np.diff(stop) != 0)
    begin, stop, period = begin[keep], stop[keep], period[keep]
    order = np.lexsort((period, begin))
    return begin[order], stop[order], period[order]


def runs_of(words: np.ndarray) -> Runs:
    """All runs of a sequence of word numbers, by start, then period."""
    if len(words) < SHORTEST or not (cut := pieces(words)):
        return NO_RUNS
    stops = int(words.max()) + 1
    first_new = stops + len(cut)
    text = np.concatenate([np.append(words[a:b], stops + k) for k, (a, b) in enumerate(cut)])
    original = np.concatenate([np.arange(a, b + 1) for a, b in cut])
    rest, rules = re_pair(text.tolist(), first_new)
    half, size, places = derivations(rest, rules, first_new, stops)
    large = [k for k, s in enumerate(size) if s >= SHORTEST and places[k]]
    if not large:
        return NO_RUNS
    symbol, (begin, stop, period) = crossing(text, np.array([half[k] for k in large]), np.array([size[k] for k in large]),
                                             np.array([places[k][0] for k in large]))
    if not len(symbol):
        return NO_RUNS
    moved = [np.array(places[large[s]]) - places[large[s]][0] for s in symbol.tolist()]
    often = np.array([len(m) for m in moved])
    shift = np.concatenate(moved)
    begin, stop, period = merged(np.repeat(begin, often) + shift, np.repeat(stop, often) + shift, np.repeat(period, often))
    return original[begin], original[begin] + (stop - begin), period


def collapsed(tokens: list[bytes], found: Runs) -> bytes:
    """The words joined by spaces, less what repeats a run's first period."""
    if not len(found[0]):
        return b" ".join(tokens)
    change = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(change, found[0] + found[2], 1)
    np.add.at(change, found[1], -1)
    return b" ".join(t for t, over in zip(tokens, np.cumsum(change).tolist()) if not over)


def find_runs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, runs (start, length, period of each) and collapsed, the text without repeats.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch
    of words with smallest period q (words q apart are identical), of at least
    six words and four periods, that no neighbouring word extends with that
    period. Runs are ordered by start, then period, and may overlap. A word that
    lies behind the first period of any run is left out of ``collapsed``; the
    others are joined by one space. Null, empty and blank texts have no run and
    an empty ``collapsed``. Repeated rows and null ids are kept as they are; an
    empty table gives an empty result; other columns are ignored.
    """
    prepare_workers(spark)
    rows = id_and_bytes(docs, id_col, text_col)
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, flat, texts = [0], [], []
            for body in batch.column("body").to_pylist():
                tokens = body.split()  # bytes split at 0x20 and 0x09 to 0x0D
                number: dict[bytes, int] = {}
                found = runs_of(np.array([number.setdefault(t, len(number)) for t in tokens], np.int64))
                flat.append(found)
                ends.append(ends[-1] + len(found[0]))
                texts.append(collapsed(tokens, found).decode())
            start, end, period = (np.concatenate([f[k] for f in flat]) if flat else np.zeros(0, np.int64) for k in range(3))
            of_run = pa.StructArray.from_arrays([pa.array(start), pa.array(end - start), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), of_run).cast(run_type),
                                              pa.array(texts, pa.string())], names=["doc_id", "runs", "collapsed"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def run_digests(found: DataFrame) -> DataFrame:
    """Counts and checksums of the runs, and the run with the most periods (the first of equals)."""
    zero = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", zero, lambda b, r: F.when(
        b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.array_join(F.array(r["start"], r["length"], r["period"]).cast("array<string>"), ","),
                                                   F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
