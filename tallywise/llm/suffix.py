"""Removal of byte strings that an earlier document holds, by suffix arrays.

All strings of ``length`` bytes that start in two documents must meet in one
task. They do by a sampled part of them: the smallest hash among the ``GRAM``
byte grams of a string names its anchor, and equal strings have equal anchors.

1. Every document lists its anchors; a shuffle finds those that occur in two
   different texts. Most do not, and nothing more is done for them.
2. A document cuts out the strings of each shared anchor as one short piece;
   pieces meet by anchor in a second shuffle.
3. Each task puts the distinct pieces of a bucket into one text and sorts its
   suffixes in two stages: only suffixes smaller than their successors are
   sorted directly, the rest are induced by a scan over the buckets of first
   bytes. Adjacent common prefixes then show which strings are equal, and the
   smallest rank of each such run decides which starts are removed.

Copies of a text are compared by hash only, and an anchor that a batch holds
more than once goes on as one entry, so no hot text, line or passage fills one
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallywise.llm.common import id_and_bytes, prepare_workers

LENGTH = 50
GRAM = 20
BLOCK = 1 << 19  # bytes that one vectorised step works on
LAST = (1 << 63) - 1  # rank of a null id
LOW40 = np.uint64((1 << 40) - 1)
LOW20 = np.uint64((1 << 20) - 1)


# --- anchors

def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    h = np.zeros(n, np.uint64)
    for at in [*range(0, gram - 7, 8), gram - 8]:
        h ^= words[at:at + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _block_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Runs of string starts in ``data`` with one anchor. ends[i]: where the text of byte i ends."""
    window = length - gram + 1
    h = _gram_hashes(data, gram)
    low = (h & ~LOW20) | np.arange(len(h), dtype=np.uint64)  # the leftmost of equal hashes wins
    size = 1
    while size * 2 <= window:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < window:
        low = np.minimum(low[:len(low) - (window - size)], low[window - size:])
    anchor = (low & LOW20).astype(np.int64)
    starts = np.nonzero(np.arange(len(anchor)) + length <= ends[:len(anchor)])[0]
    if not len(starts):
        return starts, starts, h[:0]
    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(anchor[starts]) != 0)])
    first = np.nonzero(new)[0]
    return starts[first], np.diff(np.append(first, len(starts))), h[anchor[starts[first]]]


def anchor_runs(bodies: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """doc (index), start, count, hash: every string start of every body is in exactly one run."""
    out: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> None:
        if not held:
            return
        lens = np.array([len(part) for _, _, part in held])
        data = np.frombuffer(b"".join(part for _, _, part in held), np.uint8)
        begins = np.cumsum(lens) - lens
        at, n, h = _block_runs(data, np.repeat(begins + lens, lens), length, gram)
        part = np.searchsorted(begins, at, "right") - 1
        docs = np.array([d for d, _, _ in held])
        offsets = np.array([o for _, o, _ in held])
        out.append((docs[part], at - begins[part] + offsets[part], n, h))
        held.clear()

    for doc, body in enumerate(bodies):
        for offset in range(0, max(len(body) - length + 1, 0), BLOCK):
            part = body[offset:offset + BLOCK + length - 1]
            if held and size + len(part) > BLOCK:
                flush()
                size = 0
            held.append((doc, offset, part))
            size += len(part)
    flush()
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


def codes_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 40 further bits of a hash in one number."""
    return (((hashes >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (hashes & LOW40)).astype(np.int64)


ENTRIES = "bucket int, known boolean, low binary, high binary, place binary, text binary"


def anchor_entries(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """Anchors of every batch, packed by bucket: 5 bytes of hash and 2 of the text's place in the batch.

    An anchor that a batch has in several texts is known to be shared: its texts are passed on as
    known, dealt by text, and one of them stands for all in the anchor's bucket.
    """
    def pack(bucket: int, known: bool, codes: np.ndarray, doc: np.ndarray, texts: np.ndarray) -> dict:
        used, place = np.unique(doc, return_inverse=True)
        return {"bucket": bucket, "known": known,
                "low": (codes if known else (codes & 0xFFFFFFFF).astype("<u4")).tobytes(),
                "high": b"" if known else (codes >> 32 & 0xFF).astype("u1").tobytes(),
                "place": place.astype("<u2").tobytes(), "text": texts[used].tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = np.unique(batch.column("text_id").to_numpy(), return_index=True)
            bodies = batch.column("body").take(pa.array(at)).to_pylist()
            doc, _, _, h = anchor_runs(bodies, length, gram)
            if not len(doc):
                continue
            codes = codes_of(h, buckets)
            order = np.lexsort((doc, codes))
            codes, doc = codes[order], doc[order]
            fresh = np.concatenate([[True], (np.diff(codes) != 0) | (np.diff(doc) != 0)])
            codes, doc = codes[fresh], doc[fresh]
            first = np.concatenate([[True], np.diff(codes) != 0])
            several = np.diff(np.append(np.nonzero(first)[0], len(codes))) > 1
            known = several[np.cumsum(first) - 1]
            rows = []
            group = (codes[first] >> 40).astype(np.int64)
            cut = np.nonzero(np.concatenate([[True], np.diff(group) != 0]))[0]
            for a, b in zip(cut, np.append(cut[1:], len(group))):
                by_doc = np.argsort(doc[first][a:b], kind="stable")
                rows.append(pack(int(group[a]), False, codes[first][a:b][by_doc], doc[first][a:b][by_doc], texts))
            if known.any():
                rows.append(pack(int(texts[doc[known][0]] % buckets), True, codes[known], doc[known], texts))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(T.StructType.fromDDL(ENTRIES))
    return docs.select("text_id", "body").mapInArrow(run, ENTRIES)


def shared_anchors(entries: DataFrame) -> DataFrame:
    """(text_id, code) of the anchors that occur in two different texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(codes: np.ndarray, texts: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(texts[a:a + 100_000]), pa.array(codes[a:a + 100_000])],
                                                 names=["text_id", "code"])
        codes, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for row in batch.to_pylist():
                text = np.frombuffer(row["text"], "<i8")[np.frombuffer(row["place"], "<u2")]
                if row["known"]:
                    yield from rows(np.frombuffer(row["low"], "<i8"), text)
                    continue
                code = (np.frombuffer(row["low"], "<u4").astype(np.int64)
                        | np.frombuffer(row["high"], "u1").astype(np.int64) << 32 | np.int64(row["bucket"]) << 40)
                codes.append(code)
                texts.append(text)
        code, text = np.concatenate(codes), np.concatenate(texts)
        codes, texts = [], []
        order = np.lexsort((text, code))
        code, text = code[order], text[order]
        if len(code):
            first = np.nonzero(np.concatenate([[True], np.diff(code) != 0]))[0]
            n = np.diff(np.append(first, len(code)))
            several = text[first] != text[first + n - 1]  # sorted: the least and the greatest text differ
            keep = np.repeat(several, n)
            keep[1:] &= (np.diff(code) != 0) | (np.diff(text) != 0)
            yield from rows(code[keep], text[keep])

    return entries.mapInArrow(run, "text_id long, code long")


# --- pieces

PIECES = "bucket int, packed binary"


def cut_pieces(docs: DataFrame, length: int, gram: int, buckets: int) -> DataFrame:
    """The strings of shared anchors; docs: text_id, rank, body, codes. One row for each batch and bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            texts = batch.column("text_id").to_numpy().astype("<i8")
            ranks = batch.column("rank").to_numpy().astype("<i8")
            doc, start, n, h = anchor_runs(bodies, length, gram)
            codes = codes_of(h, buckets)
            keep = np.zeros(len(doc), bool)
            ends = np.searchsorted(doc, np.arange(len(bodies) + 1))
            for i, own in enumerate(batch.column("codes")):
                keep[ends[i]:ends[i + 1]] = np.isin(codes[ends[i]:ends[i + 1]], own.values.to_numpy())
            doc, start, n, codes = doc[keep], start[keep], n[keep], codes[keep]
            order = np.argsort(codes >> 40, kind="stable")
            doc, start, n, group = doc[order], start[order], n[order], (codes >> 40)[order]
            cut = np.nonzero(np.concatenate([[True], np.diff(group) != 0]))[0] if len(group) else []
            rows = []
            for a, b in zip(cut, np.append(cut[1:], len(group))):
                used, place = np.unique(doc[a:b], return_inverse=True)
                size = (n[a:b] + length - 1).astype("<u2")
                held = b"".join([bodies[d][s:s + z] for d, s, z in zip(doc[a:b].tolist(), start[a:b].tolist(), size.tolist())])
                head = np.array([b - a, len(used)], "<u4").tobytes()
                rows.append((int(group[a]), zip_.compress(
                    head + texts[used].tobytes() + ranks[used].tobytes() + place.astype("<u2").tobytes()
                    + start[a:b].astype("<u4").tobytes() + size.tobytes() + held)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                                             names=["bucket", "packed"])

    return docs.mapInArrow(run, PIECES)


# --- two-stage suffix sorting

def sort_starts(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the ``depth`` bytes that follow each; all lie inside ``text``.

    Suffixes smaller than their successors, and the last start of every run of
    starts, are sorted directly. Every other start is larger than its successor,
    which is a start too, so a scan over the buckets of first bytes in ascending
    order, each put together before it is left, deals it to its place.
    """
    if not len(starts):
        return starts
    n = len(text)
    change = np.where(text[1:] != text[:-1], np.arange(n - 1), n)
    change = np.minimum.accumulate(np.append(change, n)[::-1])[::-1]  # the last byte of the run at i
    after = np.append(text, np.zeros(2, np.uint8))[np.minimum(change + 1, n)]
    smaller = (after > text) & (change < n)
    is_start = np.zeros(n + 1, bool)
    is_start[starts] = True
    direct = smaller[starts] | ~is_start[starts + 1]
    induced = np.zeros(n + 1, bool)
    induced[starts[~direct]] = True

    chosen = _sort_directly(text, starts[direct], depth)
    first = text[chosen]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    done = []
    for byte in range(256):
        low = waiting[byte]
        wave = np.concatenate(low) if low else starts[:0]
        bucket = [wave]
        own = chosen[bounds[byte]:bounds[byte + 1]]
        ahead = own[~smaller[own]]  # last starts that are larger than their successors belong among the induced
        if len(ahead):
            wave = _merge(text, wave, ahead, depth)
            bucket = [wave]
            own = own[smaller[own]]
        while len(wave):  # runs of one byte induce inside their own bucket
            before = wave[wave > 0] - 1
            wave = before[induced[before] & (text[before] == byte)]
            if len(wave) and len(ahead):
                bucket = [_merge(text, np.concatenate(bucket), wave, depth)]
            else:
                bucket.append(wave)
        whole = np.concatenate([*bucket, own])
        done.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before] & (text[before] > byte)]
        if len(before):
            letters = text[before]
            order = np.argsort(letters, kind="stable")
            before, letters = before[order], letters[order]
            cut = np.nonzero(np.concatenate([[True], letters[1:] != letters[:-1]]))[0]
            for a, b in zip(cut, np.append(cut[1:], len(before))):
                waiting[letters[a]].append(before[a:b])
    return np.concatenate(done)


def _words(text: np.ndarray) -> np.ndarray:
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((len(padded) - 7,), ">u8", padded.data, strides=(1,))


def _sort_directly(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """By eight bytes at a time; only starts that still tie go on."""
    words = _words(text)
    out = starts.copy()
    places = np.arange(len(starts))
    group = np.zeros(len(starts), np.int64)
    for at in range(0, depth, 8):
        at = min(at, depth - 8)
        key = words[out[places] + at].astype(np.uint64)
        order = np.lexsort((key, group))
        out[places] = out[places][order]
        key, group = key[order], group[order]
        new = np.concatenate([[True], (np.diff(group) != 0) | (key[1:] != key[:-1])])
        group = np.cumsum(new)
        tied = ~new | np.append(~new[1:], False)
        places, group = places[tied], group[tied]
        if not len(places):
            break
    return out


def _merge(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Two sorted lists of starts as one."""
    if not len(a) or not len(b):
        return np.concatenate([a, b])
    grid = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(depth, np.uint8)]), depth)
    kind = f"S{depth}"
    ka = np.char.add(np.ascontiguousarray(grid[a]).view(kind)[:, 0], b"")
    kb = np.char.add(np.ascontiguousarray(grid[b]).view(kind)[:, 0], b"")
    return np.insert(a, np.searchsorted(ka, kb, "right"), b)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each start of ``order`` agrees with the one before it in ``depth`` bytes; the first never does."""
    words = _words(text)
    same = np.ones(max(len(order) - 1, 0), bool)
    for at in range(0, depth, 8):
        at = min(at, depth - 8)
        key = words[order + at]
        same &= key[1:] == key[:-1]
    return np.concatenate([[False], same])[:len(order)]


SPANS = "text_id long, span long"


def pack_spans(rank: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """15 bits that check the rank, 40 bits of start, 8 bits of length, in one number."""
    check = (rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)
    return (check << np.uint64(48) | start.astype(np.uint64) << np.uint64(8) | (stop - start).astype(np.uint64)).astype(np.int64)


def unpack_spans(rank: int, packed: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the text with this rank; another text with the same 64-bit id has other check bits."""
    check = int((np.array([rank]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[0] >> np.uint64(49))
    own = packed[packed >> 48 == check]
    start = own >> 8 & (1 << 40) - 1
    return list(zip(start.tolist(), (start + (own & 255)).tolist()))


def repeated_spans(pieces: DataFrame, length: int) -> DataFrame:
    """(text_id, span): bytes of strings that a text of smaller rank holds too; spans may overlap."""
    def spans(rows: list[bytes]) -> pa.RecordBatch | None:
        open_ = zstandard.ZstdDecompressor()
        number: dict[bytes, int] = {}
        piece, text_id, rank, start = [], [], [], []
        for packed in rows:
            raw = open_.decompress(packed)
            n, m = np.frombuffer(raw, "<u4", 2)
            at = 8
            parts = []
            for kind, k in (("<i8", m), ("<i8", m), ("<u2", n), ("<u4", n), ("<u2", n)):
                parts.append(np.frombuffer(raw, kind, int(k), at))
                at += parts[-1].nbytes
            texts, ranks, place, begin, size = parts
            stops = (np.cumsum(size, dtype=np.int64) + at).tolist()
            for a, b in zip([at, *stops], stops):
                piece.append(number.setdefault(raw[a:b], len(number)))
            text_id.append(texts[place])
            rank.append(ranks[place])
            start.append(begin)
        text_id, rank, start = np.concatenate(text_id), np.concatenate(rank), np.concatenate(start).astype(np.int64)
        piece = np.array(piece)
        least = np.full(len(number), LAST)
        np.minimum.at(least, piece, rank)
        sizes = np.fromiter(map(len, number), np.int64, len(number))
        text = np.frombuffer(b"".join(number), np.uint8)
        begins = np.cumsum(sizes) - sizes
        counts = sizes - length + 1
        firsts = np.cumsum(counts) - counts
        flat = np.arange(counts.sum()) - np.repeat(firsts, counts)  # the window's number inside its piece
        starts = flat + np.repeat(begins, counts)
        window = np.full(len(text), -1)
        window[starts] = np.arange(len(starts))
        order = sort_starts(text, starts, length)
        heads = np.nonzero(~common_prefixes(text, order, length))[0]
        owner = np.repeat(np.arange(len(sizes)), counts)
        low = np.minimum.reduceat(least[owner[window[order]]], heads)
        smallest = np.empty(len(starts), np.int64)
        smallest[window[order]] = np.repeat(low, np.diff(np.append(heads, len(order))))
        # all windows of all members
        reps = counts[piece]
        member = np.repeat(np.arange(len(piece)), reps)
        inside = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        gone = smallest[firsts[piece][member] + inside] < rank[member]
        member, inside = member[gone], inside[gone]
        if not len(member):
            return None
        new = np.concatenate([[True], (np.diff(member) != 0) | (np.diff(inside) != 1)])
        a = np.nonzero(new)[0]
        b = np.append(a[1:], len(member)) - 1
        m = member[a]
        begin = start[m] + inside[a]
        packed = pack_spans(rank[m], begin, start[m] + inside[b] + length)
        return pa.RecordBatch.from_arrays([pa.array(text_id[m]), pa.array(packed)], names=["text_id", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in batches:
            for b, packed in zip(batch.column("bucket").to_pylist(), batch.column("packed").to_pylist()):
                if b != bucket and held:
                    if (out := spans(held)) is not None:
                        yield out
                    held = []
                bucket = b
                held.append(packed)
        if held and (out := spans(held)) is not None:
            yield out

    return pieces.mapInArrow(run, SPANS)


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_bytes(spark: SparkSession, docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, body (bytes) and what :func:`span_lists` and :func:`kept_texts` turn into spans.

    A byte goes when a string of ``length`` bytes that covers it also starts in
    a document with a smaller id, as the input stands. A null text is empty; a
    text shorter than ``length`` loses nothing. A null id ranks after all
    others, and rows with the same id never take from each other. An empty
    table gives an empty result; other columns are ignored.
    """
    prepare_workers(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * parts
    rows = id_and_bytes(docs, id_col, text_col).select(
        "doc_id", "body", F.xxhash64("body").alias("text_id"), F.xxhash64(F.lit(1), "body").alias("text_id2"))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    # the smallest rank of each text, by its second hash; one text for an id but for rare collisions
    own = (rows.groupBy("text_id", "text_id2").agg(F.min(rank).alias("first_rank"))
           .groupBy("text_id").agg(F.map_from_entries(F.collect_list(F.struct("text_id2", "first_rank"))).alias("firsts")))
    entries = anchor_entries(rows, length, gram, buckets).repartition(parts, "bucket")
    codes = shared_anchors(entries).groupBy("text_id").agg(F.collect_set("code").alias("codes"))
    # Both joins of whole texts use this key and these columns only, so that they share one exchange
    first = F.col("firsts")[F.col("text_id2")]
    cut = (rows.join(own.join(codes, "text_id"), "text_id").withColumn("rank", rank).where(F.col("rank") == first)
           .select("doc_id", "text_id", "rank", "body", "codes"))
    pieces = cut_pieces(cut, length, gram, buckets)
    spans = (repeated_spans(pieces.repartition(parts, "bucket").sortWithinPartitions("bucket"), length)
             .groupBy("text_id").agg(F.collect_set("span").alias("packed")))
    return (rows.join(own.join(spans, "text_id", "left"), "text_id")
            .select("doc_id", "body", "packed", first.alias("first_rank"), (rank > first).alias("copy")))


def span_lists(rows: pa.RecordBatch, length: int) -> Iterator[list[tuple[int, int]]]:
    """Maximal removed runs of every row of ``repeated_bytes``."""
    for body, copy, first, packed in zip(*(rows.column(c) for c in ("body", "copy", "first_rank", "packed"))):
        size = len(body.as_buffer())
        if copy.as_py():
            yield [(0, size)] if size >= length else []
        else:
            yield union_spans(unpack_spans(first.as_py(), packed.values.to_numpy()) if packed.is_valid else [])


def kept_texts(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, starts, stops (of the maximal removed runs), kept (the bytes that stay)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(span_lists(batch, length))
            bodies = batch.column("body").to_pylist()
            kept = [b"".join(body[a:b] for a, b in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(body)]))
                    for body, spans in zip(bodies, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, bodies), pa.int64()),
                 pa.array([len(b) - len(k) for b, k in zip(bodies, kept)], pa.int64()), pa.array(map(len, found), pa.int64()),
                 *(pa.array([[s[i] for s in spans] for spans in found], pa.list_(pa.int64())) for i in (0, 1)),
                 pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "starts", "stops", "kept"])

    out = rows.select("doc_id").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        out = out.add(name, T.LongType())
    for name in ("starts", "stops"):
        out = out.add(name, T.ArrayType(T.LongType()))
    return rows.mapInArrow(run, out.add("kept", T.BinaryType()))


def keep_digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return kept_texts(rows).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
