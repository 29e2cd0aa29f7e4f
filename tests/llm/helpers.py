"""Plain versions of the operators, for comparison on small tables."""

import random

import numpy as np
import xxhash
from pyspark.sql import types as T

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])
# columns that clash with names the operators use
CLASHES = ("keep_id", "digest", "body", "rank", "label", "score", "text_id", "__dropped")


def prose(seed, words):
    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(words))


def documents(spark, rows, clashes=False):
    full = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in
            ((*r, "en")[:3] for r in rows)]
    df = spark.createDataFrame(full, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in CLASHES})
    return df


def edge_rows():
    """Nulls, empties, ties, copies, repeated rows, a very long text."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one"), (None, None), (6, prose(2, 80)),
            (7, prose(2, 80)), (8, prose(2, 80) + " more"), (9, long), (10, long[:-3]), (11, "é" * 70), (12, "a" * 5000)]


def simhash(text, words, lanes=1):
    tokens = (text or "").encode().translate(LOWER).split()
    if not tokens:
        return (0,) * lanes
    shingles = [b" ".join(tokens[i:i + words]) for i in range(len(tokens) - words + 1)] or [b" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    m, out = (1 << 64) - 1, []
    for lane in range(lanes):
        count = [0] * 64
        for h in hashes:
            if lane:
                h = (h + 0x9E3779B97F4A7C15 * lane) & m
                h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
                h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
                h ^= h >> 31
            for b in range(64):
                count[b] += h >> b & 1
        out.append(sum(1 << b for b in range(64) if 2 * count[b] > len(hashes)))
    return tuple(out)


def near_components(rows, words, lanes, radius):
    """id -> component for rows without null ids; links as the operator defines them."""
    prints = {i: simhash(t, words, lanes) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def linked(a, b):
        x = [p ^ q for p, q in zip(a, b)]
        halves = [h for v in x for h in (v & 0xFFFFFFFF, v >> 32)]
        return sum(h.bit_count() for h in halves) <= radius and min(h.bit_count() for h in halves) <= 1

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if linked(prints[i], prints[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, prints


def repeated(rows, length):
    """id -> mask of removed bytes; ids unique, null ids not given."""
    first = {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k:k + length], i)
    out = {}
    for i, t in rows:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if first[b[k:k + length]] < i:
                mask[k:k + length] = True
        out[i] = mask
    return out


def edit_distance_in(pattern, text):
    """Least edits to turn the pattern into some substring of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)
