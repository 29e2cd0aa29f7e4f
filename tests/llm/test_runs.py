import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tallywise.llm import queries, runs
from tests.llm.helpers import documents, edge_rows, prose


def plain_runs(words):
    """(start, length, period) of every run, period by period."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i:
                start, end = i, j + q
                if end - start >= max(6, 4 * q) and (start, end) not in seen:
                    seen.add((start, end))
                    out.append((start, end - start, q))
            i = max(j, i + 1)
    return sorted((s, length, q) for s, length, q in out)


def found(words):
    number = {}
    begin, stop, period = runs.runs_of(np.array([number.setdefault(w, len(number)) for w in words], np.int64))
    return [(int(s), int(e - s), int(q)) for s, e, q in zip(begin, stop, period)]


def repetitive(r):
    words = []
    while len(words) < r.randint(0, 220):
        root = [r.choice("abcdefgh"[:r.choice((1, 2, 3, 8))]) for _ in range(r.randint(1, r.choice((2, 3, 9, 25))))]
        piece = root * r.randint(1, 9)
        words += piece[:max(1, len(piece) - r.randint(0, len(root)))]
        if r.random() < .4 and words:
            words[r.randrange(len(words))] = r.choice("abz")
        if r.random() < .3:
            words += words[-r.randint(1, len(words)):] * r.randint(1, 5)
    return words[:700]


def test_runs_by_brute_force():
    r = random.Random(8)
    for _ in range(1500):
        words = repetitive(r)
        assert found(words) == plain_runs(words), words


@pytest.mark.parametrize("words", [["a"] * 100_000, ["a", "b"] * 40_000 + ["c"] + ["b", "a"] * 30_000,
                                   [f"w{i}" for i in range(20_000)] * 5])
def test_long_sequences(words):
    n = len(words)
    got = found(words)
    if "c" in words:
        assert got == [(0, 80_000, 2), (80_001, 60_000, 2)]
    else:
        assert got == [(0, n, 1 if "a" in words else 20_000)]


def test_fibonacci_words_and_nested_runs():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    words = list(b)
    assert found(words) == plain_runs(words)
    nested = (["x", "y"] * 6 + ["z"]) * 7
    assert found(nested) == plain_runs(nested) and len(found(nested)) == 8


def test_re_pair_gives_the_sequence_back():
    r = random.Random(2)
    for _ in range(100):
        symbols = [r.randrange(4) for _ in range(r.randint(1, 200))]
        rest, rules = runs.re_pair(symbols, 10)

        def expand(s):
            return [s] if s < 10 else [x for part in rules[s - 10] for x in expand(part)]

        assert [x for s in rest for x in expand(s)] == symbols
        assert len(rest) < 3 or len(set(zip(rest, rest[1:]))) >= (len(rest) - 1) / 2


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    out = plain_runs(words)
    drop = {i for s, length, q in out for i in range(s + q, s + length)}
    best = max(out, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
    return (len(out), *best, 1000 * best[1] // best[2] if out else None,
            hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in out).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def digests(spark, rows):
    docs = queries.with_planted_runs(documents(spark, rows, clashes=True))
    return [(r.doc_id, (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256))
            for r in runs.run_digests(runs.find_runs(spark, docs)).collect()]


def test_query_by_brute_force(spark):
    r = random.Random(4)
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in edge_rows()]
    rows += [(1000 + k, prose(k, r.randint(0, 90))) for k in range(150)]
    rows += [(2000 + k, " ".join(repetitive(r))) for k in range(100)]
    rows += [(5000, "x\x1cy\u2003z\x85w " * 9), (5001, "\n" + "ab\x0bcd\x0c" * 30)]
    got = digests(spark, rows)
    assert sorted(got, key=str) == sorted(((i, expected(i, t)) for i, t in rows), key=str)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and x[0] for i, x in got)
    assert digests(spark, []) == []


def test_query_on_a_small_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if r.text is None or len(r.text) < 30_000}
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_word_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    assert {i: got[i] for i in short} == {i: expected(i, t) for i, t in short.items()}
