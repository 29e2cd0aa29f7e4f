import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tallywise.llm import exact, queries, simhash, suffix
from tallywise.llm.common import components
from tests.compare import compare, duck
from tests.llm.helpers import documents, edge_rows, near_components, prose, repeated


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    assert compare(spark, duck(sf), queries.QUERIES[name], queries.ORACLES[name], sf) is None


def test_fold_keeps_frequent_digests():
    r = random.Random(3)
    rows = [b"hot"] * 400 + [str(r.random()).encode() for _ in range(600)]
    r.shuffle(rows)
    held = {}
    for k in range(0, 1000, 37):
        part = rows[k:k + 37]
        held = exact.fold(held, ((d, part.count(d)) for d in set(part)), 2)
    assert b"hot" in held and len(held) <= 2


@pytest.mark.parametrize("counters", [1, 2, 1000])
def test_exact_dedup_edges(spark, counters):
    rows = edge_rows()
    got = exact.exact_dedup(spark, documents(spark, rows, clashes=True), counters=counters).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest())
                  for t, g in groups.items() for i in g)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact.exact_dedup(spark, documents(spark, [])).count() == 0


def near_rows():
    r = random.Random(9)
    rows = [(i, t) for i, t in edge_rows() if i not in (None, 5, 9, 10)]
    base = prose(5, 400).split()
    for k in range(90):  # a large group of near copies
        words = list(base)
        words[r.randrange(400)] = f"new{k}"
        rows.append((100 + k, " ".join(words)))
    return rows + [(300 + k, prose(40 + k, 60)) for k in range(20)]


@pytest.mark.parametrize("words,lanes,radius,paired", [(3, 1, 2, 64), (3, 1, 2, 2), (2, 4, 24, 64)])
def test_simhash_by_brute_force(spark, words, lanes, radius, paired):
    rows = near_rows()
    want, prints = near_components(rows, words, lanes, radius)
    got = simhash.near_groups(spark, documents(spark, rows, clashes=True), words, lanes, radius, paired=paired).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert {r.doc_id: r.fingerprint for r in got} == {i: "".join(f"{p:016x}" for p in f) for i, f in prints.items()}


def test_simhash_leaders_split_large_buckets(spark):
    rows = near_rows()
    got = simhash.near_groups(spark, documents(spark, rows), 2, 4, 24, paired=4).collect()
    assert {r.component_id for r in got if 100 <= r.doc_id < 190} == {100}
    assert {r.component_id for r in got if r.doc_id >= 300} == set(range(300, 320))


def test_simhash_edges(spark):
    got = simhash.near_groups(spark, documents(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert [r.component_id for r in got if r.doc_id is None] == [4, 1] or [r.component_id for r in got if r.doc_id is None] == [1, 4]
    assert simhash.near_groups(spark, documents(spark, [])).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(spark, edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_two_stage_sort():
    r = random.Random(5)
    for _ in range(120):
        parts = [bytes(r.choice(b"ab"[:r.choice((1, 2))]) for _ in range(r.randint(50, 90))) for _ in range(r.randint(1, 10))]
        parts += [p for p in (r.choice(parts)[r.randint(0, 3):] + b"z" * r.randint(0, 60) for _ in range(4)) if len(p) >= 50]
        text, starts, at = np.frombuffer(b"".join(parts), np.uint8), [], 0
        for p in parts:
            starts += range(at, at + len(p) - 49)
            at += len(p)
        order = suffix.sort_starts(text, np.array(starts), 50)
        keys = [text[i:i + 50].tobytes() for i in order]
        assert sorted(order) == starts and keys == sorted(keys)
        assert suffix.common_prefixes(text, order, 50).tolist() == [False, *(a == b for a, b in zip(keys, keys[1:]))]


def test_repeated_bytes_by_brute_force(spark):
    r = random.Random(4)
    passage = prose(77, 12)
    rows = [(i, t) for i, t in edge_rows() if i is not None and i != 5]
    rows += [(20 + k, prose(k, 30) + passage[r.randint(0, 9):] + prose(k + 50, 9)) for k in range(25)]
    rows += [(60, passage[:50]), (61, passage[:49]), (62, passage[3:53]), (63, "ab" * 400), (64, "x" + "ab" * 40)]
    got = suffix.keep_digests(suffix.repeated_bytes(spark, documents(spark, rows, clashes=True))).collect()
    want = repeated(rows, 50)
    assert len(got) == len(rows)
    for x in got:
        body, mask = (dict(rows)[x.doc_id] or "").encode(), want[x.doc_id]
        runs = int((mask & ~np.concatenate([[False], mask[:-1]])).sum()) if len(mask) else 0
        kept = hashlib.sha256(np.frombuffer(body, np.uint8)[~mask].tobytes()).hexdigest()
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(body), int(mask.sum()), runs, kept), x.doc_id


def test_repeated_bytes_edges(spark):
    text = prose(3, 40)
    got = suffix.keep_digests(suffix.repeated_bytes(spark, documents(
        spark, [(None, text), (2, text), (2, text), (3, text + text), (None, None)]))).collect()
    n = len(text.encode())
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("2", 0), ("2", 0), ("3", 2 * n), ("None", 0), ("None", n)]
    assert suffix.repeated_bytes(spark, documents(spark, [])).count() == 0
