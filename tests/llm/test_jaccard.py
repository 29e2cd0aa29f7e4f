import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import jaccard, stages
from tallywise.llm.common import DROP_SHUFFLES, shuffles_dropped
from tests.llm.helpers import LOWER, documents, prose


def shingles(text):
    words = (text or "").encode().translate(LOWER).split()
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute_force(rows):
    """id -> smallest id that links of five-word Jaccard >= 0.8 reach."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(sets):
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def variants(r, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for at in r.sample(range(len(words)), r.randint(0, changes)):
            words[at] = f"w{r.randrange(10 ** 9)}"
        out.append(" ".join(words))
    return out


def mixed_rows():
    r = random.Random(11)
    texts = ["", " ", "\t", None, "one", "One ", "a b c d", "a b c d e", "A b c d e", "a b c d e f g h i", "a b c d e f g h"]
    for k in range(12):  # pairs around the limit
        texts += variants(r, prose(k, 60), 4, 3)
    texts += variants(r, prose(77, 200), 150, 7)  # a large group, linked by chains
    line = prose(5, 20)  # a line that many texts hold
    texts += [f"{prose(500 + k, 8)} {line}" for k in range(80)]
    texts += variants(r, prose(78, 3000), 3, 110)
    r.shuffle(texts)
    return list(enumerate(texts, 1))


@pytest.mark.parametrize("paired,rounds", [(64, 3), (8, 0), (8, 2)])
def test_groups_by_brute_force(spark, paired, rounds):
    rows = mixed_rows()
    got = jaccard.jaccard_groups(spark, documents(spark, rows, clashes=True), paired=paired, rounds=rounds).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows) and len(got) == len(rows)


def test_stage_drops_near_copies_of_a_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id for r in stages.near_stage(spark, docs, "").collect()}
    assert got == {i for i, low in brute_force(rows).items() if i == low}


def test_sketch_is_a_lower_bound(spark):
    r = np.random.default_rng(1)
    rows = []
    for n in (3, 300, 1000, 1100, 5000, 8150):
        a = np.unique(r.integers(-1 << 62, 1 << 62, n))
        b = np.union1d(a[n // 10:], r.integers(-1 << 62, 1 << 62, n // 7))
        rows.append((jaccard.sketch(a).tolist(), jaccard.sketch(b).tolist(), len(np.setxor1d(a, b)), len(a) + len(b)))
    df = spark.createDataFrame(rows, "p array<long>, q array<long>, d long, n long")
    pairs = df.selectExpr("named_struct('sketch', p) as x", "named_struct('sketch', q) as y", "d", "n")
    got = pairs.select(jaccard.apart("x", "y").alias("bits"), jaccard.apart("y", "x").alias("back"), "d", "n").collect()
    assert len({len(s) for r in rows for s in r[:2]}) > 2
    for g in got:
        assert g.bits == g.back <= g.d and g.bits >= g.d / 3


def test_marks_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_MARKS", 0)
    rows = mixed_rows()[:120]
    got = jaccard.jaccard_groups(spark, documents(spark, rows)).collect()
    assert {r.doc_id: r.component_id for r in got} == brute_force(rows)


def test_common_list_is_searched_and_not_sorted_for_every_text():
    r = np.random.default_rng(3)
    common = np.unique(r.integers(-1 << 62, 1 << 62, 250_000))
    own = np.unique(r.integers(-1 << 62, 1 << 62, 300))
    mixed = np.unique(np.concatenate([own, common[::2000], common[-1:], [np.iinfo(np.int64).max]]))
    assert jaccard.held_in(mixed, common).tolist() == np.isin(mixed, common).tolist()
    assert not jaccard.held_in(mixed, common[:0]).any() and not len(jaccard.held_in(mixed[:0], common))
    began = time.process_time()
    for _ in range(100):
        jaccard.prefix(mixed, common)
    assert time.process_time() - began < 1


def test_shuffle_files_go_when_a_step_ends(spark, tmp_path):
    """The setting holds in the stage alone."""
    before = spark.conf.get(DROP_SHUFFLES)
    with shuffles_dropped(spark):
        assert spark.conf.get(DROP_SHUFFLES) == "true"
        df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
        df.write.parquet(str(tmp_path / "t"))
        assert df.count() == 7  # the same rows again, from a plan of its own
    assert spark.conf.get(DROP_SHUFFLES) == before


def test_buckets_of_the_same_nodes_are_paired_once(spark):
    sets = {1: [5, 6, 7], 2: [5, 6, 7], 3: [5, 6], 4: [6, 7, 8], 9: [7, 6, 5], 10: [5, 7], 11: [6, 5]}
    rows = spark.createDataFrame([(b, n) for b, nodes in sets.items() for n in nodes], "bucket long, node long")
    got = {}
    for r in jaccard.one_of_equals(rows).collect():
        got.setdefault(r.bucket, set()).add(r.node)
    assert got == {1: {5, 6, 7}, 3: {5, 6}, 4: {6, 7, 8}, 10: {5, 7}}
