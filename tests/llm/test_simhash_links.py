import random

import pytest

from tallywise.llm import simhash
from tallywise.llm.common import components


def grouped(spark, prints, lanes, radius, paired):
    """node -> smallest node of its group."""
    signed = [(i, [v - (1 << 64) if v >> 63 else v for v in ((p >> 64 * k) & (1 << 64) - 1 for k in range(lanes))])
              for i, p in enumerate(prints)]
    nodes = spark.createDataFrame(signed, "node long, print array<long>")
    roots = {r.node: r.root for r in components(spark, simhash.links(spark, nodes, lanes, radius, paired)).collect()}
    return {i: roots.get(i, i) for i in range(len(prints))}


def by_distance(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(prints))}


def test_chains_in_a_large_bucket_stay_whole(spark):
    r = random.Random(6)
    prints = []
    for _ in range(20):
        p = r.getrandbits(224) << 32  # the lowest segment is the same in all
        for _ in range(12):
            prints.append(p)
            for bit in r.sample(range(32, 256), 20):
                p ^= 1 << bit
    r.shuffle(prints)
    assert grouped(spark, prints, 4, 24, 8) == by_distance(prints, 24)


@pytest.mark.parametrize("paired", [2, 64])
def test_radius_alone_decides(spark, paired):
    r = random.Random(8)
    prints = []
    for spread in (3, 2, 4):  # bits that differ in each of eight 32-bit segments: 24 and 16 are links, 32 is none
        p = r.getrandbits(256)
        q = p
        for segment in range(8):
            for bit in r.sample(range(32), spread):
                q ^= 1 << 32 * segment + bit
        prints += [p, q]
    want = by_distance(prints, 24)
    assert want == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
    assert grouped(spark, prints, 4, 24, paired) == want
