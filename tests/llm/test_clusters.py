import hashlib

import numpy as np
import pytest

from tallywise.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, cluster string, vec string, distance string"


def plain(rows, k, rounds, dims):
    """vec_id list, clusters, distances and centroids by computing every distance in every round."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    vectors = [[int(np.floor(np.float64(np.float32(x)) * 64)) for x in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda n: (kept[n][0] is None, hashlib.sha256(f"1:{kept[n][0]}".encode()).hexdigest(), vectors[n]))
    centres = [list(vectors[n]) for n in order[:k]]

    def nearest():
        out = []
        for v in vectors:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = nearest()
        for j in range(len(centres)):
            own = [v for v, (c, _) in zip(vectors, at) if c == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    return [i for i, _ in kept], nearest(), centres


def result(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "x", "x", "x") for i, v in rows], SCHEMA)
    assigned, centroids = clusters.cluster_vectors(spark, df, **more)
    return ([(r.vec_id, r.cluster, r.distance) for r in assigned.collect()],
            [r.centroid for r in sorted(centroids.collect(), key=lambda r: r.cluster)])


@pytest.mark.parametrize("k,rounds,spread", [(5, 3, 0.1), (9, 12, 0.4), (3, 0, 1.0)])
def test_by_brute_force(spark, k, rounds, spread):
    r = np.random.default_rng(k)
    centres = r.normal(size=(k, 4))
    rows = [(n, (centres[n % k] + spread * r.normal(size=4)).tolist()) for n in range(700)]
    ids, at, middle = plain(rows, k, rounds, 4)
    got, centroids = result(spark, rows, k=k, rounds=rounds, dims=4)
    assert sorted(got) == sorted((i, c, d) for i, (c, d) in zip(ids, at)) and centroids == middle


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [None, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]),
            (7, [-3.0, 0.01]), (None, [5.0, 5.0]), (8, [1e-9, -1e-9]), (9, [0.5, 0.5]), (10, [0.5, -0.5]), (11, [1e6, -1e6])]
    for k in (2, 4, 40):  # ties, copies as centroids, more clusters than vectors
        ids, at, middle = plain(rows, k, 3, 2)
        got, centroids = result(spark, rows, k=k, dims=2)
        assert sorted(got, key=str) == sorted(((i, c, d) for i, (c, d) in zip(ids, at)), key=str) and centroids == middle
    assert result(spark, [], dims=2) == ([], []) and result(spark, rows[:6], dims=2) == ([], [])
    with pytest.raises(Exception, match="too large"):
        result(spark, [(1, [1e30, 0.0])], dims=2)


def test_bounds_rule_out_most_distances():
    r = np.random.default_rng(3)
    centres = r.integers(-500, 500, (16, 64))
    vectors = centres[np.arange(2000) % 16] + r.integers(-20, 20, (2000, 64))
    history = centres[None]
    every = clusters.squared(vectors, centres)
    cluster, bound, since = every.argmin(1), np.sqrt(every), np.zeros(every.shape, int)
    for _ in range(4):  # centroids that drift to and fro end near where they began
        history = np.concatenate([history, (centres + r.integers(-9, 9, centres.shape))[None]])
        cluster, distance, bound, since, computed = clusters.reassign(vectors, cluster, bound, since, history)
        every = clusters.squared(vectors, history[-1])
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        assert computed < every.size / 8
    gone = clusters.displacement(history)
    steps = np.sqrt(((history[1:] - history[:-1]) ** 2).sum(2)).sum(0)
    assert (gone[0] < steps).all()


def test_far_and_large_numbers_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [3, 4]])
    c = np.array([[-(1 << 27), 1 << 27], [(1 << 27) - 1, 5]])
    assert clusters.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(u, v)) for v in c] for u in x]
