"""Exact k-means with ns-bounds.

Every vector keeps a lower bound of its distance to each centroid, with the
round in which that distance was computed. The history of all centroids is
kept, so a bound loosens by the norm of the centroid's whole displacement since
that round, which is never more than the sum of its drifts round by round.
Centroids that a bound cannot rule out are computed exactly. Vectors and
centroids are whole numbers, so all distances and sums are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.llm.common import prepare_workers, remove, saved

DIMS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
LARGEST = 1 << 27  # of a component, so that squared distances fit 64 bits
SAFE = 1 << 22  # up to here squared distances are exact in doubles
SLACK = 1e-6  # keeps bounds on the safe side of rounding

STATE = "vec_id {id}, vec array<int>, cluster int, distance long, bound array<float>, since array<smallint>"


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id and vec, the components times ``scale`` as whole numbers; other lengths, nulls and non-finite values go."""
    of = F.col(f"`{vec_col}`").cast("array<double>")
    fine = (F.size(of) == dims) & F.forall(of, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    cells = F.transform(of, lambda x: F.floor(x * scale))
    cells = F.when(F.exists(cells, lambda x: F.abs(x) > LARGEST),
                   F.raise_error(F.lit("a component is too large for exact distances"))).otherwise(cells.cast("array<int>"))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").alias("vec_id"), cells.alias("vec"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes; equal ids by their components, null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(mark.asc_nulls_last(), "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid."""
    if max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) <= SAFE // 8:
        x, c = vectors.astype(float), centroids.astype(float)
        return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in centroids], axis=1)


def displacement(history: np.ndarray) -> np.ndarray:
    """[t, j]: how far centroid j is now from where it was in round t, rounded up."""
    gone = (history[-1][None] - history).astype(float)
    return np.sqrt((gone ** 2).sum(2)) * (1 + SLACK) + SLACK


def reassign(vectors: np.ndarray, cluster: np.ndarray, bound: np.ndarray, since: np.ndarray,
             history: np.ndarray) -> tuple[np.ndarray, ...]:
    """One round: cluster, distance, bound, since and how many distances were computed."""
    now, rows, t = history[-1], np.arange(len(vectors)), len(history) - 1
    own = now[cluster]
    distance = ((vectors - own) ** 2).sum(1)  # exact, and the bound all others are held against
    gone = displacement(history)
    low = bound - gone[since, np.arange(len(now))[None, :]]
    doubt = low <= np.sqrt(distance)[:, None] * (1 + SLACK) + SLACK
    doubt[rows, cluster] = False
    i, j = np.nonzero(doubt)
    exact = np.full(low.shape, np.iinfo(np.int64).max)
    exact[rows, cluster] = distance
    exact[i, j] = ((vectors[i] - now[j]) ** 2).sum(1)
    known = exact < np.iinfo(np.int64).max
    bound = np.where(known, np.sqrt(np.where(known, exact, 0)) * (1 - SLACK) - SLACK, bound)
    since = np.where(known, t, since)
    cluster = exact.argmin(1)  # the first of equals
    return cluster, exact[rows, cluster], bound, since, len(i) + len(rows)


def assign(spark: SparkSession, state: DataFrame, history: np.ndarray) -> DataFrame:
    """The state after one more round. ``history`` holds rounds x clusters x dimensions numbers, however many vectors there are."""
    first = "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, k, t = history.shape[2], history.shape[1], len(history) - 1

        def column(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
            return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)

        for batch in batches:
            vectors = column(batch, "vec", dims, np.int64)
            if first:
                all_ = squared(vectors, history[-1])
                cluster = all_.argmin(1)
                distance = all_[np.arange(len(all_)), cluster]
                bound, since = np.sqrt(all_) * (1 - SLACK) - SLACK, np.full(all_.shape, t)
            else:
                cluster, distance, bound, since, _ = reassign(
                    vectors, batch.column("cluster").to_numpy().astype(np.int64), column(batch, "bound", k, float),
                    column(batch, "since", k, np.int64), history)
            low = np.nextafter(bound.astype(np.float32), np.float32(-np.inf))  # single precision, never above the bound
            ends = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vec"), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64)),
                 pa.ListArray.from_arrays(ends, pa.array(low.reshape(-1))),
                 pa.ListArray.from_arrays(ends, pa.array(since.astype(np.int16).reshape(-1)))],
                names=["vec_id", "vec", "cluster", "distance", "bound", "since"])

    return state.mapInArrow(run, STATE.format(id=state.schema["vec_id"].dataType.simpleString()))


def means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floor of sum / count of each cluster's vectors; an empty cluster keeps its centroid."""
    sums = [F.sum(F.col("vec")[d].cast("long")).alias(f"s{d}") for d in range(centroids.shape[1])]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():  # one row per cluster
        out[r.cluster] = [r[f"s{d}"] // r.n for d in range(centroids.shape[1])]
    return out


def cluster_vectors(spark: SparkSession, vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1,
                    id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, scale: int = SCALE) -> tuple[DataFrame, DataFrame]:
    """Clusters of all vectors: (vec_id, cluster, distance) and (cluster, centroid).

    Vectors with exactly ``dims`` components, none null or not finite, are kept;
    each component becomes floor(``scale`` x component). Those with the smallest
    hashes of ``seed:vec_id`` are the first centroids; with fewer vectors than
    ``k`` there are as many clusters as vectors. In each round every vector goes
    to the nearest centroid (squared Euclidean distance, the smaller number of
    equals), and centroids become the floor of their vectors' means. A last
    assignment gives the result. Repeated rows count each; null ids come last
    among the first centroids; an empty table gives empty results; other columns
    are ignored. A component beyond 2^27 after scaling is an error, as distances
    would not fit 64 bits.
    """
    prepare_workers(spark)
    state, path = saved(spark, whole_vectors(vectors, id_col, vec_col, dims, scale), "vectors")
    history = first_centroids(state, k, seed)[None]
    if not history.size:
        return (spark.createDataFrame([], f"vec_id {state.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"),
                spark.createDataFrame([], "cluster int, centroid array<int>"))
    for _ in range(rounds + 1):
        last = path
        state, path = saved(spark, assign(spark, state, history), "clusters")
        remove(spark, last)  # the new state holds all that it held
        if len(history) <= rounds:
            history = np.concatenate([history, means(state, history[-1])[None]])
    centroids = spark.createDataFrame([(j, c.tolist()) for j, c in enumerate(history[-1])], "cluster int, centroid array<int>")
    return state.select("vec_id", "cluster", "distance"), centroids


def cluster_digests(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Inertia of each cluster and of all, and a checksum of each vector's centroid."""
    total = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # one row per cluster
    total = total.withColumn("inertia", total.agg(F.sum("cluster_inertia")).scalar())
    marked = centroids.select("cluster", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))
    return (assigned.join(F.broadcast(total), "cluster").join(F.broadcast(marked), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
