"""Training helpers: bounded labelled samples, follow-the-regularised-leader, temperature."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

Features = Callable[[str], tuple[np.ndarray, np.ndarray]]  # text -> distinct feature numbers, counts


FLOOR = 300  # rows of every label that a sample holds at least, if there are as many


def with_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label and text_hash of every labelled document; ``docs`` has doc_id and body."""
    one = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    return docs.select("doc_id", F.xxhash64("body").alias("text_hash")).join(one, "doc_id")


def labelled_sample(labelled: DataFrame, limit: int, floor: int = FLOOR) -> DataFrame:
    """(doc_id, label) of ``limit`` different texts, spread evenly by their hash, and of at least ``floor`` of every label.

    ``labelled`` has doc_id, label and text_hash. So a rare label is learned at
    every size of the table, and copies take no place. At most ``limit`` rows
    and ``floor`` a label; both ranks are cut before the shuffle.
    """
    rows = labelled.groupBy("text_hash").agg(F.min_by(F.struct("doc_id", "label"), "doc_id").alias("row")).select("row.*", "text_hash")
    order = [F.xxhash64("text_hash"), F.col("text_hash")]
    spread = rows.orderBy(*order).limit(limit)
    each = rows.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("place") <= floor)
    return spread.select("doc_id", "label").union(each.select("doc_id", "label")).distinct()


def sample_features(docs: DataFrame, sample: DataFrame, features: Features) -> list[tuple[object, np.ndarray, np.ndarray]]:
    """(label, features, counts) of the sampled documents, one for each text; ``docs`` has doc_id and body.

    The sample is bounded, so it is broadcast, and its features fit the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [features(text) for text in batch.column("body").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([f.astype("<u4").tobytes() for f, _ in pairs], pa.binary()),
                 pa.array([n.astype("<u2").tobytes() for _, n in pairs], pa.binary())], names=["label", "f", "n"])

    kind = sample.schema["label"].dataType.simpleString()
    rows = (docs.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "body")
            .mapInArrow(run, f"label {kind}, f binary, n binary").toArrow())
    seen: dict[tuple[bytes, bytes], object] = {}
    for label, f, n in zip(*(rows.column(c).to_pylist() for c in ("label", "f", "n"))):
        seen.setdefault((f, n), label)  # copies of a text teach nothing new
    del rows
    order = sorted(seen, key=lambda key: hash_of(key[0] + key[1]))
    return [(seen[k], np.frombuffer(k[0], "<u4"), np.frombuffer(k[1], "<u2")) for k in order]  # views, no copies


def hash_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=8).digest()


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], size: int, classes: int, epochs: int, alpha: float, beta: float,
         l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression: per-coordinate FTRL-proximal with elastic net. Weights (size, classes), bias."""
    z = np.zeros((size, classes), np.float32)
    n = np.zeros((size, classes), np.float32)
    bias = np.zeros(classes)
    steps = np.full(classes, 1.0)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for label, at, x in rows:
            x = np.asarray(x, np.float32)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = softmax(x @ w + bias)
            p[label] -= 1
            g = x[:, None] * p[None, :]
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / alpha * w
            n[at] = grown
            steps += p * p
            bias -= 0.1 * p / np.sqrt(steps)
    return weights(z, n).astype(np.float32), bias


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits that gives held-back rows the least log loss."""
    if not len(labels):
        return 1.0
    tries = np.geomspace(0.05, 20, 61)
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in tries]
    return float(tries[int(np.argmin(loss))])
