"""Quality classifier: supervised subword embeddings.

Every word stands for several hashed features: itself, its shape, its character
n-grams, and whether it repeats the word before it. The learned vectors of all
features of a document are averaged and go through a softmax layer; both are
trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallywise.llm.common import held_out, prepare_workers, text_or_empty
from tallywise.llm.learn import labelled_sample, sample_features, softmax, with_texts

BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4)
SAMPLE = 5000  # labelled rows that the vectors are fitted on
EPOCHS = 4
RATE = 0.3
CACHE = 150_000  # words whose summed features a worker remembers
THRESHOLD = 0.3

REPEAT = "\0repeat"
SHAPES = ((regex.compile(r"\p{Lu}"), "A"), (regex.compile(r"\p{L}(?<!A)"), "a"), (regex.compile(r"\p{N}"), "0"),
          (regex.compile(r"(.)\1+"), r"\1+"))


def shape(word: str) -> str:
    """Letters, digits and marks by kind, runs shortened."""
    if word.isalpha():
        if word.islower():
            return "a" if len(word) == 1 else "a+"
        if len(word) > 2 and word[1:].islower():
            return "Aa+"
    elif len(word) > 3 and word[-1] in ".,;:!?" and word[:-1].isalpha() and word[1:-1].islower():
        if word[0].islower():
            return "a+" + word[-1]
        if word[0].isupper():
            return "Aa+" + word[-1]
    for pattern, to in SHAPES:
        word = pattern.sub(to, word)
    return word


def word_features(word: str) -> list[int]:
    if word == REPEAT:
        return [crc32(REPEAT.encode()) % BUCKETS] * 4  # weighs like a word with its n-grams
    low, form = f"<{word.lower()}>", shape(word)
    raw, size = low.encode("utf-8", "replace"), len(low)
    out = [raw, f"\1{form}".encode("utf-8", "replace"), f"\2{form}".encode("utf-8", "replace")]
    for n in GRAMS:
        if len(raw) == size:  # one byte a letter
            out += [raw[i:i + n] for i in range(size - n + 1)]
        else:
            out += [low[i:i + n].encode("utf-8", "replace") for i in range(size - n + 1)]
    return [crc32(x) % BUCKETS for x in out]


def words_of(text: str) -> Counter:
    tokens = text.split()
    counts = Counter(tokens)
    again = sum(map(operator.eq, tokens, tokens[1:]))
    if again:
        counts[REPEAT] = again
    return counts


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features; counts scaled to 16 bits (they are used as shares of the text)."""
    number: list[int] = []
    count: list[int] = []
    for word, n in words_of(text).items():
        own = word_features(word)
        number += own
        count += [n] * len(own)
    if not number:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, back = np.unique(number, return_inverse=True)
    total = np.bincount(back, weights=count)
    return at, np.maximum(total * (60000.0 / total.sum()), 1).astype(np.int64)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> tuple[np.ndarray, float]:
    """What each feature adds to the logit of label 1 when averaged, and the constant."""
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer = np.zeros((WIDTH, 2), np.float32)
    bias = np.zeros(2, np.float32)
    steps, at_step = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        for i in random.permutation(len(rows)):
            label, at, x = rows[i]
            rate = RATE * (1 - at_step / steps)
            at_step += 1
            share = (x / x.sum())[:, None] if len(x) else np.zeros((0, 1), np.float32)
            mean = (vectors[at] * share).sum(axis=0)
            p = softmax(mean @ layer + bias)
            p[label] -= 1
            back = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            vectors[at] -= rate * share * back * len(at) ** 0.5  # features of long texts would hardly move otherwise
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learned only from rows whose crc32 of the id mod 5 is not 0.
    Null and empty texts get the score of a document without features. With no
    labels, or of one kind only, every score is the share of label 1 (0.5
    without any). Labels other than 0 and 1 are ignored, repeated ones count
    once. Null ids are scored and not learned from; repeated rows get the same
    score; an empty table gives an empty result; other columns are ignored.
    """
    prepare_workers(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(5, 0, id_col).alias("held_out"),
                       text_or_empty(text_col).alias("body"))
    known = labels.select("doc_id", F.col(f"`{label_col}`").cast("int").alias("label")).where("label in (0, 1)")
    picked = labelled_sample(with_texts(rows, known.where(~held_out(5, 0))), sample)
    held = sample_features(rows.where("not held_out").select("doc_id", "body"), picked, features)
    kinds = {label for label, _, _ in held}
    model = train(held) if len(kinds) == 2 else (np.zeros(BUCKETS), {0: -20.0, 1: 20.0}.get(next(iter(kinds), 2), 0.0))
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        weights = weights.astype(float).tolist()
        cache: dict[str, tuple[float, int]] = {}
        for batch in batches:
            scores = []
            for text in batch.column("body").to_pylist():
                total, n = 0.0, 0
                for word, count in words_of(text).items():
                    if (got := cache.get(word)) is None:
                        own = word_features(word)
                        got = (sum(weights[f] for f in own), len(own))
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[word] = got
                    total += got[0] * count
                    n += got[1] * count
                scores.append(1 / (1 + np.exp(-np.clip(total / max(n, 1) + bias, -30, 30))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()),
                 pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, rows.select("doc_id", "held_out").schema.add("score", T.DoubleType())
                           .add("predicted", T.IntegerType()))
