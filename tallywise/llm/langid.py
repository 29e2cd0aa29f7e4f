"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallywise.llm.common import held_out, prepare_workers, text_or_empty
from tallywise.llm.learn import ftrl, labelled_sample, sample_features, softmax, temperature, with_texts

SIZE = 1 << 16
SAMPLE = 6000  # labelled rows that the weights are fitted on
CALIBRATE = 5  # every fifth of them sets the temperature only
SCALE = 100.0  # frequencies are small numbers; one constant for all
PART = 1 << 20  # characters that one vectorised step works on


def grams(text: str) -> Iterator[np.ndarray]:
    """Hash numbers of all character 1-, 2- and 3-grams in lower case; every non-letter counts as a space."""
    text = text.lower()
    for start in range(0, len(text), PART):
        chars = text[max(0, start - 2):start + PART]
        code = np.frombuffer(chars.encode("utf-32-le", "replace"), "<u4").astype(np.uint32)
        letters = ((code >= 97) & (code <= 122)) | (code >= 0xAA)
        code = np.where(letters, code, 32)
        new = 0 if start == 0 else 2
        one = code * np.uint32(0x9E3779B1)
        yield one[new:] >> np.uint32(16)
        two = (one[:-1] ^ (code[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
        yield two[max(new - 1, 0):] >> np.uint32(16)
        three = (two[:-1] ^ (code[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
        yield three >> np.uint32(16)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams; counts scaled to 16 bits (they are used as shares of the text)."""
    held = [g for g in grams(text) if len(g)]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number, count = np.unique(np.concatenate(held), return_counts=True)
    share = np.maximum(count * (60000.0 / count.sum()), 1)
    return number.astype(np.int64), share.astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each gram number occurs; at most SIZE rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            for text in batch.column("body").to_pylist():
                seen = np.zeros(SIZE, bool)
                for g in grams(text):
                    seen[g] = True
                total[:SIZE] += seen
                total[SIZE] += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(SIZE + 1, np.int64)
    for gram, n in docs.select("body").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out[:SIZE], int(out[SIZE])


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # idf times weight, SIZE x languages
    bias: np.ndarray
    heat: float

    def probabilities(self, text: str) -> np.ndarray:
        total, logits = 0, np.zeros(len(self.languages))
        for g in grams(text):
            total += len(g)
            logits += self.table.take(g, axis=0).sum(axis=0)
        return softmax((logits * (SCALE / max(total, 1)) + self.bias) / self.heat)


def train(spark: SparkSession, docs: DataFrame, learn, id_col: str, text_col: str, lang_col: str,
          sample: int = SAMPLE) -> Model | None:
    """Fit on rows where ``learn`` holds and the language is known; None without any."""
    prepare_workers(spark)
    rows = docs.where(learn).where(F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("label"), text_or_empty(text_col).alias("body"))
    picked = labelled_sample(with_texts(rows.select("doc_id", "body"), rows.select("doc_id", "label")), sample)
    held = sample_features(rows.select("doc_id", "body"), picked, features)
    held = [row for row in held if len(row[1])]
    if not held:
        return None
    languages = sorted({str(row[0]) for row in held})
    number = {name: i for i, name in enumerate(languages)}
    seen, n = document_frequencies(rows)
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    data = [(number[str(name)], at, x / x.sum() * SCALE * idf[at]) for name, at, x in held]
    rest = data[::CALIBRATE]
    fit = [row for i, row in enumerate(data) if i % CALIBRATE] or data
    weights, bias = ftrl(fit, SIZE, len(languages), epochs=3, alpha=0.1, beta=1.0, l1=0.02, l2=0.01)
    logits = np.array([x @ weights[at] + bias for _, at, x in rest])
    heat = temperature(logits, np.array([label for label, _, _ in rest]))
    return Model(languages, (weights * idf[:, None]).astype(np.float32), bias, heat)


def identify(spark: SparkSession, docs: DataFrame, learn=None, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows where ``learn`` holds (default: crc32 of the id mod 3 is
    not 1) with text and language. ``lang_pred`` is a language seen there, or
    ``und`` with score 0 if the text is null or has no letter, or if there was
    nothing to learn from. The score is the calibrated probability. Repeated rows
    get the same answer, null ids are not held out and not learned from; an empty
    table gives an empty result; other columns are ignored.
    """
    out_of_fold = held_out(3, 1, id_col)
    model = train(spark, docs, ~out_of_fold if learn is None else learn, id_col, text_col, lang_col, sample)
    shared = spark.sparkContext.broadcast(model)  # SIZE rows of a float for each language
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), out_of_fold.alias("held_out"),
                       text_or_empty(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("body").to_pylist():
                if own is None or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                p = own.probabilities(text)
                names.append(own.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()),
                                              pa.array(scores, pa.float64())],
                                             names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(run, rows.select("doc_id", "held_out").schema.add("lang_pred", T.StringType())
                           .add("score", T.DoubleType()))
