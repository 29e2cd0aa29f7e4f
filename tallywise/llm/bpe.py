"""Byte-level BPE with tiktoken and a local rank file.

Long texts are cut before a single space between two letters. No match of the
splitting pattern can cross such a place, so the chunks give the ids of the
whole text and no call gets more than about ``CHUNK`` characters, unless a text
has no such place.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallywise.llm.common import prepare_workers, text_or_empty

CHUNK = 16_384
SAFE = regex.compile(r"(?<=\p{L})(?= \p{L})")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """Once per Python worker. The file must be at the same place on every machine."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Pieces of ``text`` that can be encoded one by one; joined they are the text."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def encode(spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and ids (array of int), without special tokens.

    A null text counts as empty and gives an empty array. Repeated rows are
    encoded each; null ids pass through; other columns are ignored.
    """
    prepare_workers(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("body"))
    out = rows.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [ids_of(enc, text.as_py()) for text in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists_of(ids)], names=["doc_id", "ids"])

    return rows.mapInArrow(run, out)


def ids_of(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """All ids of a text, four bytes each."""
    return np.concatenate([np.array(enc.encode_ordinary(part), np.int32) for part in chunks(text)])


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int32)])))


def round_trip(spark: SparkSession, docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``decode(encode(docs))`` in one pass over the texts: doc_id, ids, decoded."""
    prepare_workers(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("body"))
    out = rows.select("doc_id").schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [ids_of(enc, text.as_py()) for text in batch.column("body")]
            raw = [enc.decode_bytes(x.tolist()) for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists_of(ids), pa.array(raw, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, out)


def decode(spark: SparkSession, tokens: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the raw bytes of ``ids`` (null ids: null); cut characters stay as they are."""
    prepare_workers(spark)
    out = tokens.select("doc_id", "ids").schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(ids.as_py()) if ids.is_valid else None for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(raw, pa.binary())],
                                             names=["doc_id", "ids", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, out)
