"""Stages of the corpus pipeline; each calls one operator and keeps the columns of ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.llm import bpe, decontam, exact, jaccard, toxicity
from tallywise.llm.common import table, without
from tallywise.llm.queries import token_digests


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the scorer rejects go."""
    scored = toxicity.score_toxicity(spark, docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where("predicted = 1"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return without(docs, exact.exact_dedup(spark, docs).where("not kept"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard similarity 0.8) the smallest doc_id stays; blank texts are none."""
    groups = jaccard.jaccard_groups(spark, docs)
    return without(docs, groups.where("doc_id <> component_id"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to a few edits, go."""
    return without(docs, decontam.contaminated(spark, docs, table(spark, sf_dir, "benchmark")))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every document that is left."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_digests(bpe.round_trip(spark, docs, ranks, public_tokenizers.PATTERN))


STAGES = [("toxicity", toxicity_stage), ("exact_dedup", exact_stage), ("simhash_near_dedup", near_stage),
          ("decontamination", decontamination_stage), ("byte_bpe", token_stage)]
