"""From raw documents to tokens: five stages, each one operator of ``tallywise.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallywise.llm.common import save, table
from tallywise.llm.stages import STAGES

#: The stages train a scorer, compare fingerprints and run a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), name)
    return docs
