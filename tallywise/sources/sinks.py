"""Writers of stages, exports, logs, training sets, registries and dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_stage(df: DataFrame, path: str) -> None:
    """Stage rows partitioned by source, period and stage."""
    df.write.mode("append").partitionBy("source", "period", "stage").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 CSV export with a header and no index; a quote inside a quoted cell is doubled."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def append_metrics(log_rows: DataFrame, path: str) -> None:
    """One JSON line per batch."""
    log_rows.write.mode("append").json(path)


def write_training(rows: DataFrame, path: str) -> None:
    """Append new training rows under their source and version."""
    (rows.write.mode("append").partitionBy("transaction_source", "training_version")
     .parquet(path))


def append_registry(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def write_dictionary(categories: DataFrame, path: str) -> None:
    """Sorted categories, one per line; part files follow the order."""
    categories.select("category").orderBy("category").write.mode("errorifexists").text(path)
