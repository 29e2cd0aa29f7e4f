"""File-drop ingest: new statement files to predictions, exactly once per file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LEDGER_FILE = "txn_id long, Date string, Description string, Amount string, transaction_source string"


def run_file_drop(spark: SparkSession, inbox: str, results: str, checkpoint: str,
                  predict: Callable[[DataFrame], DataFrame],
                  schema: str = LEDGER_FILE) -> StreamingQuery:
    """Process all files now in the inbox, then stop. A file whose header differs from the schema's names is an error.

    Each micro-batch is written under its own batch number and replaces what an
    interrupted attempt of the same batch may have left.
    """
    stream = spark.readStream.option("header", True).option("escape", '"').option("enforceSchema", False).schema(schema).csv(inbox)

    def handle(batch: DataFrame, number: int) -> None:
        predict(batch).write.mode("overwrite").parquet(f"{results}/batch={number}")

    return (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
