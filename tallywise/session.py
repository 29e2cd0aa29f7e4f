"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
READ_PARTS = "spark.sql.files.minPartitionNum"


def build_session(app: str = "tallywise", master: str | None = None,
                  shuffle_partitions: int | None = None, scratch: str | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC time.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: adaptive
    execution starts from ``initialPartitionNum`` and merges small partitions.
    ``scratch`` becomes ``spark.checkpoint.dir``; leave it unset where the
    cluster names that folder itself.
    """
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false"))
    if scratch:
        b = b.config("spark.checkpoint.dir", scratch)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


_LOCAL_SCRATCH: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session in local mode, where driver and tasks are one process, may
    do without the setting; it then uses one temporary folder. On a cluster
    other machines could not see that, so an unset value is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _LOCAL_SCRATCH:
        _LOCAL_SCRATCH.append(tempfile.mkdtemp(prefix="tallywise-"))
    return _LOCAL_SCRATCH[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/tallywise/{name}-{uuid.uuid4().hex}"


def materialise(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """While this holds, the shuffle files of a query go when it ends, not when the driver happens to collect its garbage.

    For steps that write what they find and never run the same plan again.
    """
    with setting(spark, DROP_SHUFFLES, "true"):
        yield


@contextmanager
def read_in(spark: SparkSession, parts: int) -> Iterator[None]:
    """While this holds, the files of a table that was written in ``parts`` large equal files are read in as many partitions."""
    with setting(spark, READ_PARTS, str(parts)):
        yield


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
