"""Feedback: merge corrections into the training set, then retrain."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise.constants import SOURCE_SETTINGS, SOURCES
from tallywise.operators import models as ml
from tallywise.operators.registry import REGISTRY_SCHEMA, current_entries, empty_registry, register
from tallywise.operators.schema import add_canonical, align_to, cast_losses, choose_category, stamp_lineage
from tallywise.operators.search import halving
from tallywise.operators.validate import blocking_errors, column_presence, fold_sources, validation_report
from tallywise.session import materialise
from tallywise.sources.sinks import append_registry, write_training

log = logging.getLogger(__name__)


def next_versions(training: DataFrame) -> DataFrame:
    """``(transaction_source, next_version)`` for both sources, 1 when none exists."""
    spark = training.sparkSession
    known = training.groupBy("transaction_source").agg(F.max("training_version").alias("v"))
    every = spark.createDataFrame([(s,) for s in SOURCES], "transaction_source string")
    return every.join(known, "transaction_source", "left").select(
        "transaction_source", (F.coalesce("v", F.lit(0)) + 1).alias("next_version"))


def training_at(training: DataFrame, source: str, version: int) -> DataFrame:
    """The training set of one source as of a version."""
    return training.where((F.col("transaction_source") == source)
                          & (F.col("training_version") <= version))


def prepare_corrections(corrections: DataFrame, training: DataFrame) -> DataFrame:
    """Corrected rows in the training set's columns and types; amounts that are missing become 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    ready = aligned(corrections, training)
    return ready.withColumns({c: F.coalesce(F.col(f"`{c}`"), zero)
                              for c in ("Amount (Negated)", "Amount") if c in ready.columns})


def aligned(corrections: DataFrame, training: DataFrame) -> DataFrame:
    """The same before missing amounts are filled, as the rules see it."""
    return align_to(choose_category(add_canonical(corrections)), training.drop("training_version").schema)


def merged_rows(training: DataFrame, corrections: DataFrame, versions: DataFrame, at: Column,
                model_versions: DataFrame) -> DataFrame:
    """New training rows of all sources, with version and lineage.

    Nothing is dropped: a row whose source is null or has no version stops the job.

    ``versions`` and ``model_versions`` are brought to one row per known source before
    they are joined; a source with two different model versions stops the job.
    """
    ready = prepare_corrections(corrections, training)
    versions = one_per_source(versions, "next_version")
    model_versions = one_per_source(model_versions, "source_model_version")
    unknown = F.raise_error(F.concat(F.lit("no training version for source "), F.coalesce("transaction_source", F.lit("null"))))
    versioned = (ready.join(F.broadcast(versions), "transaction_source", "left")
                 .withColumn("next_version", F.coalesce("next_version", unknown.cast("int")))
                 .join(F.broadcast(model_versions.withColumnRenamed(
                     "source_model_version", "_mv")), "transaction_source", "left"))
    stamped = stamp_lineage(versioned.drop(*[c for c in (
        "correction_timestamp", "source_model_version") if c in versioned.columns]),
        at, F.col("_mv"))
    return stamped.withColumnRenamed("next_version", "training_version").drop("_mv")


def one_per_source(values: DataFrame, column: str) -> DataFrame:
    """``(transaction_source, column)`` with at most one row for each of the known sources."""
    differ = F.min(column) != F.max(column)
    clash = F.raise_error(F.concat(F.lit(f"several values of {column} for source "), "transaction_source"))
    value = F.when(differ, clash.cast(values.schema[column].dataType)).otherwise(F.max(column))
    return (values.where(F.col("transaction_source").isin(SOURCES)).groupBy("transaction_source")
            .agg(value.alias(column)))


def union_training(training: DataFrame, new_rows: DataFrame) -> DataFrame:
    """All rows of both by column name; missing columns become null, no dedupe."""
    return training.unionByName(new_rows, allowMissingColumns=True)


def new_only(training: DataFrame, new_rows: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not merged before, for reruns of the same corrections."""
    return new_rows.join(training.select(key), key, "left_anti")


def merge_corrections(training: DataFrame, corrections: DataFrame, dictionary: DataFrame,
                      at: Column, model_versions: DataFrame, path: str) -> DataFrame:
    """Validate, align and append corrections; returns the report.

    Any error-level rule, a missing column and a null or unknown source among them, stops the
    merge before anything is written. Values that the training set's types cannot take
    are warnings of the report, one row per column.
    """
    report = validation_report(aligned(corrections, training), dictionary)
    # aligning fills missing columns, so their absence is seen before it
    report = report.unionByName(column_presence(choose_category(add_canonical(corrections))))
    losses = cast_losses(choose_category(add_canonical(corrections)), training.drop("training_version").schema)
    report = report.unionByName(losses.select(
        F.lit(None).cast("string").alias("transaction_source"), F.concat(F.lit("cast_loss: "), "column_name").alias("rule"),
        F.lit("warning").alias("severity"), F.col("lost_values").alias("n")))
    blocked = blocking_errors(fold_sources(report)).collect()  # one row each for the known sources, null and all others
    if blocked:
        raise ValueError(f"validation failed: {[r.asDict() for r in blocked]}")
    rows = merged_rows(training, corrections, next_versions(training), at, model_versions)
    write_training(rows, path)
    return report


def settings_of(source: str) -> dict:
    """Samples a category needs, confidence threshold and analyzer of a source."""
    _, _, samples, threshold, _, analyzer, *_ = next(s for s in SOURCE_SETTINGS if s[0] == source)
    return {"min_samples": samples, "threshold": threshold, "analyzer": analyzer}


def claim_version(spark: SparkSession, root: str, source: str, known: int) -> int:
    """The first version after ``known`` that no other run has claimed.

    A claim is a file that only one run can create, so runs at the same time get different versions.
    """
    jvm, version = spark._jvm, known + 1
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    while True:
        place = jvm.org.apache.hadoop.fs.Path(f"{root}/claims/{source}/v{version}")
        if place.getFileSystem(conf).createNewFile(place):
            return version
        version += 1


def publish(spark: SparkSession, fitted: ml.SourceModels, metrics: dict[str, dict[str, float]], source: str, training_data: str,
            root: str, registry: str, extra: dict[str, str] | None = None) -> int:
    """Models first, under a folder of this version; then one registry file with all components is the commit.

    A run that ends in between leaves a claimed version that no registry entry names.
    """
    known = current_entries(read_registry(spark, registry)).where(F.col("model").startswith(f"{source}_"))
    version = claim_version(spark, root, source, known.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0])
    places = ml.save_models(fitted, f"{root}/{source}/v{version}")
    entries = spark.createDataFrame(
        [(f"{source}_{name}", version, {"path": place}, metrics.get(name, {}), training_data, extra or {}) for name, place in places.items()],
        "model string, version int, locations map<string,string>, metrics map<string,double>, training_data string, extra map<string,string>")
    now = F.current_timestamp()
    events = register(entries, now, F.unix_micros(now))
    append_registry(events.select(*empty_registry(spark).columns).coalesce(1), registry)  # one file appears whole or not at all
    return version


def read_registry(spark: SparkSession, registry: str) -> DataFrame:
    """All registry events; none before the first."""
    try:
        return spark.read.schema(REGISTRY_SCHEMA).parquet(registry)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty_registry(spark)


def registered_models(spark: SparkSession, registry: str, source: str) -> ml.SourceModels:
    """The latest registered models of a source, ready to predict."""
    entries = current_entries(read_registry(spark, registry)).where(
        F.col("model").startswith(f"{source}_") & (F.col("status") == "active"))
    rows = entries.select(F.substring("model", len(source) + 2, 1000).alias("component"), "version", "locations").collect()
    if not rows:
        raise ValueError(f"no registered models of {source}")
    last = max(r.version for r in rows)  # a few components for each version
    return ml.load_models({r.component: r.locations["path"] for r in rows if r.version == last})


def retrain(spark: SparkSession, training: DataFrame, source: str, row: str, root: str, registry: str,
            budget: float | None = None, **limits) -> int | None:
    """:func:`retrained` for a caller that goes on without new models: a failure is logged and gives ``None``; the merged data stay as they are."""
    try:
        return retrained(spark, training, source, row, root, registry, budget, **limits)
    except Exception as e:
        log.error("retraining %s failed, merged data kept: %s", source, e)
        return None


def retrained(spark: SparkSession, training: DataFrame, source: str, row: str, root: str, registry: str,
              budget: float | None = None, whole: bool = False, **limits) -> int:
    """Train one source on its whole training set with its own settings, evaluate, publish; the new version.

    With a ``budget``, in fits on all training rows, learners and settings are searched and the winner
    alone is published; without one all learners vote with their usual settings. Any failure is raised and
    registers nothing; with ``whole`` a learner that could not be trained is one, too.
    """
    chosen = settings_of(source)
    rows = training.where(F.col("transaction_source") == source)
    prepared = materialise(spark, ml.prepare(rows, row, "Description", "Category", chosen["min_samples"]), "prepared")
    if budget:
        fitted = halving(prepared, row, "Description", "Category", chosen["analyzer"], budget=budget, **limits).source
    else:
        fitted = ml.train(prepared, "Description", "Category", chosen["analyzer"], **limits)
        lost = [name for name in ml.MODEL_NAMES if name not in fitted.models]
        if whole and lost:
            raise ValueError(f"models of {source} could not be trained: {', '.join(lost)}")
    scored = materialise(spark, ml.model_columns(prepared.where("is_test"), "Description", fitted).drop("Description"), "scored")
    metrics = {}
    for name in fitted.models:
        found = ml.evaluate(scored, "Category", name, fitted.labels).first().asDict()
        metrics[name] = {k: float(v) for k, v in found.items() if k != "model" and v is not None}
    seen = rows.agg(F.count(F.lit(1)).alias("rows"), F.max("training_version").alias("v")).first()
    return publish(spark, fitted, metrics, source, f"{source}:v{seen.v}", root, registry,
                   {"rows": str(seen.rows), "analyzer": chosen["analyzer"], "threshold": str(chosen["threshold"])})
