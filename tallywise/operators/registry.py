"""Model registry as an append-only event table with a latest-wins view.

Events are ``(model, version, locations, metrics, training_data, ts, status,
extra, seq)``. An upsert and a status change are both appended rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise.constants import OPTIONAL_COMPONENT, REQUIRED_COMPONENT, SOURCES
from tallywise.operators.ordered import first_rows

REGISTRY_SCHEMA = (
    "model string, version int, locations map<string,string>, metrics map<string,double>, "
    "training_data string, ts timestamp, status string, extra map<string,string>, seq long")
ENTRY_FIELDS = ["locations", "metrics", "training_data", "ts", "status", "extra"]


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY_SCHEMA)


def current_entries(events: DataFrame) -> DataFrame:
    """The last event of each (model, version)."""
    last = F.max_by(F.struct(*ENTRY_FIELDS), F.col("seq"))
    return (events.groupBy("model", "version").agg(last.alias("e"))
            .select("model", "version", "e.*"))


def register(entry: DataFrame, at: Column, seq: Column) -> DataFrame:
    """Registration events, status active."""
    return entry.withColumns({"ts": at, "status": F.lit("active"), "seq": seq})


def status_change(events: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """Events with the new status appended; changes of absent versions do nothing.

    ``changes`` is ``(model, version, status, seq)``.
    """
    now = current_entries(events).drop("status", "ts")
    new = changes.join(now, ["model", "version"]).withColumn("ts", at)
    return events.unionByName(new.select(*events.columns))


def latest_versions(entries: DataFrame) -> DataFrame:
    """Each model's entry with the highest version number."""
    rest = [c for c in entries.columns if c not in ("model", "version")]
    return (entries.groupBy("model").agg(
        F.max("version").alias("version"),
        F.max_by(F.struct(*rest), F.col("version")).alias("e")).select("model", "version", "e.*"))


def version_list(entries: DataFrame) -> DataFrame:
    """Number of versions, lowest and highest per model."""
    return entries.groupBy("model").agg(F.count_distinct("version").alias("versions"),
                                        F.min("version").alias("first_version"),
                                        F.max("version").alias("last_version"))


def entry_at(entries: DataFrame, model: str, version: int | None = None) -> DataFrame:
    """A model's entry at a version, or at the latest one."""
    one = entries.where(F.col("model") == model)
    return latest_versions(one) if version is None else one.where(F.col("version") == version)


def old_versions(entries: DataFrame, keep: int = 3) -> DataFrame:
    """Versions below the newest ``keep`` of each model.

    Only the kept ones are ranked, which the rank-limit push-down makes cheap
    even for a model with very many versions.
    """
    slim = entries.select("model", "version").distinct()
    kept = first_rows(slim, ["model"], [F.desc("version")], keep)
    oldest_kept = kept.groupBy("model").agg(F.min("version").alias("_floor"))
    return entries.join(oldest_kept, "model").where(F.col("version") < F.col("_floor")).drop("_floor")


def older_than(files: DataFrame, modified: str, now: Column, days: int = 30) -> DataFrame:
    """Files whose modification date lies more than ``days`` before ``now``."""
    return files.where(F.datediff(now, F.col(modified)) > days)


def component_availability(latest: DataFrame, sources: DataFrame, models: list[str]) -> DataFrame:
    """Per source: which components have a registered version, and if it can predict.

    A component is registered as ``{source}_{component}``. The vectoriser is
    required; at least one model is needed; the encoder is optional.
    """
    wanted = [REQUIRED_COMPONENT, OPTIONAL_COMPONENT, *models]
    needed = sources.select("source", F.explode(F.array(*[F.lit(w) for w in wanted]))
                            .alias("component"))
    found = needed.join(latest.select("model", "version"),
                        F.concat_ws("_", "source", "component") == F.col("model"), "left")
    has = lambda c: F.bool_or((F.col("component") == c) & F.col("version").isNotNull())
    flags = found.groupBy("source").agg(
        *[F.max(F.when(F.col("component") == c, F.col("version"))).alias(f"{c}_version")
          for c in wanted],
        *[has(c).alias(f"has_{c}") for c in wanted])
    any_model = F.col(f"has_{models[0]}")
    all_models = F.col(f"has_{models[0]}")
    for m in models[1:]:
        any_model = any_model | F.col(f"has_{m}")
        all_models = all_models & F.col(f"has_{m}")
    return flags.withColumns({
        "can_predict": F.col(f"has_{REQUIRED_COMPONENT}") & any_model,
        "complete": F.col(f"has_{REQUIRED_COMPONENT}") & all_models})


def source_model_version(latest: DataFrame, model: str) -> DataFrame:
    """``v{n}`` of ``{source}_{model}``, one row for each of the two sources."""
    name = F.regexp_extract("model", rf"^(.+)_{model}$", 1)
    return latest.where(name.isin(SOURCES)).select(
        name.alias("transaction_source"),
        F.concat(F.lit("v"), F.col("version").cast("string")).alias("source_model_version"))
