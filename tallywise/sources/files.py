"""Scans of ledger files, manifests, dictionaries, registries and logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallywise.constants import UPLOAD_EXTENSIONS, UPLOAD_MAX_BYTES
from tallywise.functions.filenames import base_name, extension, version_in
from tallywise.functions.money import human_size
from tallywise.operators.taxonomy import dictionary_from_lines
from tallywise.sources.grids import body_cells
from tallywise.sources.lines import cells, records

MOST_COLUMNS = 10_000  # distinct names over all headers

REGISTRY_JSON = (
    "models map<string, map<string, struct<locations: map<string,string>, "
    "metrics: map<string,double>, training_data: string, timestamp: string, status: string>>>")
METRICS_JSON = (
    "ts timestamp, batch_size long, confidence_stats struct<mean: double, median: double, "
    "std: double, low_confidence_rate: double>, category_distribution map<string, long>")


def scan_csv(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """CSV with a header, every column as text, with the file it came from.

    Cells are taken by the names in their own file's header, so files may order
    their columns differently; a column that a file lacks is null there.
    """
    rows = body_cells(scan_grid(spark, paths))
    # one row per distinct name
    names = rows.select(F.explode(F.map_keys("cells")).alias("name")).distinct().limit(MOST_COLUMNS + 1).collect()
    if len(names) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} distinct column names")
    return rows.select(*[F.element_at("cells", F.lit(r.name)).alias(r.name) for r in sorted(names)], "file")


def scan_grid(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Files of any layout as ``(file, row_no, cells)``, cells being an array as wide as the record.

    Row numbers are line numbers of the file from 0, with blank lines counted;
    blank records have no row. Quoted cells keep their line breaks.
    """
    found = records(spark, paths).where(F.trim("record") != "")
    return found.select("file", "row_no", cells(F.col("record")).alias("cells"))


def manifest(spark: SparkSession, folders: list[str], pattern: str = "*.{csv,xlsx,xls}") -> DataFrame:
    """Files of the folders with size and time; file contents are not read."""
    found = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(folders)
             .select("path", F.col("modificationTime").alias("modified"),
                     F.col("length").alias("size")))
    return (found.where(extension(F.col("path")).isin(UPLOAD_EXTENSIONS)).dropDuplicates(["path"])
            .select("path", base_name(F.col("path")).alias("name"),
                    F.regexp_replace("path", r"/[^/]*$", "").alias("directory"), "size",
                    human_size(F.col("size")).alias("size_human"), "modified"))


def top_files(files: DataFrame, sort_by: str = "modified_date", n: int = 20) -> DataFrame:
    """Files in the chosen order; the first ``n``, or all when ``n`` is not positive."""
    order = {"modified_date": [F.desc("modified")], "name": [F.lower("name")],
             "size": [F.desc("size")]}[sort_by]
    out = files.orderBy(*order, "path")
    return out.limit(n) if n > 0 else out


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first-seen row of each key."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("r"))
            .select(key, "r.*"))


def admitted(files: DataFrame) -> DataFrame:
    """Upload admission: a known extension and at most 10 MiB."""
    ext_ok = extension(F.col("name")).isin(UPLOAD_EXTENSIONS)
    return files.withColumn("admitted", ext_ok & (F.col("size") <= UPLOAD_MAX_BYTES))


def latest_training(files: DataFrame) -> DataFrame:
    """Per source, the training file with the highest version number in its name."""
    name = F.regexp_extract("name", r"^training_data_(.+)_v\d+", 1)
    tagged = files.select(name.alias("transaction_source"), "name",
                          version_in(F.regexp_extract("name", r"(_v\d+)", 1)).alias("version"))
    return (tagged.where((F.col("transaction_source") != "") & F.col("version").isNotNull())
            .groupBy("transaction_source")
            .agg(F.max("version").alias("version"),
                 F.max_by("name", F.struct("version", "name")).alias("name")))


def scan_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Category dictionary; an empty one is an error."""
    words = dictionary_from_lines(spark.read.text(path))
    if words.isEmpty():
        raise ValueError(f"no categories in {path}")
    return words


def scan_accounts(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Account lists as one nested row per file, or per line."""
    pair = "array<struct<name: string, {}>>"
    return spark.read.option("multiLine", one_per_file).schema(
        f"household_staff {pair.format('roles: array<string>')}, "
        f"personal_loans {pair.format('types: array<string>')}, "
        f"bank_accounts {pair.format('type: string')}, "
        "investments array<struct<name: string>>, other_accounts array<struct<name: string>>"
    ).json(path)


def scan_registry(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Nested registry JSON, per file or per line, as one row per model and version."""
    try:
        doc = spark.read.option("multiLine", one_per_file).schema(REGISTRY_JSON).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        doc = spark.createDataFrame([], REGISTRY_JSON)  # no registry yet
    by_model = doc.select(F.explode("models").alias("model", "versions"))
    return by_model.select("model", F.explode("versions").alias("v", "e")).select(
        "model", F.col("v").try_cast("int").alias("version"), "e.locations", "e.metrics",
        "e.training_data", F.try_to_timestamp("e.timestamp").alias("ts"), "e.status")


def scan_metrics_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_JSON).json(path)
