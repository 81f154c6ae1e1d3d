"""Readers of run folders, bundles, documents, prediction streams and feature tables."""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from takt.contracts import PREDICTIONS, TABLES
from takt.functions import scalar as sc
from takt.operators.slices import numbered
from takt.session import shared_root

# File names of a complete run folder.
REQUIRED_FILES = ["station_events.csv", "sensor_readings.csv", "manual_checks.csv", "inspection_results.csv",
                  "stations.csv", "units.csv", "run_metadata.json"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one (see ``session.shared_root``)."""
    return f"{shared_root(spark)}/takt-{uuid.uuid4().hex}"


def run_of_path(path: Column | str = "_metadata.file_path") -> Column:
    """Run id from the folder name, plain (run_x/) or partition style (run_id=run_x/)."""
    return F.regexp_extract(sc.col(path), r"/(?:run_id=)?(run_[^/]+)/", 1)


def read_run_table(spark: SparkSession, root: str, table: str, glob: str | None = None, header: bool = True) -> DataFrame:
    """One CSV table over all run folders: fixed schema, NaN as NULL, run id from the folder."""
    schema = TABLES[table]
    raw = (spark.read.schema(schema).option("header", header).option("nanValue", "NaN").option("mode", "PERMISSIVE")
           .csv(f"{root}/{glob or f'run_*/{table}.csv'}"))
    doubles = {f.name for f in schema.fields if isinstance(f.dataType, T.DoubleType)}
    return raw.select(run_of_path().alias("run_id"), *[
        (sc.clean_number(c) if c in doubles else F.col(c)).alias(c) for c in schema.names if c != "run_id"])


def with_event_sequence(events: DataFrame, width: int = 600_000) -> DataFrame:
    """Arrival order per run: the number inside the event id when there is one, else (time, id) order."""
    if "event_sequence" in events.columns:
        return events
    n = numbered(events, ["run_id"], ["timestamp_ms", "event_id"], width, name="event_sequence")
    return n.withColumn("event_sequence", F.coalesce(
        F.nullif(F.regexp_extract("event_id", r"(\d+)$", 1), F.lit("")).try_cast("long"), F.col("event_sequence") - 1))


def discover_runs(spark: SparkSession, root: str, required: list[str] = REQUIRED_FILES, glob: str = "run_*") -> DataFrame:
    """Per run folder: missing files, and complete = nothing missing and the metadata names a schema.

    Only paths are listed (file contents are not read, except the small metadata documents).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.*").load(f"{root}/{glob}").select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(run_of_path("path").alias("run_id"), name.alias("name")).groupBy("run_id").agg(
        F.collect_set(F.when(F.col("name").isin(required), F.col("name"))).alias("found"))
    try:
        meta = read_run_documents(spark, f"{root}/{glob}/run_metadata.json").select(
            "run_id", F.col("doc.schema_version").isNotNull().alias("has_schema"))
    except AnalysisException:
        meta = spark.createDataFrame([], "run_id string, has_schema boolean")
    missing = F.array_sort(F.array_except(F.array(*[F.lit(r) for r in required]), F.col("found")))
    return found.join(meta, "run_id", "left").select(
        "run_id", missing.alias("missing"), ((F.size(missing) == 0) & F.coalesce("has_schema", F.lit(False))).alias("complete"))


def read_run_documents(spark: SparkSession, glob: str, table: str = "run_metadata") -> DataFrame:
    """Small JSON documents, one row per file; unreadable content gives a NULL document."""
    raw = spark.read.option("wholetext", True).text(glob)
    doc = F.from_json("value", TABLES[table], {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    valid = F.try_parse_json("value").isNotNull()
    return raw.select(run_of_path().alias("run_id"), F.when(valid, doc).alias("doc"))


def read_prediction_stream(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON lines of a prediction stream; ``_corrupt_record`` holds bad lines, a missing path is empty."""
    schema = T.StructType(PREDICTIONS[kind].fields + [T.StructField("_corrupt_record", T.StringType())])
    try:
        lines = spark.read.text(path).filter(F.trim("value") != "")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")


def stream_health(preds: DataFrame) -> DataFrame:
    """Good and malformed line counts of a read stream."""
    bad = F.col("_corrupt_record").isNotNull()
    return preds.agg(F.count_if(~bad).alias("records"), F.count_if(bad).alias("malformed_lines"))


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Materialised features: parquet, or CSV with an explicit schema."""
    if path.endswith(".csv") or schema is not None:
        return spark.read.schema(schema).option("header", True).csv(path)
    return spark.read.parquet(path)
