"""Writers: feature tables, prediction streams, run history."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takt.contracts import PREDICTIONS
from takt.functions import scalar as sc
from takt.operators.slices import beside


def write_features(df: DataFrame, path: str) -> None:
    """Parquet by run; refuses to overwrite. Rows of one run may be written by many tasks."""
    df.write.partitionBy("run_id").mode("errorifexists").parquet(path)


def contract_rows(df: DataFrame, kind: str) -> DataFrame:
    """Contract field order, absent fields NULL, non-finite numbers NULL."""
    fields = PREDICTIONS[kind].fields
    out = []
    for f in fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        out.append((sc.clean_number(c) if f.dataType.typeName() == "double" else c.cast(f.dataType)).alias(f.name))
    return df.select(*out)


def write_predictions(df: DataFrame, path: str, kind: str, fmt: str = "json") -> None:
    """Append prediction records as JSON lines, a JSON document set or flat CSV."""
    rows = contract_rows(df, kind)
    if fmt == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array")) else F.col(c) for c, t in rows.dtypes]
        rows.select(*flat).write.mode("append").option("header", True).csv(path)
    else:
        rows.write.mode("append").option("ignoreNullFields", False).json(path)


def upsert_run_history(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert or replace by run id; a new run without a day gets the next free day; the first creation
    time stays. The table has one row per run, so the day numbering over new runs is small."""
    newest = history.withColumn("__src", F.lit(0)).unionByName(incoming.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in history.columns if c not in ("run_id", "created_at", "production_day")]
    merged = newest.groupBy("run_id").agg(
        F.max_by(F.struct(*rest), F.struct("__src", "updated_at")).alias("r"), F.min("created_at").alias("created_at"),
        F.max_by("production_day", F.when(F.col("production_day").isNotNull(), F.struct("__src", "updated_at"))).alias("day"))
    top = merged.agg(F.coalesce(F.max("day"), F.lit(0)).alias("top"))
    fresh = beside(merged.filter("day IS NULL"), top).withColumn(
        "day", F.col("top") + F.row_number().over(Window.orderBy("r.updated_at", "run_id"))).drop("top")
    both = merged.filter("day IS NOT NULL").unionByName(fresh)
    return both.select("run_id", F.col("day").alias("production_day"), *[F.col("r")[c].alias(c) for c in rest], "created_at")


def duplicate_days(history: DataFrame) -> DataFrame:
    return history.groupBy("production_day").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
