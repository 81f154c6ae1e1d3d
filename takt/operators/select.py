"""Top-k selections, deduplication and set operations."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_k_drivers(contrib: DataFrame, k: int, row_keys=("row_id",)) -> DataFrame:
    """Per row the k largest contributions by size, with their direction (long rows: feature, contribution)."""
    w = Window.partitionBy(*row_keys).orderBy(F.abs("contribution").desc(), "feature")
    c = F.col("contribution")
    return (contrib.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("direction", F.when(c > 0, "increases_risk").when(c < 0, "decreases_risk").otherwise("neutral")))


def top_k_signed(contrib: DataFrame, k: int, row_keys=("row_id",)) -> DataFrame:
    """Per row the k strongest raising and the k strongest lowering contributions."""
    c = F.col("contribution")
    signed = contrib.filter(c != 0).withColumn("effect", F.when(c > 0, "increases").otherwise("decreases"))
    w = Window.partitionBy(*row_keys, "effect").orderBy(F.abs("contribution").desc(), "feature")
    return signed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def case_samples(scored: DataFrame, threshold: float, k: int, tie: str = "seq") -> DataFrame:
    """k examples of each outcome: surest hits and false alarms, misses and passes nearest the line."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    case = F.when(hit & pos, "TP").when(hit, "FP").when(pos, "FN").otherwise("TN")
    pick = F.when(hit & ~pos, -F.col("score")).when(hit, -F.col("score")).otherwise(F.abs(F.col("score") - threshold))
    w = Window.partitionBy("case").orderBy("pick", tie)
    return (scored.withColumn("case", case).withColumn("pick", pick)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("pick"))


def first_alert(scored: DataFrame, threshold: float, order=("seq",)) -> DataFrame:
    """First row of each unit at or above the threshold."""
    return scored.filter(F.col("score") >= threshold).groupBy("run_id", "unit_id").agg(
        F.min_by(F.struct("seq", "station_index", "score"), F.struct(*order)).alias("f")).select(
        "run_id", "unit_id", "f.*")


def ranked_alerts(df: DataFrame, order: list, n: int) -> DataFrame:
    """Top n of a report: each task keeps n rows, the driver side merges n per task."""
    return df.orderBy(*order).limit(n)


def concat_runs(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, z: a.unionByName(z, allowMissingColumns=True), frames)


def split_overlap(a: DataFrame, z: DataFrame) -> DataFrame:
    return a.select("run_id").intersect(z.select("run_id"))


def missing_levels(df: DataFrame, column: str, levels: list[str]) -> DataFrame:
    """Observed values outside the allowed levels."""
    return df.select(column).filter(F.col(column).isNotNull() & ~F.col(column).isin(levels)).distinct()


def missing_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Required columns the table lacks (schema only, no scan)."""
    absent = [c for c in required if c not in df.columns]
    return df.sparkSession.createDataFrame([(c,) for c in absent], "column_name string")


def dedupe_station_time(df: DataFrame, keys=("run_id", "station_id", "timestamp_ms"), order: str = "emission") -> DataFrame:
    """Keep the last emitted row per (run, station, time); merges map-side, no group is collected."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
