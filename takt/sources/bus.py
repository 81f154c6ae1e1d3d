"""The tagged-union runtime bus: splitting, merging and what a hidden zone lets through."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.functions import scalar as sc


def split_bus(bus: DataFrame, checkpoints: DataFrame) -> dict[str, DataFrame]:
    """STATION / SENSOR / MANUAL / EVIDENCE tables and the rows breaking the bus contract."""
    kind = F.coalesce(sc.clean_text("record_type"), F.lit(""))
    b = bus.withColumn("kind", kind)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    base = [F.col("run_id"), F.col("timestamp_ms"), F.trim("station_id").alias("station_id")]
    station = b.filter("kind = 'STATION'").select(
        *base, blank("unit_id").alias("unit_id"), sc.clean_text("event_type").alias("event_type"),
        blank("event_id").alias("event_id"), F.col("sequence").alias("event_sequence"),
        sc.clean_number("queue_length_after").alias("queue_length_after"), blank("previous_state").alias("previous_state"),
        blank("new_state").alias("new_state"), sc.clean_number("cycle_time_ms").alias("cycle_time_ms"),
        blank("dark_zone_id").alias("dark_zone_id"))
    sensor_all = b.filter("kind = 'SENSOR'").select(
        *base, F.col("sequence").alias("event_sequence"), sc.clean_text("sensor_type").alias("sensor_type"),
        sc.clean_number("sensor_value").alias("value"), blank("sensor_unit").alias("unit"))
    sensor_ok = F.col("sensor_type").isNotNull() & F.col("value").isNotNull()
    manual_all = b.filter("kind = 'MANUAL'").select(
        *base, F.col("sequence").alias("event_sequence"), blank("unit_id").alias("unit_id"),
        F.trim("check_type").alias("check_type"), F.coalesce(sc.clean_text("check_result"), F.lit("")).alias("result"))
    manual_ok = F.col("unit_id").isNotNull() & F.col("result").isin("PASS", "FAIL")
    evidence_all = (b.filter("kind = 'EVIDENCE'").select(
        *base, F.col("sequence").alias("event_sequence"), blank("unit_id").alias("unit_id"),
        sc.clean_text("event_type").alias("event_type"), F.trim("checkpoint_id").alias("checkpoint_id"))
        .join(checkpoints.select("run_id", "station_id", "checkpoint_id",
                                 F.col("nominal_progress_fraction").alias("checkpoint_progress")),
              ["run_id", "station_id", "checkpoint_id"], "left"))
    evidence_ok = F.col("checkpoint_progress").isNotNull()

    def fault(df: DataFrame, rule, seq: str = "event_sequence") -> DataFrame:
        return df.select(rule.alias("rule") if not isinstance(rule, str) else F.lit(rule).alias("rule"), "run_id",
                         F.col(seq).cast("string").alias("key"), F.col("station_id").alias("detail"))

    odd = b.filter(~F.col("kind").isin("STATION", "SENSOR", "MANUAL", "EVIDENCE"))
    violations = (fault(odd, F.when(F.col("kind") == "INSPECTION", "inspection_on_bus").otherwise("unknown_record_type"), "sequence")
                  .unionByName(fault(sensor_all.filter(~sensor_ok), "malformed_sensor"))
                  .unionByName(fault(manual_all.filter(~manual_ok), "malformed_manual"))
                  .unionByName(fault(evidence_all.filter(~evidence_ok), "unknown_checkpoint")))
    return {"STATION": station, "SENSOR": sensor_all.filter(sensor_ok), "MANUAL": manual_all.filter(manual_ok),
            "EVIDENCE": evidence_all.filter(evidence_ok), "violations": violations}


def merge_streams(events: DataFrame, sensors: DataFrame, manual: DataFrame, evidence: DataFrame,
                  upstream: DataFrame) -> DataFrame:
    """One causal timeline. At equal times: corridor-entering completions, starts, other events and
    evidence, completions, readings, checks; then source order. The sort is a range partitioning."""
    up = upstream.select("run_id", "station_id", F.lit(True).alias("__up"))
    e = events.join(up, ["run_id", "station_id"], "left")
    kind = F.col("event_type")
    prio = (F.when((kind == "PROCESSING_COMPLETED") & F.col("__up"), -1).when(kind == "PROCESSING_STARTED", 0)
            .when(kind == "PROCESSING_COMPLETED", 2).otherwise(1))
    tagged = [e.withColumn("priority", prio).drop("__up").withColumn("stream", F.lit("station_event")),
              evidence.withColumn("priority", F.lit(1)).withColumn("stream", F.lit("evidence")),
              sensors.withColumn("priority", F.lit(20)).withColumn("stream", F.lit("sensor_reading")),
              manual.withColumn("priority", F.lit(30)).withColumn("stream", F.lit("manual_check"))]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.orderBy("run_id", "timestamp_ms", "priority", "event_sequence")


def drop_boundary_events(events: DataFrame) -> DataFrame:
    from takt.contracts import BOUNDARY_EVENTS
    return events.filter(~F.col("event_type").isin(BOUNDARY_EVENTS))


def model_eligible(df: DataFrame, stations: DataFrame) -> DataFrame:
    return df.join(stations.filter("buffer_capacity > 0"), ["run_id", "station_id"], "left_semi")


def public_view(bus: DataFrame, flags: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """What may leave a hidden zone: no station events; readings, checks and checkpoints by flag;
    a checkpoint names its unit only when it identifies units."""
    ids = checkpoints.select("run_id", "station_id", "checkpoint_id", "identifies_unit")
    j = bus.join(flags, ["run_id", "station_id"], "left").join(ids, ["run_id", "station_id", "checkpoint_id"], "left")
    dark, kind = F.coalesce("is_dark", F.lit(False)), F.col("record_type")
    visible = (~dark | ((kind == "SENSOR") & F.col("sensor_visible")) | ((kind == "MANUAL") & F.col("manual_visible"))
               | ((kind == "EVIDENCE") & F.col("checkpoint_visible")))
    named = F.when((kind == "EVIDENCE") & ~F.coalesce("identifies_unit", F.lit(False)), F.lit(None)).otherwise(F.col("unit_id"))
    return j.filter(visible).withColumn("unit_id", named).select(*bus.columns)
