"""Line tables derived from the given parquet tables (the same derivation as SQL text sits in
``catalog/sql.py``). Every row of the source table is used."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


FINAL_INDEX = 10
N_STATIONS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_log(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ()) -> DataFrame:
    """B1: every source event as one line record (STATION, SENSOR or MANUAL).

    ``types`` names source event types, so that a table of one kind filters in the scan."""
    e = table(spark, sf_dir, "events")
    if types:
        e = e.filter(F.col("event_type").isin(*types))
    # ts has no zone: its clock is read as it stands, whatever the session's zone
    t = "cast(ts AS timestamp_ntz)"
    day_us = f"(hour({t}) * 3600 + minute({t}) * 60) * 1000000L + cast(extract(SECOND FROM {t}) * 1000000 AS bigint)"
    index = (F.col("user_id") % N_STATIONS).cast("int")
    kind = (F.when(F.col("event_type") == "click", "SENSOR").when(F.col("event_type") == "error", "MANUAL")
            .otherwise("STATION"))
    etype = (F.when(F.col("event_type") == "signup", "UNIT_ARRIVED")
             .when(F.col("event_type") == "view", "PROCESSING_STARTED")
             .when(F.col("event_type") == "purchase", "PROCESSING_COMPLETED"))
    id_ = F.col("event_id")
    day = F.dayofmonth(F.col("ts").cast("timestamp_ntz"))
    return e.select(
        F.concat(F.lit("run_"), F.lpad(day.cast("string"), 4, "0")).alias("run_id"),
        day.alias("production_day"),
        F.expr(f"({day_us}) div 12000").alias("timestamp_ms"),
        id_.alias("event_sequence"), index.alias("station_index"),
        F.concat(F.lit("S"), F.lpad((index + 1).cast("string"), 2, "0")).alias("station_id"),
        F.expr("concat('U', lpad(cast((user_id div 12) % 5 + 1 as string), 6, '0'))").alias("unit_id"),
        kind.alias("record_type"), etype.alias("event_type"),
        F.when((kind == "STATION") & (id_ % 7 != 0), F.floor("value") % 6).cast("double")
        .alias("queue_length_after"),
        F.when(etype == "PROCESSING_COMPLETED", F.floor(F.col("value") * 1000)).cast("double")
        .alias("cycle_time_ms"),
        F.when(kind == "SENSOR", F.element_at(F.array(*[F.lit(s) for s in (
            "TORQUE", "VIBRATION", "TEMPERATURE", "CURRENT")]), (id_ % 4 + 1).cast("int"))).alias("sensor_type"),
        F.when(kind == "SENSOR", F.floor("value")).cast("double").alias("sensor_value"),
        F.when(kind == "MANUAL", F.when(id_ % 5 == 0, "FAIL").otherwise("PASS")).alias("check_result"),
        F.floor("value").cast("double").alias("amount"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), id_.alias("event_id"))


def on_clock(rows: DataFrame) -> DataFrame:
    """``event_time`` on a clock that all runs share: a day of its own for every run."""
    day = F.substring("run_id", 5, 4).cast("long")
    return rows.withColumn("event_time", F.timestamp_millis(day * 86_400_000 + F.col("timestamp_ms")))


def station_events(spark, sf_dir) -> DataFrame:
    return line_log(spark, sf_dir, ("signup", "view", "purchase")).select(
        "run_id", "timestamp_ms", "event_sequence", "station_index", "station_id", "unit_id", "event_type",
        "queue_length_after", "cycle_time_ms")


def sensor_readings(spark, sf_dir) -> DataFrame:
    return line_log(spark, sf_dir, ("click",)).select(
        "run_id", "timestamp_ms", "event_sequence", "station_index", "station_id", "sensor_type",
        F.col("sensor_value").alias("value"))


def manual_checks(spark, sf_dir) -> DataFrame:
    return line_log(spark, sf_dir, ("error",)).select(
        "run_id", "timestamp_ms", "event_sequence", "station_index", "station_id", "unit_id",
        F.col("check_result").alias("result"))


def inspections(spark, sf_dir) -> DataFrame:
    return manual_checks(spark, sf_dir).filter(F.col("station_index") == FINAL_INDEX)


def runs(spark, sf_dir) -> DataFrame:
    return line_log(spark, sf_dir).select("run_id", "production_day").distinct()


def stations(spark, sf_dir) -> DataFrame:
    """Twelve stations for every run seen in the log."""
    i = F.col("station_index")
    return (runs(spark, sf_dir).select("run_id", F.explode(F.sequence(F.lit(0), F.lit(N_STATIONS - 1)))
                                       .alias("station_index"))
            .select("run_id", F.concat(F.lit("S"), F.lpad((i + 1).cast("string"), 2, "0")).alias("station_id"),
                    i, F.concat(F.lit("Station "), (i + 1).cast("string")).alias("name"),
                    F.when(i.isin(5, 10), "INSPECTION").when(i == 7, "MANUAL").otherwise("AUTOMATED")
                    .alias("archetype"),
                    (36000 + 1000 * i).cast("long").alias("base_cycle_time_ms"),
                    F.floor((36000 + 1000 * i) / 10).cast("long").alias("cycle_time_std_ms"),
                    F.when(i == 0, 0).otherwise(3 + i % 3).alias("buffer_capacity"),
                    F.when(i == 7, "NONE").otherwise("HIGH").alias("sensor_coverage"),
                    i.between(3, 5).alias("is_dark")))


def units(spark, sf_dir) -> DataFrame:
    n = F.substring("unit_id", 2, 6).cast("int")
    return line_log(spark, sf_dir).select("run_id", "unit_id").distinct().select(
        "run_id", "unit_id", F.when(n % 5 == 0, "MODEL_B").otherwise("MODEL_A").alias("vehicle_model"),
        F.concat(F.lit("BATCH_"), (n % 3).cast("string")).alias("supplier_batch"))


def dark_zones(spark, sf_dir) -> DataFrame:
    return runs(spark, sf_dir).select(
        "run_id", F.lit("DZ01").alias("dark_zone_id"), F.lit("S04").alias("start_station_id"),
        F.lit("S06").alias("end_station_id"), F.lit(True).alias("sensor_telemetry"),
        F.lit(True).alias("manual_checks"), F.lit(True).alias("checkpoints"))


# Names used for the driver binding.
DRIVER_FEATURES = ["queue_mean_10m", "station_id", "cycle_std_10m", "capacity_headroom", "queue_slope_10m",
                   "net_flow_rate_10m"]


def _prediction_base(spark, sf_dir) -> DataFrame:
    d = line_log(spark, sf_dir)
    names = F.array(*[F.lit(x) for x in DRIVER_FEATURES])

    def driver(offset: int):
        j = (F.col("k") + offset) % 6
        return F.struct(F.element_at(names, j + 1).alias("feature"),
                        F.when(j % 3 == 2, "decreases_risk").otherwise("increases_risk").alias("direction"),
                        ((j + 1) / 10.0).alias("contribution"))
    dark = F.col("station_index").between(3, 5)
    return d.select(
        "run_id", "production_day", "station_id", "station_index", "unit_id", "timestamp_ms",
        F.col("event_id").alias("emission"), F.least(F.lit(1.0), F.col("amount") / 200).alias("probability"),
        ((F.col("event_id") % 10 + 1) / 10.0).alias("state_confidence"),
        F.when(dark, "DARK").otherwise("LIGHT").alias("zone"),
        F.when(dark, "DARK_CORRIDOR").otherwise("LIGHT").alias("route"), "k",
        F.array(driver(0), driver(1), driver(2)).alias("drivers"))


def bottleneck_predictions(spark, sf_dir) -> DataFrame:
    """B2: one bottleneck prediction per source event."""
    p = _prediction_base(spark, sf_dir)
    return p.withColumn("risk_percent", F.col("probability") * 100).withColumn(
        "threshold", F.lit(0.25)).withColumn("warning", F.col("probability") >= 0.25)


def defect_predictions(spark, sf_dir) -> DataFrame:
    """B2: one defect prediction per source event up to the final station (index 10)."""
    p = _prediction_base(spark, sf_dir)
    crossed = F.col("probability") >= 0.5
    return (p.withColumn("risk_percent", F.col("probability") * 100).withColumn("threshold", F.lit(0.5))
            .withColumn("threshold_crossed", crossed)
            .withColumn("warning", crossed & (F.col("station_index") < FINAL_INDEX))
            .withColumn("final_station", F.lit("S11")))


def scored(spark, sf_dir) -> DataFrame:
    """B3: labelled scores from labels x documents."""
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return lab.join(doc, "doc_id").select(
        F.col("source").alias("run_id"), F.col("doc_id").cast("string").alias("unit_id"), "doc_id", "lang",
        (1 - F.col("quality")).alias("y"), ((F.col("n_chars") % 1000) / 1000).alias("score"),
        (F.col("n_chars") % 12).cast("int").alias("station_index"),
        F.lit(FINAL_INDEX).alias("final_index"), F.col("doc_id").alias("seq"))


def scored_series(spark, sf_dir) -> DataFrame:
    """B3 with (source, lang) as (run, unit), ordered by document id."""
    return scored(spark, sf_dir).withColumn("unit_id", F.col("lang"))
