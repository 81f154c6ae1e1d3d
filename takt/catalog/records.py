"""Registered scalar expressions, filters, sources, sinks, key joins, audits and set operations."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded
from takt.catalog.quality import ASSIGN, UNIT_CTES, _assigned, unit_features
from takt.catalog.sql import with_ctes
from takt.contracts import QUALITY_FEATURES, SIGNALS, TABLES
from takt.functions import scalar as sc
from takt.operators import aggregate as ag
from takt.operators import joins as jn
from takt.operators import select as sel
from takt.plans import unit_quality as uq
from takt.sources import bundles as bd
from takt.sources import bus as bs
from takt.sources import runs as rs
from takt.sources import sinks as sk

QUERIES, ORACLE, query = registry()


@query("station_index", with_ctes("line_log", """
SELECT event_id, station_index, round(station_index / 11.0::DOUBLE, 6) AS line_fraction FROM line_log"""))
def station_index(spark, d):
    return b.line_log(spark, d).select("event_id", sc.station_index("station_id").alias("station_index"),
                                       F.round(sc.line_fraction(sc.station_index("station_id"), F.lit(12)), 6).alias("line_fraction"))


@query("clean_number", with_ctes("line_log", """
SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE amount END AS number,
  CASE event_id % 3 WHEN 0 THEN NULL ELSE upper(unit_id) END AS text, event_id % 4 IN (0, 2) AS flag FROM line_log"""))
def clean_number(spark, d):
    i = F.col("event_id")
    raw = F.when(i % 5 == 0, "nan").when(i % 5 == 1, "Infinity").when(i % 5 == 2, "n/a").otherwise(F.col("amount").cast("string"))
    text = F.when(i % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("unit_id"), F.lit(" ")))
    flag = F.element_at(F.array(*[F.lit(x) for x in (" Yes", "no", "1", "")]), (i % 4 + 1).cast("int"))
    return b.line_log(spark, d).select(i, sc.clean_number(raw).alias("number"), sc.clean_text(text).alias("text"), sc.truthy(flag).alias("flag"))


@query("capacity_ratios", with_ctes("ev stations", """
SELECT e.run_id, e.event_sequence, buffer_capacity - q AS headroom, round(q / nullif(buffer_capacity, 0), 6) AS utilization,
  round(1 - q / nullif(buffer_capacity, 0), 6) AS utilization_headroom, q >= buffer_capacity AS at_capacity
FROM (SELECT *, queue_length_after AS q FROM ev) e JOIN stations s ON s.run_id = e.run_id AND s.station_id = e.station_id"""))
def capacity_ratios(spark, d):
    j = b.station_events(spark, d).join(b.stations(spark, d), ["run_id", "station_id"])
    q, c = F.col("queue_length_after"), F.col("buffer_capacity")
    return rounded(j.select("run_id", "event_sequence", sc.headroom(q, c).alias("headroom"), sc.utilization(q, c).alias("utilization"),
                            (1 - sc.utilization(q, c)).alias("utilization_headroom"), sc.at_capacity(q, c).alias("at_capacity")), default=6)


@query("state_expressions", with_ctes("line_log", """
SELECT event_id, round(CASE WHEN queue_length_after IS NOT NULL THEN 1.0 WHEN event_id % 11 = 0 THEN 0.0 ELSE exp(-k * 1000 / 600000.0::DOUBLE) END, 6) AS state_confidence,
  round(CASE WHEN queue_length_after IS NOT NULL THEN 0.0 WHEN event_id % 11 = 0 THEN NULL ELSE 0.7::DOUBLE * sqrt(k) END, 6) AS progress_std,
  round(CASE WHEN k > 50 THEN sqrt((amount / (k::DOUBLE * k)) ** 2 * 0.01::DOUBLE + (1.0::DOUBLE / k) ** 2 * 0.04::DOUBLE) END, 9) AS eta_std,
  round(CASE WHEN k > 50 AND amount / k <= 1 THEN sqrt((amount / (k::DOUBLE * k)) ** 2 * 0.01::DOUBLE + CASE WHEN event_id % 2 = 0 THEN (1.0::DOUBLE / k) ** 2 * 0.04::DOUBLE ELSE 0 END) END, 9) AS eta_std_dark
FROM line_log"""))
def state_expressions(spark, d):
    e = b.line_log(spark, d).withColumn("last", F.when(F.col("event_id") % 11 != 0, F.col("timestamp_ms") - F.col("k") * 1000)).withColumn(
        "slope", F.when(F.col("k") > 50, F.col("k") * 1.0).otherwise(-1.0))
    dark_occ = F.when(F.col("event_id") % 2 == 0, 0.2)
    return e.select("event_id", F.round(sc.state_confidence("queue_length_after", "timestamp_ms", "last"), 6).alias("state_confidence"),
                    F.round(sc.progress_std("queue_length_after", "last", F.lit(0.7), "k"), 6).alias("progress_std"),
                    F.round(sc.eta_std("amount", "slope", F.lit(0.1), F.lit(0.2)), 9).alias("eta_std"),
                    F.round(sc.eta_std_dark("amount", "slope", F.lit(0.1), dark_occ, 1), 9).alias("eta_std_dark"))


@query("risk_fields", with_ctes("bp dp", """
SELECT b.emission, round(100 * b.probability, 6) AS risk_percent, CASE WHEN b.route LIKE 'DARK%' THEN 'DARK' ELSE 'LIGHT' END AS zone, 25.0::DOUBLE AS threshold_percent,
  b.probability >= b.threshold AS warning, d.probability >= 0.5 AS crossed, d.probability >= 0.5 AND d.station_index < 10 AS defect_warning
FROM bp b JOIN dp d ON d.emission = b.emission"""))
def risk_fields(spark, d):
    p = b.bottleneck_predictions(spark, d)
    return p.select("emission", F.round(sc.risk_percent("probability"), 6).alias("risk_percent"), sc.zone_of_route("route").alias("zone"),
                    sc.risk_percent("threshold").alias("threshold_percent"), sc.crossed("probability", "threshold").alias("warning"),
                    sc.crossed("probability", F.lit(0.5)).alias("crossed"),
                    sc.early_warning("probability", F.lit(0.5), "station_index", F.lit(10)).alias("defect_warning"))


@query("probability_math", with_ctes("scored", """
SELECT doc_id, round(p, 9) AS clipped, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-score)), 6) AS sigmoid FROM (
  SELECT *, least(greatest(score, 0.001::DOUBLE), 0.999::DOUBLE) AS p FROM scored)"""))
def probability_math(spark, d):
    return b.scored(spark, d).select("doc_id", F.round(sc.clip_probability("score", 0.001), 9).alias("clipped"),
                                     F.round(sc.logit("score", 0.001), 6).alias("logit"), F.round(sc.sigmoid("score"), 6).alias("sigmoid"))


@query("band", with_ctes("scored", """
SELECT doc_id, CASE WHEN station_index * 3 <= 17 THEN 'early' WHEN station_index * 3 <= 23 THEN 'mid' ELSE 'late' END AS stage,
  CASE WHEN station_index <= 2 THEN 'load_0_2' WHEN station_index >= 11 THEN 'load_11_plus' ELSE 'load_' || station_index END AS load_band FROM scored"""))
def band(spark, d):
    return b.scored(spark, d).select("doc_id", sc.stage_band(F.col("station_index") * 3).alias("stage"), sc.load_band("station_index").alias("load_band"))


@query("text_expressions", with_ctes("line_log", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'peak_' || unit_id ELSE run_id END AS scenario, substr(sha256(run_id || unit_id), 1, 16) AS fingerprint,
  CAST(('0x' || substr(sha256(run_id || '|' || unit_id || '|' || CAST(timestamp_ms AS VARCHAR)), 1, 15)) AS BIGINT) AS seed,
  CASE WHEN timestamp_ms >= 3600000 THEN (timestamp_ms // 3600000) || ':' || lpad(CAST(timestamp_ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(timestamp_ms // 1000 % 60 AS VARCHAR), 2, '0')
    ELSE lpad(CAST(timestamp_ms // 60000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(timestamp_ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || (timestamp_ms // 100 % 10) END AS clock,
  CASE WHEN k = 0 THEN '0s' WHEN k * 1000 < 60000 THEN format('{:.1f}s', k::DOUBLE) ELSE (k // 60) || 'm ' || (k % 60) || 's' END AS duration FROM line_log"""))
def text_expressions(spark, d):
    e = b.line_log(spark, d)
    scen = F.when(F.col("event_id") % 2 == 0, F.concat(F.col("run_id"), F.lit("_peak_"), F.col("unit_id"))).otherwise(F.col("run_id"))
    return e.select("event_id", sc.scenario_name(scen).alias("scenario"), sc.fingerprint(F.concat("run_id", "unit_id")).alias("fingerprint"),
                    sc.stable_seed("run_id", "unit_id", "timestamp_ms").alias("seed"), sc.sim_clock("timestamp_ms").alias("clock"),
                    sc.duration_text(F.col("k") * 1000).alias("duration"))


@query("driver_array", with_ctes("bp", """
SELECT emission, array_to_string(list_slice(CASE WHEN len(r) > 0 THEN r ELSE u END, 1, 2), ', ') AS drivers FROM (
  SELECT emission, list_transform(list_filter(js, lambda j: j <> 1 AND j % 3 <> 2), lambda j: names[j + 1]) AS r, list_transform(list_filter(js, lambda j: j <> 1), lambda j: names[j + 1]) AS u FROM (
    SELECT emission, [k % 6, (k + 1) % 6, (k + 2) % 6] AS js, ['Queue mean 10m', '', 'Cycle std 10m', 'Capacity headroom', 'Queue slope 10m', 'Net flow rate 10m'] AS names FROM bp))"""))
def driver_array(spark, d):
    return b.bottleneck_predictions(spark, d).select("emission", F.array_join(sc.driver_names("drivers", 2), ", ").alias("drivers"))


@query("defect_driver_array", with_ctes("dp", """
SELECT emission, array_to_string(list_slice(list_filter([CASE k % 6 WHEN 1 THEN 'queue_mean_10m' WHEN 2 THEN NULL ELSE 'label ' || CAST(k % 6 AS VARCHAR) END,
  'net_flow_rate_10m', CASE WHEN k % 6 > 2 THEN 'third' END], lambda n: n IS NOT NULL), 1, 2), ', ') AS drivers FROM dp"""))
def defect_driver_array(spark, d):
    """A driver's label, else its feature name, else nothing; the first two that have a name."""
    j = F.col("k") % 6
    named = lambda label, feature: F.struct(label.cast("string").alias("label"), feature.cast("string").alias("feature"))
    drivers = F.array(named(F.when(j > 2, F.concat(F.lit("label "), j)).when(j == 0, "label 0").when(j == 1, ""), F.when(j == 1, "queue_mean_10m").when(j == 2, "")),
                      named(F.lit(None), F.lit("net_flow_rate_10m")), named(F.when(j > 2, "third"), F.lit("")))
    return b.defect_predictions(spark, d).select("emission", F.array_join(sc.defect_driver_names(drivers, 2), ", ").alias("drivers"))


FLAGS_SQL = "SELECT run_id, station_id, true AS is_dark, true AS sensor_visible, true AS manual_visible, true AS checkpoint_visible FROM stations WHERE is_dark"


def flags(spark, d):
    return jn.dark_flags(jn.expand_ranges(b.dark_zones(spark, d), b.stations(spark, d))[0])


@query("dark_membership_flags", with_ctes("stations", FLAGS_SQL))
def dark_membership_flags(spark, d):
    return flags(spark, d)


@query("expand_ranges", with_ctes("stations", "SELECT run_id, 'DZ01' AS dark_zone_id, station_id, station_index AS pos, 3 AS lo, 5 AS hi FROM stations WHERE is_dark"))
def expand_ranges(spark, d):
    return jn.expand_ranges(b.dark_zones(spark, d), b.stations(spark, d))[0].select("run_id", "dark_zone_id", "station_id", "pos", "lo", "hi")


@query("prediction_rows", with_ctes("ev", "SELECT run_id, unit_id, station_id, event_sequence FROM ev WHERE event_type = 'UNIT_ARRIVED' AND station_index <= 10"))
def prediction_rows(spark, d):
    return uq.prediction_rows(b.station_events(spark, d), uq.final_station(b.stations(spark, d))).select("run_id", "unit_id", "station_id", "event_sequence")


@query("final_station", with_ctes("runs", "SELECT run_id, 'S11' AS final_station, 10 AS final_station_index FROM runs"))
def final_station(spark, d):
    return uq.final_station(b.stations(spark, d))


def boundary_log(spark, d):
    """Station events where arrivals at the hidden zone's edges are boundary events."""
    edge = (F.col("event_type") == "UNIT_ARRIVED") & F.col("station_index").isin(3, 6)
    return b.station_events(spark, d).withColumn("event_type", F.when(edge & (F.col("station_index") == 3), "DARK_ZONE_ENTERED").when(
        edge, "DARK_ZONE_EXITED").otherwise(F.col("event_type")))


@query("drop_boundary_events", with_ctes("ev", "SELECT run_id, event_sequence, event_type FROM ev WHERE NOT (event_type = 'UNIT_ARRIVED' AND station_index IN (3, 6))"))
def drop_boundary_events(spark, d):
    return bs.drop_boundary_events(boundary_log(spark, d)).select("run_id", "event_sequence", "event_type")


@query("model_eligible", with_ctes("ev", "SELECT run_id, event_sequence, station_id FROM ev WHERE station_index > 0"))
def model_eligible(spark, d):
    return bs.model_eligible(b.station_events(spark, d), b.stations(spark, d)).select("run_id", "event_sequence", "station_id")


def runtime_bus(spark, d):
    """The line log as a tagged-union bus: every eighth check becomes a checkpoint read, a few rows are faulty."""
    e = b.line_log(spark, d)
    i = F.col("event_id")
    kind = (F.when((F.col("record_type") == "MANUAL") & (i % 8 == 0), "EVIDENCE").when(i % 997 == 0, "INSPECTION").when(i % 499 == 0, "MYSTERY")
            .otherwise(F.col("record_type")))
    ev = kind == "EVIDENCE"
    return e.select("run_id", (i + 1).alias("sequence"), "timestamp_ms", F.lower(kind).alias("record_type"), F.concat(F.lit("EV"), F.lpad(i.cast("string"), 6, "0")).alias("event_id"),
                    F.when(ev, "RFID_READ").otherwise(F.lower("event_type")).alias("event_type"), F.concat(F.lit(" "), F.col("station_id")).alias("station_id"),
                    F.when(i % 13 == 0, " ").otherwise(F.col("unit_id")).alias("unit_id"), "queue_length_after", F.lit("").alias("previous_state"), F.lit(None).cast("string").alias("new_state"),
                    "cycle_time_ms", F.lit("").alias("dark_zone_id"), F.when(ev, F.concat(F.lit("CP_"), F.col("station_id"))).alias("checkpoint_id"), F.lower("sensor_type").alias("sensor_type"),
                    F.when(i % 101 != 0, F.col("sensor_value")).alias("sensor_value"), F.lit("u").alias("sensor_unit"), F.when(F.col("record_type") == "MANUAL", "VISUAL").alias("check_type"),
                    F.when(ev, F.lit(None)).otherwise(F.lower("check_result")).alias("check_result"))


def checkpoint_defs(spark, d):
    i = F.col("station_index")
    return b.stations(spark, d).filter("station_index <> 11").select(
        "run_id", "station_id", F.concat(F.lit("CP_"), "station_id").alias("checkpoint_id"), F.when(i % 2 == 0, "RFID").otherwise("POWER_DRAW").alias("checkpoint_type"),
        ((i + 1) / 20.0).alias("nominal_progress_fraction"), F.lit(0.9).alias("read_reliability"), F.lit(0.05).alias("false_positive_rate"), (i % 2 == 0).alias("identifies_unit"))


BUS = {
    "rb": """
  SELECT *, CASE WHEN record_type = 'MANUAL' AND event_id % 8 = 0 THEN 'EVIDENCE' WHEN event_id % 997 = 0 THEN 'INSPECTION' WHEN event_id % 499 = 0 THEN 'MYSTERY' ELSE record_type END AS kind,
    CASE WHEN event_id % 13 <> 0 THEN unit_id END AS uid, CASE WHEN event_id % 101 <> 0 THEN sensor_value END AS sv, event_id + 1 AS sequence FROM line_log""",
    "parts": """
  SELECT run_id, sequence, kind, station_id, uid AS unit_id, CASE kind WHEN 'STATION' THEN queue_length_after WHEN 'SENSOR' THEN sv WHEN 'EVIDENCE' THEN (station_index + 1) / 20.0::DOUBLE END AS x FROM rb
  WHERE kind = 'STATION' OR (kind = 'SENSOR' AND sv IS NOT NULL) OR (kind = 'MANUAL' AND uid IS NOT NULL) OR (kind = 'EVIDENCE' AND station_index <> 11)""",
}


@query("split_bus", with_ctes("line_log", "SELECT run_id, sequence, kind, station_id, CASE WHEN kind <> 'SENSOR' THEN unit_id END AS unit_id, x FROM parts", **BUS))
def split_bus(spark, d):
    t = bs.split_bus(runtime_bus(spark, d), checkpoint_defs(spark, d))
    value = {"STATION": F.col("queue_length_after"), "SENSOR": F.col("value"), "MANUAL": F.lit(None).cast("double"), "EVIDENCE": F.col("checkpoint_progress")}
    return sel.concat_runs([t[k].select("run_id", F.col("event_sequence").alias("sequence"), F.lit(k).alias("kind"), "station_id",
                                        (F.col("unit_id") if k != "SENSOR" else F.lit(None).cast("string")).alias("unit_id"), v.alias("x")) for k, v in value.items()])


@query("split_bus_violations", with_ctes("line_log", """
SELECT CASE WHEN kind = 'INSPECTION' THEN 'inspection_on_bus' WHEN kind = 'MYSTERY' THEN 'unknown_record_type' WHEN kind = 'SENSOR' THEN 'malformed_sensor'
  WHEN kind = 'MANUAL' THEN 'malformed_manual' ELSE 'unknown_checkpoint' END AS rule, run_id, CAST(sequence AS VARCHAR) AS key, station_id AS detail
FROM rb WHERE sequence NOT IN (SELECT sequence FROM parts)""", **BUS))
def split_bus_violations(spark, d):
    return bs.split_bus(runtime_bus(spark, d), checkpoint_defs(spark, d))["violations"].withColumn("detail", F.trim("detail"))


@query("merge_streams", with_ctes("line_log", """
SELECT run_id, event_sequence, stream, CAST(priority AS INTEGER) AS priority, row_number() OVER (PARTITION BY run_id ORDER BY timestamp_ms, priority, event_sequence) AS position FROM (
  SELECT *, CASE record_type WHEN 'SENSOR' THEN 'sensor_reading' WHEN 'MANUAL' THEN CASE WHEN event_id % 8 = 0 THEN 'evidence' ELSE 'manual_check' END ELSE 'station_event' END AS stream,
    CASE WHEN record_type = 'SENSOR' THEN 20 WHEN record_type = 'MANUAL' THEN CASE WHEN event_id % 8 = 0 THEN 1 ELSE 30 END
      WHEN event_type = 'PROCESSING_COMPLETED' AND station_id = 'S03' THEN -1 WHEN event_type = 'PROCESSING_STARTED' THEN 0 WHEN event_type = 'PROCESSING_COMPLETED' THEN 2 ELSE 1 END AS priority FROM line_log)"""))
def merge_streams(spark, d):
    from takt.operators.slices import numbered
    m = b.manual_checks(spark, d)
    up = b.runs(spark, d).select("run_id", F.lit("S03").alias("station_id"))
    t = bs.merge_streams(b.station_events(spark, d), b.sensor_readings(spark, d), m.filter("event_sequence % 8 <> 0"), m.filter("event_sequence % 8 = 0"), up)
    n = numbered(t, ["run_id"], ["timestamp_ms", "priority", "event_sequence"], 600_000, name="position")
    return n.select("run_id", "event_sequence", "stream", "priority", "position")


@query("public_view", with_ctes("line_log", """
SELECT run_id, sequence, CASE WHEN kind = 'EVIDENCE' AND station_index % 2 = 1 THEN NULL ELSE uid END AS unit_id FROM rb
WHERE kind IN ('STATION', 'SENSOR', 'MANUAL', 'EVIDENCE') AND (station_index NOT BETWEEN 3 AND 5 OR kind <> 'STATION') AND NOT (kind = 'EVIDENCE' AND station_index = 11)""", **BUS))
def public_view(spark, d):
    t = runtime_bus(spark, d).withColumn("record_type", F.upper("record_type")).withColumn("station_id", F.trim("station_id")).withColumn(
        "unit_id", F.nullif(F.trim("unit_id"), F.lit(""))).filter("record_type IN ('STATION', 'SENSOR', 'MANUAL', 'EVIDENCE') AND NOT (record_type = 'EVIDENCE' AND station_id = 'S12')")
    return bs.public_view(t, flags(spark, d), checkpoint_defs(spark, d)).select("run_id", "sequence", "unit_id")


def _csv_runs(spark, d):
    """The station events written as CSV run folders, for the readers to find."""
    root = rs.shared_folder(spark)
    e = b.station_events(spark, d).select("run_id", F.concat(F.lit("EV"), F.lpad("event_sequence", 9, "0")).alias("event_id"), "timestamp_ms", "event_type", "station_id", "unit_id",
                                          "queue_length_after", F.lit(None).cast("string").alias("previous_state"), F.lit(None).cast("string").alias("new_state"), "cycle_time_ms",
                                          F.lit(None).cast("string").alias("dark_zone_id"))
    e.write.partitionBy("run_id").option("header", True).mode("errorifexists").csv(f"{root}/station_events")
    return root


@query("read_run_table", with_ctes("ev", "SELECT run_id, timestamp_ms, event_sequence, event_type, station_id, unit_id, queue_length_after, cycle_time_ms FROM ev"))
def read_run_table(spark, d):
    t = rs.read_run_table(spark, _csv_runs(spark, d), "station_events", "station_events/run_id=*/*.csv")
    return rs.with_event_sequence(t).select("run_id", "timestamp_ms", "event_sequence", "event_type", "station_id", "unit_id", "queue_length_after", "cycle_time_ms")


@query("read_run_bundles", with_ctes("ev", "SELECT run_id, timestamp_ms, event_sequence, event_type, station_id, unit_id, queue_length_after, cycle_time_ms FROM ev"))
def read_run_bundles(spark, d):
    """Every run's events written as a zip and all zips read back, entry by entry."""
    e = b.station_events(spark, d)
    names = [c for c in TABLES["station_events"].names if c not in e.columns and c != "event_id"]
    rows = e.withColumn("event_id", F.concat(F.lit("EVT-"), "event_sequence")).withColumns({c: F.lit(None).cast(TABLES["station_events"][c].dataType) for c in names})
    folder = rs.shared_folder(spark)
    bd.write_run_bundles(rows, folder, "station_events", ["event_sequence"])
    back = bd.read_run_bundles(spark, f"{folder}/*.zip", "station_events")
    return rs.with_event_sequence(back).select("run_id", "timestamp_ms", "event_sequence", "event_type", "station_id", "unit_id", "queue_length_after", "cycle_time_ms")


@query("discover_runs", with_ctes("runs", "SELECT run_id, 7 AS n_missing, false AS complete FROM runs"))
def discover_runs(spark, d):
    root = _csv_runs(spark, d)
    return rs.discover_runs(spark, f"{root}/station_events", glob="run_id=*").select("run_id", F.size("missing").alias("n_missing"), "complete")


@query("read_features", with_ctes("ev", "SELECT run_id, count(*) AS n, sum(coalesce(queue_length_after, 0)) AS total_queue FROM ev GROUP BY run_id"))
def read_features(spark, d):
    path = rs.shared_folder(spark) + "/features"
    sk.write_features(b.station_events(spark, d), path)
    return rs.read_features(spark, path).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("queue_length_after", F.lit(0.0))).alias("total_queue"))


def _contract_preds(spark, d):
    p = b.bottleneck_predictions(spark, d)
    return p.select("run_id", "timestamp_ms", "station_id", F.col("unit_id").alias("vehicle_id"), "zone", "route", F.col("probability").alias("bottleneck_probability"),
                    F.col("risk_percent").alias("bottleneck_risk_percent"), "warning", F.col("threshold").alias("decision_threshold"), "state_confidence", F.col("emission").alias("event_sequence"))


@query("write_predictions", with_ctes("bp", "SELECT run_id, count(*) AS records, count(*) FILTER (warning) AS warnings, round(sum(probability), 5) AS total_p FROM bp GROUP BY run_id"))
def write_predictions(spark, d):
    path = rs.shared_folder(spark) + "/bottleneck"
    sk.write_predictions(_contract_preds(spark, d), path, "bottleneck")
    return rounded(rs.read_prediction_stream(spark, path, "bottleneck").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if("warning").alias("warnings"), F.sum("bottleneck_probability").alias("total_p")))


@query("write_predictions_csv", with_ctes("bp", "SELECT run_id, count(*) AS records, count(*) FILTER (warning) AS warnings, round(sum(probability), 5) AS total_p FROM bp GROUP BY run_id"))
def write_predictions_csv(spark, d):
    """The flat form: a CSV, read back by name."""
    path = rs.shared_folder(spark) + "/flat"
    sk.write_predictions(_contract_preds(spark, d), path, "bottleneck", "csv")
    back = spark.read.option("header", True).csv(path)
    return rounded(back.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("warning") == "true").alias("warnings"), F.sum(F.col("bottleneck_probability").cast("double")).alias("total_p")))


@query("read_prediction_stream", with_ctes("bp", "SELECT count(*) FILTER (emission % 50 <> 0) AS records, count(*) FILTER (emission % 50 = 0) AS malformed_lines FROM bp"))
def read_prediction_stream(spark, d):
    path = rs.shared_folder(spark) + "/lines"
    rows = sk.contract_rows(_contract_preds(spark, d), "bottleneck")
    line = F.when(F.col("event_sequence") % 50 == 0, '{"run_id": "torn').otherwise(F.to_json(F.struct(*[F.col(c) for c in rows.columns])))
    rows.select(line.alias("value")).write.text(path)
    return rs.stream_health(rs.read_prediction_stream(spark, path, "bottleneck"))


@query("upsert_run_history", with_ctes("runs", """
SELECT run_id, CASE WHEN production_day <= 20 THEN CAST(production_day AS BIGINT) ELSE CAST(20 + row_number() OVER (PARTITION BY production_day > 20 ORDER BY production_day) AS BIGINT) END AS production_day,
  CASE WHEN production_day >= 15 THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, CASE WHEN production_day >= 15 THEN 200 + production_day ELSE 100 + production_day END AS updated_at,
  CASE WHEN production_day <= 20 THEN 100 + production_day ELSE 200 + production_day END AS created_at FROM runs"""))
def upsert_run_history(spark, d):
    r = b.runs(spark, d)
    old = r.filter("production_day <= 20").select("run_id", F.col("production_day").cast("long").alias("production_day"), F.lit("COMPLETED").alias("status"),
                                                  (100 + F.col("production_day")).alias("updated_at"), (100 + F.col("production_day")).alias("created_at"))
    new = r.filter("production_day >= 15").select("run_id", F.lit(None).cast("long").alias("production_day"), F.lit("PARTIAL").alias("status"),
                                                  (200 + F.col("production_day")).alias("updated_at"), (200 + F.col("production_day")).alias("created_at"))
    return sk.upsert_run_history(old, new)


@query("dimension_join", with_ctes("ev units", """
SELECT e.run_id, e.event_sequence, u.vehicle_model, u.run_id IS NULL AS dimension_missing FROM ev e LEFT JOIN (SELECT * FROM units WHERE unit_id <> 'U000003') u ON u.run_id = e.run_id AND u.unit_id = e.unit_id"""))
def dimension_join(spark, d):
    u = b.units(spark, d).filter("unit_id <> 'U000003'")
    return jn.dimension_join(b.station_events(spark, d), u, ["run_id", "unit_id"]).select("run_id", "event_sequence", "vehicle_model", "dimension_missing")


@query("keep_units", with_ctes("ev", "SELECT run_id, event_sequence FROM ev WHERE unit_id <> 'U000003'"))
def keep_units(spark, d):
    return jn.keep_units(b.station_events(spark, d), b.units(spark, d).filter("unit_id <> 'U000003'")).select("run_id", "event_sequence")


@query("drop_orphans", with_ctes("ev", "SELECT run_id, event_sequence FROM ev WHERE unit_id = 'U000003'"))
def drop_orphans(spark, d):
    return jn.orphans(b.station_events(spark, d), b.units(spark, d).filter("unit_id <> 'U000003'"), ["run_id", "unit_id"]).select("run_id", "event_sequence")


_TWO = {"a": "SELECT run_id, station_id, event_sequence, queue_length_after AS q, cycle_time_ms AS c FROM ev WHERE event_sequence % 10 <> 0",
        "z": "SELECT run_id, station_id, event_sequence, CASE WHEN event_sequence % 6 = 0 THEN queue_length_after + 1 ELSE queue_length_after END AS q, CASE WHEN event_sequence % 9 = 0 THEN NULL ELSE cycle_time_ms END AS c FROM ev WHERE event_sequence % 15 <> 0"}


def _two(spark, d):
    e = b.station_events(spark, d)
    i = F.col("event_sequence")
    a = e.filter(i % 10 != 0).select("run_id", "station_id", "event_sequence", F.col("queue_length_after").alias("q"), F.col("cycle_time_ms").alias("c"))
    z = e.filter(i % 15 != 0).select("run_id", "station_id", "event_sequence", F.when(i % 6 == 0, F.col("queue_length_after") + 1).otherwise(F.col("queue_length_after")).alias("q"),
                                     F.when(i % 9 != 0, F.col("cycle_time_ms")).alias("c"))
    return a, z


@query("parity_diff", with_ctes("ev", """
, j AS (SELECT a.run_id AS ra, z.run_id AS rz, a.q AS aq, z.q AS zq, a.c AS ac, z.c AS zc FROM a FULL JOIN z ON a.run_id = z.run_id AND a.event_sequence = z.event_sequence)
SELECT count(*) FILTER (ra IS NOT NULL AND rz IS NOT NULL) AS n_both, count(*) FILTER (rz IS NULL) AS left_only, count(*) FILTER (ra IS NULL) AS right_only, f AS feature,
  count(*) FILTER (ra IS NOT NULL AND rz IS NOT NULL AND CASE WHEN f = 'q' THEN aq IS DISTINCT FROM zq ELSE ac IS DISTINCT FROM zc END) AS mismatches,
  max(CASE WHEN f = 'q' THEN abs(aq - zq) ELSE abs(ac - zc) END) FILTER (ra IS NOT NULL AND rz IS NOT NULL) AS max_abs_diff FROM j, (SELECT unnest(['q', 'c']) AS f) GROUP BY f""", **_TWO))
def parity_diff(spark, d):
    a, z = _two(spark, d)
    return jn.parity_diff(a, z, ["run_id", "event_sequence"], ["q", "c"])


@query("oracle_compare", with_ctes("ev", """
, j AS (SELECT f AS feature, CASE WHEN f = 'q' THEN a.q ELSE a.c END AS p, CASE WHEN f = 'q' THEN z.q ELSE z.c END AS t FROM a JOIN z ON a.run_id = z.run_id AND a.event_sequence = z.event_sequence, (SELECT unnest(['q', 'c']) AS f)),
k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY p) + (count(*) OVER (PARTITION BY feature, p) - 1) / 2.0::DOUBLE AS rp,
  rank() OVER (PARTITION BY feature ORDER BY t) + (count(*) OVER (PARTITION BY feature, t) - 1) / 2.0::DOUBLE AS rt FROM j WHERE p IS NOT NULL AND t IS NOT NULL)
SELECT feature, count(*) AS n, round(avg(abs(p - t)), 6) AS mae, round(sqrt(avg((p - t) ** 2)), 6) AS rmse, round(avg(p - t), 6) AS bias, round(corr(rp, rt), 6) AS spearman FROM k GROUP BY feature""", **_TWO))
def oracle_compare(spark, d):
    a, z = _two(spark, d)
    return rounded(jn.oracle_compare(a, z, ["run_id", "event_sequence"], ["q", "c"]), default=6)


def _reads(spark, d):
    return b.manual_checks(spark, d).withColumn("checkpoint_id", F.concat(F.lit("CP_"), F.col("station_id"))).withColumn(
        "unit_id", F.when(F.col("event_sequence") % 3 != 0, F.col("unit_id")))


@query("checkpoint_window_check", with_ctes("ev ma se", """
SELECT m.run_id, m.event_sequence FROM ma m WHERE event_sequence % 3 <> 0 AND (
  EXISTS (SELECT 1 FROM intervals i WHERE i.run_id = m.run_id AND i.unit_id = m.unit_id AND i.station_id = m.station_id AND m.timestamp_ms BETWEEN processing_start AND processing_end)
  OR NOT EXISTS (SELECT 1 FROM intervals i WHERE i.run_id = m.run_id AND i.unit_id = m.unit_id AND i.station_id = m.station_id))""", **ASSIGN))
def checkpoint_window_check(spark, d):
    iv, _ = jn.pair_fifo(b.station_events(spark, d))
    return jn.checkpoint_window_check(_reads(spark, d).filter("unit_id IS NOT NULL"), iv).select("run_id", "event_sequence")


@query("checkpoint_progress", with_ctes("ma", """
SELECT run_id, event_sequence, (station_index + 1) / 20.0::DOUBLE AS nominal_progress_fraction FROM ma WHERE station_index <> 11 AND (event_sequence % 3 <> 0 OR station_index % 2 = 1)"""))
def checkpoint_progress(spark, d):
    return jn.checkpoint_progress(_reads(spark, d), checkpoint_defs(spark, d)).select("run_id", "event_sequence", "nominal_progress_fraction")


@query("unrecorded_runs", with_ctes("runs", "SELECT run_id FROM runs WHERE production_day % 4 <> 0 AND production_day > 10"))
def unrecorded_runs(spark, d):
    r = b.runs(spark, d)
    return jn.unrecorded_runs(r.withColumn("complete", F.col("production_day") % 4 != 0), r.filter("production_day <= 10")).select("run_id")


@query("artifact_match", with_ctes("runs", """
SELECT run_id, CASE WHEN production_day % 3 = 0 THEN 'out/m' || production_day WHEN production_day % 3 = 1 THEN 'out/b' || production_day % 7 WHEN production_day % 2 = 0 THEN 'out/r' || production_day END AS predictions_dir,
  CASE WHEN production_day % 3 = 0 THEN 'manifest' WHEN production_day % 3 = 1 THEN 'batch_name' WHEN production_day % 2 = 0 THEN 'run_name' ELSE 'none' END AS matched_by FROM runs"""))
def artifact_match(spark, d):
    p = F.col("production_day")
    r = b.runs(spark, d).select("run_id", p, F.concat(F.lit("runs/"), F.col("run_id")).alias("run_dir"), F.when(p % 3 == 1, F.concat(F.lit("batch"), (p % 7).cast("string"))).alias("batch_name"))
    t = lambda cond, run_dir, batch, run, out: r.filter(cond).select(run_dir.alias("run_dir"), batch.alias("batch_name"), run.alias("run_id"),
                                                                     F.concat(F.lit("out/"), out).alias("predictions_dir"), p.alias("generated_at"))
    none = F.lit(None).cast("string")
    m = sel.concat_runs([t(p % 3 == 0, F.col("run_dir"), none, none, F.concat(F.lit("m"), p)), t(p % 3 == 1, none, F.col("batch_name"), none, F.concat(F.lit("b"), p % 7)),
                         t(p % 2 == 0, none, none, F.col("run_id"), F.concat(F.lit("r"), p))])
    return jn.artifact_match(r, m).select("run_id", "predictions_dir", "matched_by")


@query("bus_summary", with_ctes("line_log", """
SELECT run_id, count(*) AS records, arg_min(timestamp_ms, sequence) AS first_timestamp_ms, arg_max(timestamp_ms, sequence) AS last_timestamp_ms, count(*) FILTER (kind = 'STATION') AS n_station,
  count(*) FILTER (kind = 'SENSOR') AS n_sensor, count(*) FILTER (kind = 'MANUAL') AS n_manual, count(*) FILTER (kind = 'EVIDENCE') AS n_evidence FROM rb GROUP BY run_id""", **BUS))
def bus_summary(spark, d):
    return ag.bus_summary(runtime_bus(spark, d))


@query("defect_rate", with_ctes("ins runs", """
SELECT split, run_id, count(*) AS total_units, count(*) FILTER (result = 'PASS') AS pass_units, count(*) FILTER (result = 'FAIL') AS defective_units, round(count(*) FILTER (result = 'FAIL') / count(*)::DOUBLE, 6) AS actual_defect_rate
FROM (SELECT i.run_id, unit_id, arg_max(result, timestamp_ms * 10000000 + event_sequence) AS result, CASE WHEN r.production_day % 5 = 0 THEN 'validation' ELSE 'train' END AS split
  FROM ins i JOIN runs r ON r.run_id = i.run_id GROUP BY ALL) GROUP BY ROLLUP (split, run_id)"""))
def defect_rate(spark, d):
    split = b.runs(spark, d).select("run_id", F.when(F.col("production_day") % 5 == 0, "validation").otherwise("train").alias("split"))
    return rounded(ag.defect_rate(b.inspections(spark, d), uq.final_station(b.stations(spark, d)), split), default=6)


@query("feature_quality", with_ctes("ev", """
SELECT f AS feature, f <> 'ghost' AS present, CASE f WHEN 'queue_length_after' THEN round(avg(CASE WHEN queue_length_after IS NULL THEN 1 ELSE 0 END), 6) WHEN 'cycle_time_ms' THEN round(avg(CASE WHEN cycle_time_ms IS NULL THEN 1 ELSE 0 END), 6) END AS null_rate,
  CASE WHEN f <> 'ghost' THEN CAST(0 AS BIGINT) END AS infinite_count FROM ev, (SELECT unnest(['queue_length_after', 'cycle_time_ms', 'ghost']) AS f) GROUP BY f"""))
def feature_quality(spark, d):
    return rounded(ag.feature_quality(b.station_events(spark, d), ["queue_length_after", "cycle_time_ms", "ghost"]), default=6)


@query("contract_audit", with_ctes("se ev stations", """
SELECT s.run_id, count(DISTINCT s.station_id) AS station_count, (SELECT string_agg(DISTINCT event_type, ',' ORDER BY event_type) FROM ev WHERE ev.run_id = s.run_id) AS event_types,
  (SELECT string_agg(DISTINCT sensor_type, ',' ORDER BY sensor_type) FROM se WHERE se.run_id = s.run_id) AS signals, (SELECT count(*) FROM se WHERE se.run_id = s.run_id AND sensor_type = 'TORQUE') AS torque_rows,
  (SELECT count(DISTINCT station_id) FROM se WHERE se.run_id = s.run_id AND sensor_type = 'TORQUE') AS torque_stations, (SELECT min(timestamp_ms) FROM se WHERE se.run_id = s.run_id AND sensor_type = 'TORQUE') AS torque_first_ms,
  (SELECT max(timestamp_ms) FROM se WHERE se.run_id = s.run_id AND sensor_type = 'TORQUE') AS torque_last_ms, CAST(0 AS BIGINT) AS torque_invalid,
  (SELECT coalesce(string_agg(v.x, ',' ORDER BY v.pos), '') FROM (VALUES (1, 'TORQUE'), (2, 'VIBRATION'), (3, 'TEMPERATURE'), (4, 'CURRENT')) v(pos, x)
    WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.run_id = s.run_id AND se.sensor_type = v.x)) AS missing_signals,
  (SELECT count(*) FROM se WHERE se.run_id = s.run_id AND sensor_type = 'TORQUE') > 0 AS torque_usable FROM stations s GROUP BY s.run_id"""))
def contract_audit(spark, d):
    a = ag.contract_audit(b.stations(spark, d), b.station_events(spark, d), b.sensor_readings(spark, d))
    return a.select(*[F.array_join(c, ",").alias(c) if t.startswith("array") else F.col(c) for c, t in a.dtypes])


@query("event_type_counts", with_ctes("ev", """
SELECT event_type, count(*) AS n, CASE event_type WHEN 'UNIT_ARRIVED' THEN 'mapped' WHEN 'PROCESSING_STARTED' THEN 'ignored' ELSE 'unrecognized' END AS status FROM ev GROUP BY event_type"""))
def event_type_counts(spark, d):
    m = spark.createDataFrame([("UNIT_ARRIVED", "STATION_ENTRY"), ("PROCESSING_STARTED", None)], "event_type string, target string")
    return ag.event_type_counts(b.station_events(spark, d), m)


@query("concat_runs", with_ctes("ev", "SELECT run_id, count(*) AS n FROM ev GROUP BY run_id"))
def concat_runs(spark, d):
    e = b.station_events(spark, d)
    return sel.concat_runs([e.filter(F.col("event_type") == t) for t in ("UNIT_ARRIVED", "PROCESSING_STARTED", "PROCESSING_COMPLETED")]).groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@query("split_overlap", with_ctes("runs", "SELECT run_id FROM runs WHERE production_day BETWEEN 10 AND 12"))
def split_overlap(spark, d):
    r = b.runs(spark, d)
    return sel.split_overlap(r.filter("production_day <= 12"), r.filter("production_day >= 10"))


@query("missing_levels", with_ctes("units", "SELECT DISTINCT vehicle_model FROM units WHERE vehicle_model <> 'MODEL_A'"))
def missing_levels(spark, d):
    return sel.missing_levels(b.units(spark, d), "vehicle_model", ["MODEL_A"])


@query("missing_columns", with_ctes("runs", "SELECT DISTINCT unnest(['dark_zone_id', 'new_state']) AS column_name FROM runs"))
def missing_columns(spark, d):
    """What the log's station events lack of the contract's columns that a builder asks for."""
    return sel.missing_columns(b.station_events(spark, d), ["station_id", "dark_zone_id", "cycle_time_ms", "new_state"])


@query("dedupe_station_time", with_ctes("bp", """
SELECT run_id, station_id, timestamp_ms, emission, round(probability, 6) AS probability FROM (SELECT * REPLACE (timestamp_ms // 60000 * 60000 AS timestamp_ms) FROM bp)
QUALIFY row_number() OVER (PARTITION BY run_id, station_id, timestamp_ms ORDER BY emission DESC) = 1"""))
def dedupe_station_time(spark, d):
    p = b.bottleneck_predictions(spark, d).withColumn("timestamp_ms", F.col("timestamp_ms") - F.col("timestamp_ms") % 60000)
    return rounded(sel.dedupe_station_time(p.select("run_id", "station_id", "timestamp_ms", "emission", "probability")), default=6)


def _seen(signal: str, past: str) -> str:
    have = [c for c in (f"{signal.lower()}_{stat}_{past}" for stat in ("mean", "max")) if c in QUALITY_FEATURES]
    return f"round(avg(CASE WHEN coalesce({', '.join(have)}, NULL) IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6)"


@query("signal_coverage", with_ctes("ev se ma units", " UNION ALL ".join(
    f"SELECT run_id, '{s}' AS signal, {_seen(s, 'history')} AS history_coverage, {_seen(s, 'recent')} AS recent_coverage FROM f GROUP BY run_id" for s in SIGNALS), **UNIT_CTES))
def signal_coverage(spark, d):
    return rounded(ag.signal_coverage(unit_features(spark, d)), default=6)


# Source table and window of each quality feature.
PROVENANCE = [
    ("torque_delta_recent_vs_history", "sensor_readings", "10 minutes"),
    ("manual_fail_count_cum", "manual_checks", "all past"),
    ("prediction_station_index", "stations", "all past"),
    ("torque_mean_history", "sensor_readings", "all past"),
    ("line_fraction", "stations", "all past"),
    ("last_manual_fail", "manual_checks", "all past"),
    ("manual_check_count_cum", "manual_checks", "all past"),
    ("torque_mean_recent", "sensor_readings", "10 minutes"),
    ("queue_history_mean", "station_events", "all past"),
    ("current_mean_recent", "sensor_readings", "10 minutes"),
    ("current_missing_recent", "sensor_readings", "10 minutes"),
    ("vibration_delta_recent_vs_history", "sensor_readings", "10 minutes"),
    ("current_mean_history", "sensor_readings", "all past"),
    ("torque_max_recent", "sensor_readings", "10 minutes"),
    ("temperature_mean_history", "sensor_readings", "all past"),
    ("torque_max_history", "sensor_readings", "all past"),
    ("supplier_batch", "units", "all past"),
    ("current_max_history", "sensor_readings", "all past"),
    ("cycle_history_max", "station_events", "all past"),
    ("temperature_max_recent", "sensor_readings", "10 minutes"),
    ("vibration_mean_history", "sensor_readings", "all past"),
    ("temperature_max_history", "sensor_readings", "all past"),
    ("stations_since_last_manual_fail", "manual_checks", "all past"),
    ("vehicle_model", "units", "all past"),
    ("vibration_max_history", "sensor_readings", "all past"),
    ("vibration_max_recent", "sensor_readings", "10 minutes"),
    ("temperature_mean_recent", "sensor_readings", "10 minutes"),
    ("torque_std_history", "sensor_readings", "all past"),
    ("queue_history_std", "station_events", "all past"),
    ("cycle_history_std", "station_events", "all past"),
]


@query("feature_provenance", with_ctes("ev se ma units", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{source}' AS source, '{window}' AS \"window\", true AS present, round(avg(CASE WHEN {f} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_rate FROM f"
    for f, source, window in PROVENANCE), **UNIT_CTES))
def feature_provenance(spark, d):
    """Definition rows joined to the observed share of filled values."""
    p = spark.createDataFrame(PROVENANCE, "feature string, source string, window string")
    return rounded(p.join(ag.feature_quality(unit_features(spark, d), QUALITY_FEATURES).select("feature", "present", "null_rate"), "feature", "left"), default=6)


@query("assigned_share", with_ctes("ev se", """
SELECT r.run_id, count(*) AS readings, count(a.event_sequence) AS assigned FROM se r LEFT JOIN assigned a ON a.event_sequence = r.event_sequence GROUP BY r.run_id""", **ASSIGN))
def assigned_share(spark, d):
    r = b.sensor_readings(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("readings"))
    a = _assigned(spark, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("assigned"))
    return r.join(a, "run_id", "left").select("run_id", "readings", F.coalesce("assigned", F.lit(0)).alias("assigned"))
