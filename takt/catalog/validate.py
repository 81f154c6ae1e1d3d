"""Registered validation rules, each run over data with planted faults."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry
from takt.catalog.flow import _FEATURES, _STATS_CTES
from takt.catalog.quality import ASSIGN, UNIT_CTES, _assigned, unit_features
from takt.catalog.records import BUS, checkpoint_defs, flags, runtime_bus
from takt.catalog.sql import with_ctes
from takt.operators import validate as va
from takt.plans import station_flow as sf

QUERIES, ORACLE, query = registry()


@query("sequence_gaps", with_ctes("line_log", """
, s AS (SELECT run_id, seq AS sequence, t, lag(seq) OVER w AS p, lag(t) OVER w AS pt FROM (
  SELECT run_id, event_id + 1 AS seq, CASE WHEN event_id % 700 = 0 THEN timestamp_ms - 60000 ELSE timestamp_ms END AS t FROM line_log WHERE event_id % 500 <> 499)
  WINDOW w AS (PARTITION BY run_id ORDER BY seq))
SELECT 'sequence_gap' AS rule, run_id, CAST(sequence AS VARCHAR) AS key, coalesce(p, 0) || '|' || sequence AS detail FROM s WHERE sequence <> coalesce(p, 0) + 1
UNION ALL SELECT 'time_backward', run_id, CAST(sequence AS VARCHAR), coalesce(p, 0) || '|' || sequence FROM s WHERE t < pt"""))
def sequence_gaps(spark, d):
    bus = b.line_log(spark, d).filter("event_id % 500 <> 499").select("run_id", (F.col("event_id") + 1).alias("sequence"), F.when(
        F.col("event_id") % 700 == 0, F.col("timestamp_ms") - 60000).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"))
    return va.sequence_gaps(bus)


@query("unknown_keys", with_ctes("ev", "SELECT 'unknown_unit_id' AS rule, run_id, unit_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM ev WHERE unit_id = 'U000003' GROUP BY ALL"))
def unknown_keys(spark, d):
    return va.unknown_keys(b.station_events(spark, d), b.units(spark, d).filter("unit_id <> 'U000003'"), "unit_id")


@query("duplicate_keys", with_ctes("ev", """
SELECT 'duplicate_unit_id' AS rule, run_id, unit_id AS key, CAST(count(*) AS VARCHAR) AS detail FROM (SELECT DISTINCT run_id, unit_id, station_id FROM ev) GROUP BY ALL HAVING count(*) > 1"""))
def duplicate_keys(spark, d):
    return va.duplicate_keys(b.station_events(spark, d).select("run_id", "unit_id", "station_id").distinct(), "unit_id")


@query("prediction_contract", with_ctes("bp", """
, f AS (SELECT * REPLACE (CASE WHEN emission % 40 = 6 THEN timestamp_ms + 10000000 ELSE timestamp_ms END AS timestamp_ms), emission % 40 AS m FROM bp),
w AS (SELECT run_id, min(timestamp_ms) AS w0, max(timestamp_ms) AS w1 FROM line_log GROUP BY run_id)
SELECT rule, f.run_id, CAST(emission AS VARCHAR) AS key, station_id || '|' || unit_id AS detail FROM f JOIN w ON w.run_id = f.run_id, LATERAL (SELECT unnest(list_filter([
  CASE WHEN station_id = 'S12' THEN 'unknown_station' END, CASE WHEN unit_id = 'U000003' THEN 'unknown_unit' END, CASE WHEN timestamp_ms < w0 OR timestamp_ms > w1 THEN 'time_outside_run' END,
  CASE WHEN m = 1 THEN 'bad_probability' END, CASE WHEN m = 1 OR m = 2 THEN 'risk_mismatch' END, CASE WHEN m = 3 OR (m = 1 AND NOT warning) THEN 'warning_mismatch' END,
  CASE WHEN m = 4 THEN 'missing_explanation' END, CASE WHEN m = 5 THEN 'bad_additivity' END], lambda x: x IS NOT NULL)) AS rule) r"""))
def prediction_contract(spark, d):
    m = F.col("emission") % 40
    p = b.bottleneck_predictions(spark, d).withColumn("probability", F.when(m == 1, F.col("probability") + 2).otherwise(F.col("probability"))).withColumn(
        "risk_percent", F.when(m == 2, F.col("risk_percent") + 1).otherwise(F.col("risk_percent"))).withColumn(
        "warning", F.when(m == 3, ~F.col("warning")).otherwise(F.col("warning"))).withColumn("additivity_error", F.when(m == 5, 0.1).otherwise(0.0)).withColumn(
        "drivers", F.when(m != 4, F.col("drivers"))).withColumn("timestamp_ms", F.col("timestamp_ms") + F.when(m == 6, 10_000_000).otherwise(0))
    return va.prediction_contract(p, b.stations(spark, d).filter("station_index < 11"), b.units(spark, d).filter("unit_id <> 'U000003'"),
                                  b.line_log(spark, d), "bottleneck")


@query("prediction_contract_defect", with_ctes("dp", """
SELECT rule, run_id, CAST(emission AS VARCHAR) AS key, station_id || '|' || unit_id AS detail FROM (SELECT *, emission % 40 AS m FROM dp) f, LATERAL (SELECT unnest(list_filter([
  CASE WHEN m = 2 THEN 'crossed_mismatch' END, CASE WHEN (m = 2 AND station_index <> 10 AND warning = threshold_crossed) OR (m = 3 AND NOT (threshold_crossed AND station_index = 11))
    OR (station_index = 11 AND threshold_crossed AND m NOT IN (2, 3)) THEN 'warning_mismatch' END], lambda x: x IS NOT NULL)) AS rule) r"""))
def prediction_contract_defect(spark, d):
    m = F.col("emission") % 40
    p = b.defect_predictions(spark, d).withColumn("threshold_crossed", F.when(m == 2, ~F.col("threshold_crossed")).otherwise(F.col("threshold_crossed"))).withColumn(
        "warning", F.when(m == 3, ~F.col("warning")).otherwise(F.col("warning")))
    return va.prediction_contract(p, b.stations(spark, d), b.units(spark, d), b.line_log(spark, d), "defect")


def flow_rows(spark, d):
    return sf.flow_features(b.station_events(spark, d), b.stations(spark, d))


@query("label_rules", with_ctes("ev stations", """
SELECT 'missing_label' AS rule, run_id, CAST(prediction_event_sequence AS VARCHAR) AS key, station_id AS detail FROM f WHERE target_eligibility_status = 'eligible' AND prediction_event_sequence % 10 = 0
UNION ALL SELECT 'label_already_full', run_id, CAST(prediction_event_sequence AS VARCHAR), station_id FROM f WHERE prediction_event_sequence % 10 = 1 AND currently_at_capacity
UNION ALL SELECT 'label_not_eligible', run_id, CAST(prediction_event_sequence AS VARCHAR), station_id FROM f WHERE prediction_event_sequence % 10 = 1 AND target_eligibility_status <> 'eligible'
UNION ALL SELECT 'label_incomplete_horizon', f.run_id, CAST(prediction_event_sequence AS VARCHAR), f.station_id FROM f JOIN (SELECT run_id, station_id, max(timestamp_ms) AS lt FROM ev GROUP BY ALL) l
  ON l.run_id = f.run_id AND l.station_id = f.station_id WHERE prediction_event_sequence % 10 = 1 AND lt < prediction_time + 1800000""", **_STATS_CTES, f=_FEATURES))
def label_rules(spark, d):
    i = F.col("prediction_event_sequence") % 10
    f = flow_rows(spark, d).withColumn("y_bottleneck", F.when(i == 1, F.coalesce("y_bottleneck", F.lit(0))).when(i != 0, F.col("y_bottleneck")))
    return va.label_rules(f)


@query("unit_label_rules", with_ctes("ev se ma units", """
SELECT 'inconsistent_unit_label' AS rule, run_id, unit_id AS key, min(y_defect) || '|' || max(y_defect) AS detail FROM f WHERE y_defect IS NOT NULL GROUP BY run_id, unit_id HAVING min(y_defect) <> max(y_defect)""", **UNIT_CTES))
def unit_label_rules(spark, d):
    return va.unit_label_rules(unit_features(spark, d))


@query("hidden_event_leak", with_ctes("line_log", """
SELECT CASE WHEN kind = 'INSPECTION' THEN 'inspection_on_bus' ELSE 'hidden_station_event' END AS rule, run_id, CAST(sequence AS VARCHAR) AS key, station_id AS detail FROM rb
WHERE kind = 'INSPECTION' OR (kind = 'STATION' AND station_index BETWEEN 3 AND 5)""", **BUS))
def hidden_event_leak(spark, d):
    return va.hidden_event_leak(runtime_bus(spark, d).withColumn("station_id", F.trim("station_id")), flags(spark, d))


@query("topology_match", with_ctes("stations", """
SELECT 'differs_buffer_capacity' AS rule, run_id, CAST(station_index AS VARCHAR) AS key, station_id AS detail FROM stations WHERE station_index = 4
UNION ALL SELECT 'dark_set', run_id, CAST(station_index AS VARCHAR), station_id FROM stations WHERE station_index = 7
UNION ALL SELECT 'station_order', run_id, CAST(station_index AS VARCHAR), station_id FROM stations WHERE station_index = 11
UNION ALL SELECT 'dark_set', run_id, CAST(station_index AS VARCHAR), station_id FROM stations WHERE station_index = 11"""))
def topology_match(spark, d):
    s = b.stations(spark, d)
    now = s.filter("station_index < 11").withColumn("buffer_capacity", F.when(F.col("station_index") == 4, 99).otherwise(F.col("buffer_capacity"))).withColumn(
        "is_dark", F.col("is_dark") | (F.col("station_index") == 7)).withColumn("archetype", F.concat(F.lit(" "), F.lower("archetype")))
    return va.topology_match(s, now)


@query("append_only", with_ctes("units", """
SELECT 'changed_vehicle_model' AS rule, run_id, unit_id AS key, vehicle_model || '|' || supplier_batch AS detail FROM units WHERE unit_id = 'U000002'
UNION ALL SELECT 'unit_vanished', run_id, unit_id, vehicle_model || '|' || supplier_batch FROM units WHERE unit_id = 'U000004'"""))
def append_only(spark, d):
    u = b.units(spark, d)
    return va.append_only(u, u.filter("unit_id <> 'U000004'").withColumn("vehicle_model", F.when(F.col("unit_id") == "U000002", "MODEL_X").otherwise(F.col("vehicle_model"))))


@query("assignment_floor", with_ctes("ev se", """
SELECT CASE WHEN m / n::DOUBLE < 0.35 THEN 'assignment_broken' ELSE 'assignment_low' END AS rule, run_id, 'sensor' AS key, m || '/' || n AS detail FROM (
  SELECT r.run_id, count(*) AS n, count(a.event_sequence) AS m FROM se r LEFT JOIN assigned a ON a.event_sequence = r.event_sequence GROUP BY r.run_id) WHERE m / n::DOUBLE < 0.4""", **ASSIGN))
def assignment_floor(spark, d):
    return va.assignment_floor(b.sensor_readings(spark, d), _assigned(spark, d), 0.35, 0.4)


@query("unit_order", with_ctes("ev", """
SELECT 'unit_moved_upstream' AS rule, run_id, unit_id AS key, event_sequence || '|' || p || '|' || station_index AS detail FROM (
  SELECT *, lag(station_index) OVER (PARTITION BY run_id, unit_id ORDER BY timestamp_ms, event_sequence) AS p FROM ev WHERE event_type = 'UNIT_ARRIVED' AND station_index <= 10) WHERE station_index < p"""))
def unit_order(spark, d):
    e = b.station_events(spark, d).filter("event_type = 'UNIT_ARRIVED' AND station_index <= 10")
    return va.unit_order(e.select("run_id", "unit_id", F.col("timestamp_ms").alias("prediction_time"), F.col("event_sequence").alias("prediction_event_sequence"),
                                  F.col("station_index").alias("prediction_station_index")))


@query("factory_rules", with_ctes("runs", """
SELECT r.rule, run_id, r.key, r.detail FROM runs, (VALUES ('bad_archetype', 'S02', '1'), ('bad_cycle_time', 'S03', '2'), ('inspection_in_zone', 'DZ01', 'S06'), ('checkpoint_type', 'CP_S01', 'S01'),
  ('checkpoint_progress', 'CP_S02', 'S02')) r(rule, key, detail)"""))
def factory_rules(spark, d):
    i = F.col("station_index")
    s = b.stations(spark, d).withColumn("archetype", F.when(i == 1, "ROBOT").otherwise(F.col("archetype"))).withColumn("base_cycle_time_ms", F.when(i == 2, 0).otherwise(F.col("base_cycle_time_ms")))
    c = checkpoint_defs(spark, d).withColumn("checkpoint_type", F.when(F.col("station_id") == "S01", "LASER").otherwise(F.col("checkpoint_type"))).withColumn(
        "nominal_progress_fraction", F.when(F.col("station_id") == "S02", 1.0).otherwise(F.col("nominal_progress_fraction")))
    return va.factory_rules(s, b.dark_zones(spark, d), c)


def _planted(f, n: int, numbers: list[str], text: str | None = None):
    """Every n-th row has one wrong value: column number i of ``numbers`` is one too high in rows i mod n, a text is another in the next."""
    i = F.col("prediction_event_sequence") % n
    for k, c in enumerate(numbers):
        f = f.withColumn(c, F.when(i == k, F.coalesce(c, F.lit(0)) + 1).otherwise(F.col(c)))
    return f if text is None else f.withColumn(text, F.when(i == len(numbers), "wrong").otherwise(F.col(text)))


def _planted_sql(source: str, n: int, names: list[str], detail: str) -> str:
    return " UNION ALL ".join(f"SELECT 'replay_{c}' AS rule, run_id, CAST(event_sequence AS VARCHAR) AS key, {detail} AS detail FROM {source} AND event_sequence % {n} = {k}"
                              for k, c in enumerate(names))


_FLOW_WRONG = ["queue_mean_10m", "queue_delta_10m", "cycle_std_10m", "line_fraction", "progress_std", "state_confidence", "arrival_rate_per_min_prev10m"]


@query("causal_replay", with_ctes("ev", _planted_sql("ev WHERE true", 50, [*_FLOW_WRONG, "target_eligibility_status"], "station_id")))
def causal_replay(spark, d):
    """All flow columns and the label; what differs is what was planted, so all else is as the raw rows say."""
    f = _planted(flow_rows(spark, d), 50, _FLOW_WRONG, "target_eligibility_status")
    return va.causal_replay(f, b.station_events(spark, d), b.stations(spark, d), tol=1e-6)


_UNIT_WRONG = ["torque_mean_history", "vibration_max_recent", "manual_check_count_cum", "stations_since_last_manual_fail", "queue_history_std"]


@query("causal_replay_quality", with_ctes("ev", _planted_sql("ev WHERE event_type = 'UNIT_ARRIVED' AND station_index <= 10", 20, [*_UNIT_WRONG, "supplier_batch"], "unit_id")))
def causal_replay_quality(spark, d):
    e = b.station_events(spark, d)
    arrivals = e.filter("event_type = 'UNIT_ARRIVED' AND station_index <= 10").select(
        "run_id", "unit_id", F.col("timestamp_ms").alias("t"), F.col("event_sequence").alias("s"), F.col("station_index").alias("at"))
    assigned = _assigned(spark, d).withColumnRenamed("assigned_unit_id", "unit_id")
    return va.causal_replay_quality(_planted(unit_features(spark, d), 20, _UNIT_WRONG, "supplier_batch"), arrivals, assigned, e, b.manual_checks(spark, d), b.units(spark, d),
                                    b.stations(spark, d), tol=1e-6)
