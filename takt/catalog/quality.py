"""Registered queries over units: intervals, as-of assignment, quality features, labels, joins."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded, rounded_sql
from takt.catalog.sql import with_ctes
from takt.contracts import QUALITY_FEATURES, QUALITY_META
from takt.operators import joins as jn
from takt.plans import unit_quality as uq

QUERIES, ORACLE, query = registry()

FIFO = {
    "pr": """
  SELECT run_id, unit_id, station_id, station_index, timestamp_ms, event_sequence,
    CASE WHEN event_type = 'PROCESSING_STARTED' THEN 1 ELSE 0 END AS is_start
  FROM ev WHERE event_type IN ('PROCESSING_STARTED', 'PROCESSING_COMPLETED')""",
    "run_counts": """
  SELECT *, sum(is_start) OVER w AS s, sum(1 - is_start) OVER w AS c FROM pr
  WINDOW w AS (PARTITION BY run_id, unit_id, station_id ORDER BY timestamp_ms, event_sequence ROWS UNBOUNDED PRECEDING)""",
    "run_peaks": """
  SELECT *, greatest(0, max(c - s) OVER w) AS u,
    greatest(0, coalesce(max(c - s) OVER (PARTITION BY run_id, unit_id, station_id ORDER BY timestamp_ms, event_sequence
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS u_prev FROM run_counts
  WINDOW w AS (PARTITION BY run_id, unit_id, station_id ORDER BY timestamp_ms, event_sequence ROWS UNBOUNDED PRECEDING)""",
    "paired": """
  SELECT a.run_id, a.unit_id, a.station_id, a.station_index, a.timestamp_ms AS processing_start, z.timestamp_ms AS processing_end,
    a.event_sequence AS start_event_sequence, z.event_sequence AS end_event_sequence
  FROM run_peaks z JOIN run_peaks a ON a.is_start = 1 AND z.is_start = 0 AND z.u = z.u_prev AND a.run_id = z.run_id
    AND a.unit_id = z.unit_id AND a.station_id = z.station_id AND a.s = z.c - z.u""",
    "intervals": "SELECT * FROM paired WHERE processing_end > processing_start",
}
ASSIGN = {
    **FIFO,
    "starts": """
  SELECT * FROM intervals QUALIFY row_number() OVER (PARTITION BY run_id, station_id, processing_start
    ORDER BY processing_end DESC, start_event_sequence DESC) = 1""",
    "assigned": """
  SELECT r.run_id, r.station_id, r.station_index, r.timestamp_ms, r.event_sequence, r.sensor_type, r.value,
    i.unit_id, i.processing_start, i.processing_end
  FROM se r ASOF JOIN starts i ON r.run_id = i.run_id AND r.station_id = i.station_id AND r.timestamp_ms >= i.processing_start
  WHERE r.timestamp_ms <= i.processing_end""",
}


@query("pair_fifo", with_ctes("ev", """
SELECT run_id, unit_id, station_id, processing_start, processing_end, start_event_sequence, end_event_sequence FROM intervals""", **FIFO))
def pair_fifo(spark, d):
    return jn.pair_fifo(b.station_events(spark, d))[0]


@query("pair_fifo_diagnostics", with_ctes("ev", """
SELECT run_id, (SELECT count(*) FROM intervals i WHERE i.run_id = p.run_id) AS valid_intervals,
  CAST(sum(is_start) AS BIGINT) - (SELECT count(*) FROM paired i WHERE i.run_id = p.run_id) AS unmatched_starts,
  CAST(sum(1 - is_start) AS BIGINT) - (SELECT count(*) FROM paired i WHERE i.run_id = p.run_id) AS unmatched_completions,
  (SELECT count(*) FROM paired i WHERE i.run_id = p.run_id AND processing_end <= processing_start) AS invalid_intervals
FROM pr p GROUP BY run_id""", **FIFO))
def pair_fifo_diagnostics(spark, d):
    return jn.pair_fifo(b.station_events(spark, d))[1]


@query("pair_by_key", with_ctes("ev", """
SELECT a.run_id, a.unit_id, a.station_id, a.timestamp_ms AS entry_ts, z.timestamp_ms AS exit_ts
FROM ev a JOIN ev z ON a.run_id = z.run_id AND a.unit_id = z.unit_id AND a.station_id = z.station_id
WHERE a.event_type = 'PROCESSING_STARTED' AND z.event_type = 'PROCESSING_COMPLETED' AND z.timestamp_ms > a.timestamp_ms"""))
def pair_by_key(spark, d):
    e = b.station_events(spark, d)
    return jn.pair_by_key(e.filter("event_type = 'PROCESSING_STARTED'"), e.filter("event_type = 'PROCESSING_COMPLETED'"))


def _assigned(spark, d):
    i, _ = jn.pair_fifo(b.station_events(spark, d))
    return jn.assign_by_interval(b.sensor_readings(spark, d), i)


@query("assign_by_interval", with_ctes("ev se", """
SELECT run_id, station_id, timestamp_ms, event_sequence, sensor_type, value, unit_id AS assigned_unit_id, processing_start,
  processing_end FROM assigned""", **ASSIGN))
def assign_by_interval(spark, d):
    return _assigned(spark, d).drop("station_index")


_ELEMENTS = {
    "el": """
  SELECT run_id, unit_id, station_index AS src, 'sensor' AS what, sensor_type AS signal, value AS v, timestamp_ms AS ts,
    processing_end AS avail, event_sequence AS seq FROM assigned
  UNION ALL SELECT run_id, unit_id, station_index, 'queue', NULL, queue_length_after, timestamp_ms, timestamp_ms, event_sequence
  FROM ev WHERE event_type = 'UNIT_ARRIVED' AND queue_length_after IS NOT NULL
  UNION ALL SELECT run_id, unit_id, station_index, 'cycle', NULL, cycle_time_ms, timestamp_ms, timestamp_ms, event_sequence
  FROM ev WHERE event_type = 'PROCESSING_COMPLETED' AND cycle_time_ms IS NOT NULL
  UNION ALL SELECT run_id, unit_id, station_index, 'manual', NULL, CASE WHEN result = 'FAIL' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
    timestamp_ms, timestamp_ms, event_sequence FROM ma""",
}
_LINE_ELEMENTS = {
    "el": """
  SELECT run_id, NULL::VARCHAR AS unit_id, station_index AS src, 'sensor' AS what, sensor_type AS signal, value AS v,
    timestamp_ms AS ts, timestamp_ms AS avail, event_sequence AS seq FROM se
  UNION ALL SELECT run_id, NULL, station_index, 'queue', NULL, queue_length_after, timestamp_ms, timestamp_ms, event_sequence
  FROM ev WHERE queue_length_after IS NOT NULL
  UNION ALL SELECT run_id, unit_id, station_index, 'cycle', NULL, cycle_time_ms, timestamp_ms, timestamp_ms, event_sequence
  FROM ev WHERE event_type = 'PROCESSING_COMPLETED' AND cycle_time_ms IS NOT NULL
  UNION ALL SELECT run_id, unit_id, station_index, 'manual', NULL, CASE WHEN result = 'FAIL' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END,
    timestamp_ms, timestamp_ms, event_sequence FROM ma""",
}


def _agg() -> str:
    parts = []
    for s in ("torque", "vibration", "temperature", "current"):
        h = f"what = 'sensor' AND signal = '{s.upper()}'"
        parts += [f"avg(v) FILTER ({h}) AS {s}_mean_history", f"max(v) FILTER ({h}) AS {s}_max_history",
                  f"avg(v) FILTER ({h} AND ts >= t - 600000) AS {s}_mean_recent",
                  f"max(v) FILTER ({h} AND ts >= t - 600000) AS {s}_max_recent"]
    parts += ["stddev_samp(v) FILTER (what = 'sensor' AND signal = 'TORQUE') AS torque_std_history"]
    for k in ("queue", "cycle"):
        parts += [f"avg(v) FILTER (what = '{k}') AS {k}_mean", f"stddev_samp(v) FILTER (what = '{k}') AS {k}_std",
                  f"max(v) FILTER (what = '{k}') AS {k}_max"]
    parts += ["count(v) FILTER (what = 'manual')::DOUBLE AS manual_check_count_cum",
              "coalesce(sum(v) FILTER (what = 'manual'), 0)::DOUBLE AS manual_fail_count_cum",
              "arg_max(v, ts * 100000000 + seq) FILTER (what = 'manual') AS last_manual_fail",
              "arg_max(src, ts * 100000000 + seq) FILTER (what = 'manual' AND v = 1) AS last_fail_src"]
    return ", ".join(parts)


def _feature_sql(final_index: int, op: str, qa: str, line: bool) -> dict[str, str]:
    unit = "(e.unit_id IS NULL OR e.unit_id = p.unit_id)" if line else "e.unit_id = p.unit_id"
    return {
        "pred": f"""
  SELECT run_id, unit_id, station_id AS prediction_station, timestamp_ms AS t, event_sequence AS seq, station_index AS idx
  FROM ev WHERE event_type = 'UNIT_ARRIVED' AND station_index <= {final_index}""",
        "hist": f"""
  SELECT p.run_id, p.unit_id, p.t, p.seq AS pseq, {_agg()}
  FROM (SELECT p.*, e.what, e.signal, e.v, e.ts, e.seq AS eseq, e.src FROM pred p LEFT JOIN el e
    ON e.run_id = p.run_id AND {unit} AND e.src < p.idx AND e.ts < p.t AND e.avail < p.t) p GROUP BY ALL""".replace(
            "* 100000000 + seq", "* 100000000 + eseq"),
        "qa": f"SELECT run_id, unit_id, timestamp_ms AS ts, result FROM ma WHERE {qa}",
        "lab": f"""
  SELECT p.run_id, p.seq AS pseq, CAST(count(q.ts) AS BIGINT) AS n_qa, max(CASE WHEN q.result = 'FAIL' THEN 1 ELSE 0 END) AS bad
  FROM pred p LEFT JOIN qa q ON q.run_id = p.run_id AND q.unit_id = p.unit_id AND q.ts {op} p.t GROUP BY ALL""",
        "f": f"""
  SELECT p.run_id, p.unit_id, p.prediction_station, p.t AS prediction_time, p.seq AS prediction_event_sequence,
    CASE WHEN n_qa > 0 THEN 'complete' ELSE 'censored' END AS label_completeness_status, {final_index} AS final_station_index,
    torque_mean_recent - torque_mean_history AS torque_delta_recent_vs_history, manual_fail_count_cum, idx AS prediction_station_index,
    torque_mean_history, idx / 11.0::DOUBLE AS line_fraction, last_manual_fail, manual_check_count_cum, torque_mean_recent,
    queue_mean AS queue_history_mean, current_mean_recent,
    CASE WHEN current_mean_recent IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS current_missing_recent,
    vibration_mean_recent - vibration_mean_history AS vibration_delta_recent_vs_history, current_mean_history, torque_max_recent,
    temperature_mean_history, torque_max_history, supplier_batch, current_max_history, cycle_max AS cycle_history_max,
    temperature_max_recent, vibration_mean_history, temperature_max_history, (idx - last_fail_src)::DOUBLE AS stations_since_last_manual_fail,
    vehicle_model, vibration_max_history, vibration_max_recent, temperature_mean_recent, torque_std_history,
    queue_std AS queue_history_std, cycle_std AS cycle_history_std, CASE WHEN n_qa > 0 THEN bad END AS y_defect
  FROM pred p JOIN hist h ON h.run_id = p.run_id AND h.pseq = p.seq JOIN lab l ON l.run_id = p.run_id AND l.pseq = p.seq
    LEFT JOIN units u ON u.run_id = p.run_id AND u.unit_id = p.unit_id""",
    }


_INTS = {"prediction_station_index", "supplier_batch", "vehicle_model"}
_COLS = QUALITY_META + QUALITY_FEATURES + ["y_defect"]
_DBL = set(QUALITY_FEATURES) - _INTS
UNIT_CTES = {**ASSIGN, **_ELEMENTS, **_feature_sql(10, ">", "station_index = 10", False)}
LINE_CTES = {**_LINE_ELEMENTS, **_feature_sql(11, ">=", "station_index = 11", True)}


def unit_features(spark, d):
    return uq.quality_features(b.station_events(spark, d), b.sensor_readings(spark, d), b.manual_checks(spark, d),
                               b.units(spark, d), b.stations(spark, d), b.inspections(spark, d))


@query("defect_features", with_ctes("ev se ma units", f"SELECT {rounded_sql(_COLS, _DBL)} FROM f", **UNIT_CTES))
def defect_features(spark, d):
    return rounded(unit_features(spark, d))


@query("defect_features_line", with_ctes("ev se ma units", f"SELECT {rounded_sql(_COLS, _DBL)} FROM f", **LINE_CTES))
def defect_features_line(spark, d):
    return rounded(uq.quality_features_line(
        b.station_events(spark, d), b.sensor_readings(spark, d), b.manual_checks(spark, d), b.units(spark, d),
        b.stations(spark, d), b.manual_checks(spark, d)))


@query("defect_label", with_ctes("ev ma", """
SELECT p.run_id, p.unit_id, p.seq AS prediction_event_sequence, CASE WHEN n_qa > 0 THEN 'complete' ELSE 'censored' END AS label_completeness_status, CASE WHEN n_qa > 0 THEN bad END AS y_defect
FROM pred p JOIN lab l ON l.run_id = p.run_id AND l.pseq = p.seq""", **{k: v for k, v in UNIT_CTES.items() if k in ("pred", "qa", "lab")}))
def defect_label(spark, d):
    final = uq.final_station(b.stations(spark, d))
    rows = uq._as_pred(uq.prediction_rows(b.station_events(spark, d), final))
    return uq.label_rows(rows, b.inspections(spark, d), final).select("run_id", "unit_id", "prediction_event_sequence", "label_completeness_status", "y_defect")
