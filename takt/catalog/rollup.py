"""Registered roll-ups of the prediction streams."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded
from takt.catalog.sql import with_ctes
from takt.functions import scalar as sc
from takt.operators import aggregate as ag
from takt.operators import rollup as ru
from takt.operators import select as sel
from takt.operators import windows as wn
from takt.operators.joins import latest_at_or_before as at_or_before
from takt.session import cut_lineage

QUERIES, ORACLE, query = registry()


def _health(spark, d):
    """Run health derived from the log: a run is DEGRADED when its last event number is divisible by 4."""
    return b.line_log(spark, d).groupBy("run_id", "production_day").agg(F.max("event_id").alias("m")).select(
        "run_id", "production_day", F.when(F.col("m") % 4 == 0, "DEGRADED").otherwise("PASS").alias("status"),
        F.when(F.col("m") % 8 == 0, "FAILED_ISOLATED").otherwise("PASS").alias("bottleneck_status"),
        F.when(F.col("m") % 8 == 4, "FAILED_ISOLATED").otherwise("PASS").alias("defect_status"),
        F.when(F.col("m") % 3 == 0, F.col("m") % 50 + 1).alias("units_created"))


HEALTH = {"health": """
  SELECT run_id, production_day, CASE WHEN m % 4 = 0 THEN 'DEGRADED' ELSE 'PASS' END AS status,
    CASE WHEN m % 8 = 0 THEN 'FAILED_ISOLATED' ELSE 'PASS' END AS bottleneck_status,
    CASE WHEN m % 8 = 4 THEN 'FAILED_ISOLATED' ELSE 'PASS' END AS defect_status,
    CASE WHEN m % 3 = 0 THEN m % 50 + 1 END AS units_created
  FROM (SELECT run_id, production_day, max(event_id) AS m FROM line_log GROUP BY ALL)"""}


def _latest_sql(src: str, key: str) -> str:
    return f"SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY run_id, {key} ORDER BY emission DESC) = 1"


def _drivers_sql(k: int) -> str:
    """Readable driver names of a row, as the scalar function builds them."""
    names = str(b.DRIVER_FEATURES)
    usable = f"list_filter(list_transform([0, 1, 2], lambda o: (k + o) % 6), lambda j: list_extract({names}, j + 1) <> 'station_id')"
    raising = f"list_filter({usable}, lambda j: j % 3 <> 2)"
    chosen = f"CASE WHEN len({raising}) > 0 THEN {raising} ELSE {usable} END"
    hum = (f"list_transform(list_transform({chosen}, lambda j: replace(list_extract({names}, j + 1), '_', ' ')), "
           "lambda f: upper(f[1]) || lower(f[2:]))")
    return f"list_slice({hum}, 1, {k})"


def _flags(src: str, key: str) -> dict[str, str]:
    return {
        f"fl_{src}": f"""
  SELECT *, lag(warning) OVER w AS was, lag(timestamp_ms) OVER w AS prev_ts,
    sum(CASE WHEN warning THEN 0 ELSE 1 END) OVER w AS island FROM {src} WINDOW w AS (PARTITION BY run_id, {key} ORDER BY emission)""",
        f"an_{src}": f"""
  SELECT run_id, {key}, count(*) AS point_count, arg_max(probability, emission) AS current_risk, max(probability) AS peak_risk,
    avg(probability) AS average_risk, arg_max(threshold, emission) AS threshold,
    CAST(count(*) FILTER (warning) AS BIGINT) AS warning_count, arg_min(timestamp_ms, emission) AS first_timestamp_ms,
    arg_max(timestamp_ms, emission) AS last_timestamp_ms, arg_max(warning, emission) AS warning_now,
    count(*) FILTER (warning AND NOT coalesce(was, false)) AS threshold_crossings,
    CAST(coalesce(sum(CASE WHEN warning AND was THEN greatest(0, timestamp_ms - prev_ts) END), 0) AS BIGINT) AS time_above_ms
  FROM fl_{src} GROUP BY run_id, {key}""",
        f"tr_{src}": f"""
  SELECT run_id, {key}, CASE WHEN n < 4 THEN 'UNKNOWN' WHEN abs(dl) < 0.02 THEN 'STABLE' WHEN dl > 0 THEN 'RISING' ELSE 'FALLING' END AS trend,
    CASE WHEN n < 4 THEN 0 ELSE dl END AS trend_delta FROM (
    SELECT run_id, {key}, max(n) AS n, avg(probability) FILTER (r <= w) - avg(probability) FILTER (r > w AND r <= 2 * w) AS dl
    FROM (SELECT *, least(20, n // 2) AS w FROM (SELECT *, count(*) OVER (PARTITION BY run_id, {key}) AS n,
      row_number() OVER (PARTITION BY run_id, {key} ORDER BY emission DESC) AS r FROM {src})) GROUP BY run_id, {key})""",
    }


FB, FD = _flags("bp", "station_id"), _flags("dp", "unit_id")
_AN = ["point_count", "current_risk", "peak_risk", "average_risk", "threshold", "warning_count", "first_timestamp_ms",
       "last_timestamp_ms", "warning_now", "threshold_crossings", "time_above_ms"]


def _analytics_sql(src: str, key: str) -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" if c.endswith("risk") else c for c in _AN)
    return f"SELECT a.run_id, a.{key}, {cols}, trend, round(trend_delta, 6) AS trend_delta FROM an_{src} a JOIN tr_{src} t ON a.run_id = t.run_id AND a.{key} = t.{key}"


@query("series_analytics", with_ctes("bp", _analytics_sql("bp", "station_id"), **FB))
def series_analytics(spark, d):
    return rounded(ru.series_analytics(b.bottleneck_predictions(spark, d), "station_id"), default=6)


@query("series_analytics_units", with_ctes("dp", _analytics_sql("dp", "unit_id"), **FD))
def series_analytics_units(spark, d):
    return rounded(ru.series_analytics(b.defect_predictions(spark, d), "unit_id"), default=6)


def _with_stream(df):
    """One file per production week; a file's first run owns it."""
    return df.withColumn("stream_id", F.floor((F.col("production_day") - 1) / 7).cast("int")).withColumn(
        "station_id", F.when(F.col("emission") % 97 != 0, F.col("station_id"))).withColumn(
        "probability", F.when(F.col("emission") % 89 != 0, F.col("probability")))


_STREAM = {
    "st": """
  SELECT * REPLACE (CASE WHEN emission % 97 <> 0 THEN station_id END AS station_id, CASE WHEN emission % 89 <> 0 THEN probability END AS probability),
    (production_day - 1) // 7 AS stream_id FROM bp""",
    "own": "SELECT stream_id, arg_min(run_id, emission) AS own_run FROM st WHERE station_id IS NOT NULL GROUP BY stream_id",
    "sts": """
  SELECT st.*, CASE WHEN station_id IS NULL THEN 'skipped' WHEN run_id <> own_run THEN 'foreign' WHEN probability IS NULL THEN 'skipped' ELSE 'ok' END AS s
  FROM st JOIN own ON st.stream_id = own.stream_id""",
}


@query("series_points", with_ctes("bp", "SELECT stream_id, run_id, station_id, emission, round(probability, 6) AS probability, warning FROM sts WHERE s = 'ok'", **_STREAM))
def series_points(spark, d):
    return rounded(ru.series_points(_with_stream(b.bottleneck_predictions(spark, d)), "station_id")[0].select(
        "stream_id", "run_id", "station_id", "emission", "probability", "warning"), default=6)


@query("series_points_counts", with_ctes("bp", """SELECT stream_id, count(*) FILTER (s = 'ok') AS record_count, count(*) FILTER (s = 'skipped') AS skipped_records,
  count(*) FILTER (s = 'foreign') AS foreign_run_records FROM sts GROUP BY stream_id""", **_STREAM))
def series_points_counts(spark, d):
    return ru.series_points(_with_stream(b.bottleneck_predictions(spark, d)), "station_id")[1]


def _periods_sql(src: str, key: str) -> str:
    return f"""
SELECT i.run_id, i.{key}, start_ms, end_ms, point_count, island = clear AS open_ended FROM (
  SELECT run_id, {key}, island, arg_min(timestamp_ms, emission) AS start_ms, arg_max(timestamp_ms, emission) AS end_ms, count(*) AS point_count
  FROM fl_{src} WHERE warning GROUP BY ALL) i
JOIN (SELECT run_id, {key}, count(*) FILTER (NOT warning) AS clear FROM {src} GROUP BY ALL) e ON e.run_id = i.run_id AND e.{key} = i.{key}"""


@query("warning_periods", with_ctes("bp", _periods_sql("bp", "station_id"), **FB))
def warning_periods(spark, d):
    return wn.warning_periods(b.bottleneck_predictions(spark, d), "station_id")


@query("trend", with_ctes("bp", "SELECT run_id, station_id, trend, round(trend_delta, 6) AS trend_delta FROM tr_bp", **FB))
def trend(spark, d):
    return rounded(wn.trend(b.bottleneck_predictions(spark, d), "station_id"), default=6)


LB, LD = {"lb": _latest_sql("bp", "station_id")}, {"ld": _latest_sql("dp", "unit_id")}


def latest_b(spark, d):
    return ru.latest_by_key(b.bottleneck_predictions(spark, d), "station_id")


def latest_d(spark, d):
    return ru.latest_by_key(b.defect_predictions(spark, d), "unit_id")


@query("latest_by_key", with_ctes("bp", "SELECT run_id, station_id, timestamp_ms, emission, round(probability, 6) AS probability, warning, state_confidence, zone FROM lb", **LB))
def latest_by_key(spark, d):
    return rounded(latest_b(spark, d).select("run_id", "station_id", "timestamp_ms", "emission", "probability", "warning", "state_confidence", "zone"), default=6)


@query("active_warnings", with_ctes("dp", "SELECT run_id, unit_id, station_id, emission FROM ld WHERE warning", **LD))
def active_warnings(spark, d):
    return ru.active_warnings(b.defect_predictions(spark, d), "unit_id").select("run_id", "unit_id", "station_id", "emission")


@query("station_board", with_ctes("bp stations", """
SELECT s.run_id, s.station_id, s.station_index, s.name, s.archetype, round_even(risk_percent, 1) AS risk_percent,
  CASE WHEN warning IS NULL THEN 'NO DATA' WHEN warning THEN 'ALERT' ELSE 'NORMAL' END AS status,
  CAST(coalesce(round_even(state_confidence * 100, 0), 0) AS BIGINT) AS confidence_percent, coalesce(zone, 'UNKNOWN') AS zone
FROM stations s LEFT JOIN lb l ON l.run_id = s.run_id AND l.station_id = s.station_id""", **LB))
def station_board(spark, d):
    return ru.station_board(b.stations(spark, d), latest_b(spark, d))


_CONF = "CAST(coalesce(round_even(state_confidence * 100, 0), 0) AS BIGINT) AS confidence_percent"


@query("priority_queue", with_ctes("bp dp", f"""
SELECT run_id, kind, reference, station, risk_percent, confidence_percent, low_confidence, drivers, action, dark_context, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY risk_percent DESC, confidence_percent DESC, kind, reference) AS rank FROM (
    SELECT run_id, 'BOTTLENECK' AS kind, station_id AS reference, station_id AS station, round_even(risk_percent, 1) AS risk_percent, {_CONF},
      state_confidence < 0.75 AS low_confidence, array_to_string({_drivers_sql(2)}, ', ') AS drivers,
      replace('{ru.STATION_ACTION}', '{{station}}', station_id) AS action, zone = 'DARK' AS dark_context FROM lb WHERE warning
    UNION ALL SELECT run_id, 'DEFECT', unit_id, station_id, round_even(risk_percent, 1), {_CONF}, state_confidence < 0.75,
      array_to_string({_drivers_sql(2)}, ', '),
      CASE WHEN station_id = 'S11' THEN replace(replace('{ru.UNIT_ACTION_FINAL}', '{{unit}}', unit_id), '{{station}}', station_id)
        ELSE replace(replace('{ru.UNIT_ACTION}', '{{unit}}', unit_id), '{{station}}', station_id) END, route LIKE 'DARK%' FROM ld WHERE warning))
WHERE rank <= 12""", **LB, **LD))
def priority_queue(spark, d):
    return ru.priority_queue(latest_b(spark, d), latest_d(spark, d))


@query("station_watch", with_ctes("bp", f"""
SELECT run_id, station_id, risk_percent, warning, confidence_percent, trend, predictions, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY warning DESC, risk_percent DESC, station_id) AS rank FROM (
    SELECT l.run_id, l.station_id, round_even(risk_percent, 1) AS risk_percent, warning, {_CONF}, trend, point_count AS predictions
    FROM lb l JOIN an_bp a ON a.run_id = l.run_id AND a.station_id = l.station_id JOIN tr_bp t ON t.run_id = l.run_id AND t.station_id = l.station_id))
WHERE rank <= 6""", **LB, **FB))
def station_watch(spark, d):
    return ru.station_watch(latest_b(spark, d), ru.series_analytics(b.bottleneck_predictions(spark, d), "station_id"))


@query("quality_watch", with_ctes("dp", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY warning DESC, risk_percent DESC, unit_id) AS INTEGER) AS rank FROM (
  SELECT run_id, unit_id, round_even(risk_percent, 1) AS risk_percent, station_id AS station, CASE WHEN warning THEN 'High' ELSE 'Monitor' END AS inspection_priority,
    {_CONF}, warning FROM ld) QUALIFY rank <= 6""", **LD))
def quality_watch(spark, d):
    return ru.quality_watch(latest_d(spark, d))


@query("ranked_alerts", with_ctes("bp", """
SELECT run_id, station_id, emission, round(risk_percent, 6) AS risk_percent FROM bp WHERE warning ORDER BY bp.risk_percent DESC, state_confidence DESC, emission LIMIT 50"""))
def ranked_alerts(spark, d):
    p = b.bottleneck_predictions(spark, d).filter("warning")
    return rounded(sel.ranked_alerts(p, [F.col("risk_percent").desc(), F.col("state_confidence").desc(), F.col("emission")], 50).select(
        "run_id", "station_id", "emission", "risk_percent"), default=6)


def _shift_sql() -> str:
    return f"""
SELECT run_id, status AS health_status, status <> 'PASS' AS degraded, ab AS active_bottleneck_alerts, ad AS active_defect_alerts, lo_b AS low_confidence_bottleneck,
  lo_d AS low_confidence_defect, dk AS dark_inferred_alerts, ab + ad > 0 OR status <> 'PASS' AS intervention_required,
  array_to_string(CASE WHEN len(notes) = 0 AND NOT (ab + ad > 0 OR status <> 'PASS') THEN ['{ru.NOTE_QUIET}'] ELSE notes END, ' / ') AS notes
FROM (SELECT *, list_filter([CASE WHEN status <> 'PASS' THEN replace('{ru.NOTE_HEALTH}', '{{status}}', status) END,
    CASE WHEN lo_b + lo_d > 0 THEN replace('{ru.NOTE_LOW}', '{{n}}', CAST(lo_b + lo_d AS VARCHAR)) END,
    CASE WHEN dk > 0 THEN replace('{ru.NOTE_DARK}', '{{n}}', CAST(dk AS VARCHAR)) END], lambda x: x IS NOT NULL) AS notes
  FROM (SELECT h.*, (SELECT count(*) FROM lb WHERE lb.run_id = h.run_id AND warning) AS ab, (SELECT count(*) FROM ld WHERE ld.run_id = h.run_id AND warning) AS ad,
    (SELECT count(*) FROM lb WHERE lb.run_id = h.run_id AND state_confidence < 0.75) AS lo_b, (SELECT count(*) FROM ld WHERE ld.run_id = h.run_id AND state_confidence < 0.75) AS lo_d,
    (SELECT count(*) FROM lb WHERE lb.run_id = h.run_id AND warning AND zone = 'DARK') + (SELECT count(*) FROM ld WHERE ld.run_id = h.run_id AND warning AND route LIKE 'DARK%') AS dk
  FROM health h))"""


@query("shift_health", with_ctes("bp dp", _shift_sql(), **LB, **LD, **HEALTH))
def shift_health(spark, d):
    return ru.shift_health(latest_b(spark, d), latest_d(spark, d), _health(spark, d)).withColumn("notes", F.array_join("notes", " / "))


_DAY = {
    "pkb": "SELECT run_id, production_day, station_id, count(*) AS records, count(*) FILTER (warning) AS warnings, max(probability) AS peak, sum(state_confidence) AS cs, count(state_confidence) AS cn FROM bp GROUP BY ALL",
    "pkd": "SELECT run_id, production_day, unit_id, count(*) AS records, count(*) FILTER (warning) AS warnings, max(probability) AS peak, sum(state_confidence) AS cs, count(state_confidence) AS cn FROM dp GROUP BY ALL",
}
PCT = "CAST(coalesce(round_even(100.0::DOUBLE * ({t}) / nullif({n}, 0), 0), 0) AS BIGINT)"


@query("scope_kpis", with_ctes("bp dp runs", f"""
SELECT (SELECT count(*) FROM runs) AS production_days, (SELECT count(*) FROM pkb WHERE warnings > 0) AS bottleneck_alerts,
  (SELECT count(*) FROM pkd WHERE warnings > 0) AS defect_alerts, (SELECT count(DISTINCT station_id) FROM pkb WHERE warnings > 0) AS affected_stations,
  {PCT.format(t='(SELECT sum(cs) FROM pkb) + (SELECT sum(cs) FROM pkd)', n='(SELECT sum(cn) FROM pkb) + (SELECT sum(cn) FROM pkd)')} AS avg_confidence_percent""", **_DAY))
def scope_kpis(spark, d):
    return ru.scope_kpis(b.bottleneck_predictions(spark, d), b.defect_predictions(spark, d), b.runs(spark, d)).select(
        *[F.col(c).cast("long").alias(c) for c in ("production_days", "bottleneck_alerts", "defect_alerts", "affected_stations", "avg_confidence_percent")])


@query("performance_trend", with_ctes("bp dp", f"""
SELECT h.production_day, h.run_id, x.a AS bottleneck_alert_stations, x.r AS bottleneck_records, y.a AS defect_alert_units, y.r AS defect_records,
  {PCT.format(t='x.cs + y.cs', n='x.cn + y.cn')} AS avg_confidence_percent, status <> 'PASS' AS degraded
FROM health h JOIN (SELECT run_id, count(*) FILTER (warnings > 0) AS a, CAST(sum(records) AS BIGINT) AS r, sum(cs) AS cs, sum(cn) AS cn FROM pkb GROUP BY 1) x ON x.run_id = h.run_id
JOIN (SELECT run_id, count(*) FILTER (warnings > 0) AS a, CAST(sum(records) AS BIGINT) AS r, sum(cs) AS cs, sum(cn) AS cn FROM pkd GROUP BY 1) y ON y.run_id = h.run_id""", **_DAY, **HEALTH))
def performance_trend(spark, d):
    return ru.performance_trend(b.bottleneck_predictions(spark, d), b.defect_predictions(spark, d), _health(spark, d))


@query("recurring_constraints", with_ctes("bp runs", f"""
SELECT s.station_id, days_affected, days_in_scope, alert_count, peak_risk_percent, avg_confidence_percent, coalesce(drivers, '') AS drivers,
  CASE WHEN (days_in_scope > 1 AND days_affected >= days_in_scope) OR peak_risk_percent >= 70 THEN 'High'
    WHEN peak_risk_percent >= 40 OR days_affected > 1 THEN 'Elevated' ELSE 'Watch' END AS risk_level
FROM (SELECT station_id, count(*) FILTER (warnings > 0) AS days_affected, (SELECT count(*) FROM runs) AS days_in_scope,
    CAST(sum(warnings) AS BIGINT) AS alert_count, round_even(max(peak) FILTER (warnings > 0) * 100, 1) AS peak_risk_percent,
    {PCT.format(t='sum(cs)', n='sum(cn)')} AS avg_confidence_percent FROM pkb GROUP BY station_id) s
LEFT JOIN (SELECT station_id, string_agg(driver, ', ' ORDER BY r) AS drivers FROM (
    SELECT station_id, driver, row_number() OVER (PARTITION BY station_id ORDER BY count(*) DESC, driver) AS r FROM (
      SELECT l.station_id, unnest({_drivers_sql(3)}) AS driver FROM lb l JOIN pkb p ON p.run_id = l.run_id AND p.station_id = l.station_id AND p.warnings > 0)
    GROUP BY station_id, driver) WHERE r <= 3 GROUP BY station_id) f ON f.station_id = s.station_id
WHERE days_affected > 0""", **_DAY, **LB))
def recurring_constraints(spark, d):
    return ru.recurring_constraints(b.bottleneck_predictions(spark, d), b.runs(spark, d))


@query("defect_concentration", with_ctes("dp", f"""
SELECT station_id AS station, count(DISTINCT run_id) FILTER (warning) AS days_affected, count(*) FILTER (warning) AS defect_events,
  count(DISTINCT unit_id) FILTER (warning) AS units_affected, round_even(max(risk_percent) FILTER (warning), 1) AS peak_risk_percent,
  {PCT.format(t='sum(state_confidence)', n='count(state_confidence)')} AS avg_confidence_percent
FROM dp GROUP BY station_id HAVING count(*) FILTER (warning) > 0"""))
def defect_concentration(spark, d):
    return ru.defect_concentration(b.defect_predictions(spark, d))


@query("observability", with_ctes("bp dp stations", f"""
SELECT *, CAST((total_stations - coverage_none) / total_stations::DOUBLE AS DOUBLE) AS instrumented_fraction FROM (
SELECT (SELECT count(*) FROM stations) AS total_stations, (SELECT count(*) FROM stations WHERE is_dark) AS dark_zone_stations,
  (SELECT count(*) FROM stations WHERE sensor_coverage = 'HIGH') AS coverage_high, (SELECT count(*) FROM stations WHERE sensor_coverage = 'PARTIAL') AS coverage_partial,
  (SELECT count(*) FROM stations WHERE sensor_coverage = 'NONE') AS coverage_none,
  (SELECT {PCT.format(t='sum(state_confidence)', n='count(state_confidence)')} FROM bp) AS bottleneck_confidence_percent,
  (SELECT {PCT.format(t='sum(state_confidence)', n='count(state_confidence)')} FROM dp) AS defect_confidence_percent,
  (SELECT count(*) FROM bp WHERE state_confidence < 0.75) + (SELECT count(*) FROM dp WHERE state_confidence < 0.75) AS low_confidence_predictions,
  (SELECT count(*) FROM bp WHERE zone = 'DARK') + (SELECT count(*) FROM dp WHERE route LIKE 'DARK%') AS dark_inferred_predictions,
  (SELECT count(*) FROM health WHERE status <> 'PASS') AS degraded_runs, (SELECT count(*) FROM health) AS runs_in_scope,
  (SELECT count(*) FROM health WHERE bottleneck_status <> 'PASS') AS bottleneck_issue_runs, (SELECT count(*) FROM health WHERE defect_status <> 'PASS') AS defect_issue_runs)""", **HEALTH))
def observability(spark, d):
    return ru.observability(b.stations(spark, d), b.bottleneck_predictions(spark, d), b.defect_predictions(spark, d), _health(spark, d))


A = ru.Assumptions()
ECON = {
    **FB, **HEALTH,
    "du": "SELECT run_id, unit_id, station_id, count(*) FILTER (warning) AS w FROM dp GROUP BY ALL",
    "by_day": """
  SELECT h.production_day, h.run_id, CAST(coalesce(h.units_created, u.n) AS BIGINT) AS units, CAST(a.x AS BIGINT) AS maintenance_alarms, u.bad AS defective_units
  FROM health h JOIN (SELECT run_id, sum(threshold_crossings) AS x FROM an_bp GROUP BY 1) a ON a.run_id = h.run_id
  JOIN (SELECT run_id, count(*) AS n, count(*) FILTER (w > 0) AS bad FROM (SELECT run_id, unit_id, sum(w) AS w FROM du GROUP BY ALL) GROUP BY 1) u ON u.run_id = h.run_id""",
    "by_station": """
  SELECT a.station_id, a.x AS alarms, u.units, u.defect_events, u.defect_units
  FROM (SELECT station_id, CAST(sum(threshold_crossings) AS BIGINT) AS x FROM an_bp GROUP BY 1) a
  JOIN (SELECT station_id, count(*) AS units, CAST(sum(w) AS BIGINT) AS defect_events, count(DISTINCT unit_id) FILTER (w > 0) AS defect_units FROM du GROUP BY 1) u ON u.station_id = a.station_id""",
    "tot": """
  SELECT count(*) AS days, CAST(sum(units) AS BIGINT) AS units, CAST(sum(maintenance_alarms) AS BIGINT) AS alarms, CAST(sum(defective_units) AS BIGINT) AS bad,
    (SELECT CAST(sum(units) AS BIGINT) FROM by_station) AS station_units FROM by_day""",
    "ov": """
  SELECT days, units * 1200.0::DOUBLE AS revenue, alarms * 400.0::DOUBLE AS maintenance_cost, 0.0::DOUBLE AS downtime_cost, bad * 750.0::DOUBLE AS defect_loss,
    units * 1200.0::DOUBLE - (alarms * 400.0::DOUBLE + bad * 750.0::DOUBLE) AS profit, alarms * 400.0::DOUBLE + bad * 750.0::DOUBLE AS avoidable_loss FROM tot""",
    "se_": """
  SELECT station_id AS station, round(tot.units * 1200.0::DOUBLE * s.units / station_units, 2) AS revenue_contribution, s.alarms AS maintenance_alarm_count,
    s.alarms * 400.0::DOUBLE AS estimated_maintenance_cost, round(tot.units * 1200.0::DOUBLE * s.units / station_units - s.alarms * 400.0::DOUBLE, 2) AS net_modeled_contribution
  FROM by_station s, tot""",
    "ql": "SELECT station_id AS station, defect_events, defect_units AS units_affected, defect_units * 750.0::DOUBLE AS estimated_defect_loss FROM by_station WHERE defect_units > 0",
}


def _econ(name: str, body: str):
    return query(name, with_ctes("bp dp", body, **ECON))


def by_day(spark, d):
    """One row per run: cut here because several reports read it and each would rescan the streams."""
    return cut_lineage(_by_day(spark, d))


def by_station(spark, d):
    return cut_lineage(_by_station(spark, d))


def _by_day(spark, d):
    return ru.observe_by_day(b.bottleneck_predictions(spark, d), b.defect_predictions(spark, d), _health(spark, d))


def _by_station(spark, d):
    return ru.observe_by_station(b.bottleneck_predictions(spark, d), b.defect_predictions(spark, d))


@_econ("observe_economics_by_day", "SELECT * FROM by_day")
def observe_economics_by_day(spark, d):
    return _by_day(spark, d)


@_econ("observe_economics_by_station", "SELECT * FROM by_station")
def observe_economics_by_station(spark, d):
    return _by_station(spark, d)


@_econ("financial_overview", "SELECT * FROM ov")
def financial_overview(spark, d):
    return ru.financial_overview(by_day(spark, d), by_station(spark, d), A)


@_econ("station_economics", "SELECT * FROM se_")
def station_economics(spark, d):
    return ru.station_economics(by_day(spark, d), by_station(spark, d), A)


@_econ("quality_loss", "SELECT * FROM ql")
def quality_loss(spark, d):
    return ru.quality_loss(_by_station(spark, d), A)


@_econ("profit_trend", """SELECT production_day, run_id, units * 1200.0::DOUBLE AS modeled_revenue, maintenance_alarms * 400.0::DOUBLE + defective_units * 750.0::DOUBLE AS modeled_cost,
  units * 1200.0::DOUBLE - maintenance_alarms * 400.0::DOUBLE - defective_units * 750.0::DOUBLE AS estimated_profit FROM by_day""")
def profit_trend(spark, d):
    return ru.profit_trend(_by_day(spark, d), A)


@_econ("scenario_savings", """SELECT r::DOUBLE AS reduction, CAST(CAST(round(r * 100) AS INTEGER) AS VARCHAR) || '% fewer avoidable alarms / defect losses' AS label,
  round(avoidable_loss * r::DOUBLE, 2) AS modeled_saving, round(profit + avoidable_loss * r::DOUBLE, 2) AS modeled_profit_after FROM ov, (SELECT unnest([0.1, 0.2, 0.3]) AS r)""")
def scenario_savings(spark, d):
    return ru.scenario_savings(ru.financial_overview(by_day(spark, d), by_station(spark, d), A))


@_econ("headline_messages", """
SELECT * FROM (SELECT 1 AS position, 'Maintenance cost concentrates at ' || station || ': ' || maintenance_alarm_count || ' modeled alarm(s), ~$' || format('{:,}', CAST(estimated_maintenance_cost AS BIGINT)) || '.' AS message
  FROM se_ ORDER BY estimated_maintenance_cost DESC, net_modeled_contribution, station DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 2, 'Quality loss concentrates at ' || station || ': ' || units_affected || ' unit(s) flagged over ' || defect_events || ' event(s), ~$' || format('{:,}', CAST(estimated_defect_loss AS BIGINT)) || '.'
  FROM ql ORDER BY estimated_defect_loss DESC, station DESC LIMIT 1)
UNION ALL SELECT 3, 'Modeled avoidable loss is ~$' || format('{:,}', CAST(avoidable_loss AS BIGINT)) || ' (' || format('{:.1f}', 100 * avoidable_loss / revenue) || '% of modeled revenue) across ' || days || ' production day(s).' FROM ov""")
def headline_messages(spark, d):
    dd, ss = by_day(spark, d), by_station(spark, d)
    return ru.headline_messages(ru.station_economics(dd, ss, A), ru.quality_loss(ss, A), ru.financial_overview(dd, ss, A), A)


@query("scope_filter", with_ctes("runs", """
SELECT 'All Runs' AS choice, run_id FROM runs UNION ALL SELECT 'Production Day 7', run_id FROM runs WHERE production_day = 7
UNION ALL SELECT 'Production Day 99', arg_max(run_id, production_day) FROM runs UNION ALL SELECT 'Current Run', arg_max(run_id, production_day) FROM runs"""))
def scope_filter(spark, d):
    r = b.runs(spark, d)
    return sel.concat_runs([ru.scope_filter(r, c).select(F.lit(c).alias("choice"), "run_id")
                            for c in ("All Runs", "Production Day 7", "Production Day 99", "Current Run")])


@query("ingest_run_history", with_ctes("bp dp", """
SELECT run_id, CAST(row_number() OVER (ORDER BY completed_at, run_id) AS INTEGER) AS production_day,
  CASE WHEN status <> 'PASS' THEN CASE WHEN status = 'DEGRADED' THEN 'PARTIAL' ELSE 'FAILED' END WHEN hb <> hd THEN 'PARTIAL' ELSE 'COMPLETED' END AS run_status,
  completed_at, hb AS has_bottleneck, hd AS has_defect
FROM (SELECT h.run_id, h.status, max(p.timestamp_ms) AS completed_at, true AS hb, bool_or(p.station_index = 3 AND p.probability > 0.9) AS hd, count(*) AS n
  FROM health h JOIN bp p ON p.run_id = h.run_id GROUP BY ALL) WHERE n % 5 <> 0""", **HEALTH))
def ingest_run_history(spark, d):
    p = b.bottleneck_predictions(spark, d)
    s = p.groupBy("run_id").agg(F.lit(True).alias("has_bottleneck"), F.bool_or((F.col("station_index") == 3) & (F.col("probability") > 0.9)).alias("has_defect"),
                                F.max("timestamp_ms").alias("completed_at"), (F.count(F.lit(1)) % 5 != 0).alias("complete"))
    return ru.ingest_run_history(s.select("run_id", "complete", "completed_at"), s.select("run_id", "has_bottleneck", "has_defect"), _health(spark, d))


@query("system_status", with_ctes("line_log", """
SELECT run_id, CASE WHEN bc = 0 AND dc = 0 THEN 'PASS' WHEN bc = 0 OR dc = 0 THEN 'DEGRADED' ELSE 'FAILED' END AS overall_status,
  CASE WHEN bc = 0 THEN 'PASS' ELSE 'FAILED_ISOLATED' END AS bottleneck_status, CASE WHEN dc = 0 THEN 'PASS' ELSE 'FAILED_ISOLATED' END AS defect_status
FROM (SELECT run_id, count(*) % 2 AS bc, count(*) % 3 AS dc FROM line_log GROUP BY run_id)"""))
def system_status(spark, d):
    o = b.line_log(spark, d).groupBy("run_id").agg((F.count(F.lit(1)) % 2).alias("bottleneck_code"), (F.count(F.lit(1)) % 3).alias("defect_code"))
    return ru.system_status(o)


@query("stream_summary", with_ctes("dp", """
SELECT run_id, count(*) AS record_count, count(*) FILTER (warning) AS warning_count, count(*) FILTER (threshold_crossed) AS crossed_count,
  min(timestamp_ms) AS first_timestamp_ms, max(timestamp_ms) AS last_timestamp_ms, count(DISTINCT station_id) AS stations, count(DISTINCT unit_id) AS units,
  false AS unknown_categories_seen FROM dp GROUP BY run_id"""))
def stream_summary(spark, d):
    return ag.stream_summary(b.defect_predictions(spark, d))


@query("category_counts", with_ctes("bp", """
SELECT run_id, 'route' AS category, route AS value, count(*) AS n FROM bp GROUP BY ALL UNION ALL SELECT run_id, 'zone', zone, count(*) FROM bp GROUP BY ALL"""))
def category_counts(spark, d):
    return ag.category_counts(b.bottleneck_predictions(spark, d))


@query("latest_at_or_before", with_ctes("bp", """
SELECT t.run_id, t.station_id, t.display_ms, p.emission, round(p.probability, 6) AS probability, p.warning
FROM (SELECT DISTINCT run_id, station_id, unnest(range(900000, 7200001, 900000)) AS display_ms FROM bp) t
ASOF JOIN (SELECT * FROM bp QUALIFY row_number() OVER (PARTITION BY run_id, station_id, timestamp_ms ORDER BY emission DESC) = 1) p
  ON p.run_id = t.run_id AND p.station_id = t.station_id AND t.display_ms >= p.timestamp_ms"""))
def latest_at_or_before(spark, d):
    p = b.bottleneck_predictions(spark, d).select("run_id", "station_id", "timestamp_ms", "emission", "probability", "warning")
    t = p.select("run_id", "station_id").distinct().withColumn("display_ms", F.explode(F.sequence(
        F.lit(900000).cast("long"), F.lit(7200000).cast("long"), F.lit(900000).cast("long"))))
    return rounded(at_or_before(p, t, "station_id", ["emission", "probability", "warning"]), default=6)
