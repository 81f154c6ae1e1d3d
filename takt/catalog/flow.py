"""Registered queries over station events: windows, flow features, labels."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded, rounded_sql
from takt.catalog.sql import with_ctes
from takt.contracts import FLOW_FEATURES, FLOW_META
from takt.operators import aggregate as ag
from takt.plans import station_flow as sf

QUERIES, ORACLE, query = registry()
M = 4_194_304
_STATS_CTES = {
    "numbered": f"""
  SELECT *, timestamp_ms * {M} + row_number() OVER (PARTITION BY run_id, station_id ORDER BY timestamp_ms, event_sequence) AS o,
    row_number() OVER (PARTITION BY run_id, station_id ORDER BY timestamp_ms, event_sequence) AS rn,
    CASE WHEN queue_length_after IS NOT NULL AND row_number() OVER (PARTITION BY run_id, station_id, timestamp_ms
      ORDER BY (queue_length_after IS NULL), event_sequence) = 1 THEN 1 ELSE 0 END AS first_ts,
    queue_length_after AS q, cycle_time_ms AS c FROM ev""",
    "framed": f"""
  SELECT run_id, station_id, timestamp_ms AS ts, event_sequence AS seq, q, rn,
    max(timestamp_ms) OVER (PARTITION BY run_id, station_id) AS station_last_ts,
    max(q) OVER (PARTITION BY run_id, station_id ORDER BY timestamp_ms RANGE BETWEEN 1 FOLLOWING AND 1800000 FOLLOWING) AS future_max,
    last_value(q IGNORE NULLS) OVER u AS carry_q,
    last_value(CASE WHEN q IS NOT NULL THEN timestamp_ms END IGNORE NULLS) OVER u AS carry_ts,
    rn - last_value(CASE WHEN q IS NOT NULL THEN rn END IGNORE NULLS) OVER u AS carry_steps,
    avg(q) OVER r AS queue_mean, stddev_samp(q) OVER r AS queue_std, max(q) OVER r AS queue_max,
    avg(c) OVER r AS cycle_mean, stddev_samp(c) OVER r AS cycle_std, max(c) OVER r AS cycle_max,
    coalesce(sum(CASE WHEN event_type = 'UNIT_ARRIVED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER r, 0) AS arrivals,
    coalesce(sum(CASE WHEN event_type = 'PROCESSING_COMPLETED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER r, 0) AS services,
    avg(q) OVER p AS prev_queue_mean,
    coalesce(sum(CASE WHEN event_type = 'UNIT_ARRIVED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER p, 0) AS prev_arrivals,
    coalesce(sum(CASE WHEN event_type = 'PROCESSING_COMPLETED' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER p, 0) AS prev_services,
    sum(first_ts) OVER r AS n_times, count(q) OVER r AS nq,
    regr_slope(q, timestamp_ms::DOUBLE) OVER r AS raw_slope, regr_sxx(q, timestamp_ms::DOUBLE) OVER r AS sxx,
    regr_syy(q, timestamp_ms::DOUBLE) OVER r AS syy, regr_sxy(q, timestamp_ms::DOUBLE) OVER r AS sxy
  FROM numbered
  WINDOW u AS (PARTITION BY run_id, station_id ORDER BY timestamp_ms, event_sequence ROWS UNBOUNDED PRECEDING),
    r AS (PARTITION BY run_id, station_id ORDER BY o RANGE BETWEEN {600000 * M + M - 1} PRECEDING AND CURRENT ROW),
    p AS (PARTITION BY run_id, station_id ORDER BY o RANGE BETWEEN {1200000 * M + M - 1} PRECEDING AND {600000 * M + M} PRECEDING)""",
    "stats": """
  SELECT *, coalesce(carry_q, 0.0) AS occupancy, CASE WHEN n_times > 1 THEN raw_slope END AS slope,
    CASE WHEN n_times >= 3 AND nq > 2 AND sxx > 0
      THEN sqrt(greatest(0, syy - sxy * sxy / sxx) / (nq - 2) / sxx) END AS slope_se FROM framed""",
}
_FEATURES = """
  SELECT s.run_id, s.station_id AS station_id_buffer_id, ts AS prediction_time, seq AS prediction_event_sequence,
    cap AS capacity, occupancy >= cap AS currently_at_capacity,
    CASE WHEN occupancy >= cap THEN 'already_full' WHEN station_last_ts >= ts + 1800000 THEN 'eligible' ELSE 'censored' END
      AS target_eligibility_status,
    cap - occupancy AS capacity_headroom, s.station_id, base_cycle_time_ms, archetype AS station_archetype,
    cycle_time_std_ms AS configured_cycle_std_ms, station_index, cap AS buffer_capacity,
    station_index / 11.0::DOUBLE AS line_fraction, queue_max AS queue_max_10m, queue_mean AS queue_mean_10m,
    occupancy AS current_occupancy, queue_std AS queue_std_10m,
    CASE WHEN cap <> 0 THEN occupancy / cap END AS capacity_utilization,
    prev_arrivals / 10::DOUBLE AS arrival_rate_per_min_prev10m, prev_services / 10::DOUBLE AS service_rate_per_min_prev10m,
    services / 10::DOUBLE AS service_rate_per_min_10m, arrivals / 10::DOUBLE AS arrival_rate_per_min_10m,
    1 - CASE WHEN cap <> 0 THEN occupancy / cap END AS utilization_headroom, cycle_max AS cycle_max_10m,
    (arrivals - services)::DOUBLE AS flow_pressure_10m, queue_mean - prev_queue_mean AS queue_delta_10m,
    cycle_mean AS cycle_mean_10m, slope AS queue_slope_10m, (arrivals - services) / 10::DOUBLE AS net_flow_rate_10m,
    cycle_std AS cycle_std_10m,
    CASE WHEN q IS NOT NULL THEN 1.0 WHEN carry_ts IS NULL THEN 0.0 ELSE exp(-(ts - carry_ts) / 600000.0::DOUBLE) END AS state_confidence,
    pstd AS progress_std,
    CASE WHEN slope > 0 THEN sqrt(((cap - occupancy) / (slope * slope)) ** 2 * slope_se ** 2 + (1 / slope) ** 2 * pstd ** 2) END AS eta_std,
    CASE WHEN occupancy < cap AND station_last_ts >= ts + 1800000 THEN CASE WHEN coalesce(future_max >= cap, false) THEN 1 ELSE 0 END END AS y_bottleneck
  FROM (SELECT *, CASE WHEN q IS NOT NULL THEN 0.0 WHEN carry_ts IS NULL THEN NULL ELSE queue_std * sqrt(carry_steps) END AS pstd
        FROM stats) s
  JOIN (SELECT *, buffer_capacity::DOUBLE AS cap FROM stations) d USING (run_id, station_id)"""
_DOUBLES = {"capacity", "capacity_headroom", "buffer_capacity", "line_fraction", "queue_max_10m", "queue_mean_10m",
            "current_occupancy", "queue_std_10m", "capacity_utilization", "arrival_rate_per_min_prev10m",
            "service_rate_per_min_prev10m", "service_rate_per_min_10m", "arrival_rate_per_min_10m",
            "utilization_headroom", "cycle_max_10m", "flow_pressure_10m", "queue_delta_10m", "cycle_mean_10m",
            "queue_slope_10m", "net_flow_rate_10m", "cycle_std_10m", "state_confidence", "progress_std", "eta_std"}
# digits kept before comparing engines; slopes are queue units per millisecond, eta in milliseconds
_DIGITS = {"queue_slope_10m": 9, "eta_std": 1, "slope": 9, "slope_se": 9}


@query("bottleneck_features", with_ctes(
    "ev stations", f"SELECT {rounded_sql(FLOW_META + FLOW_FEATURES + ['y_bottleneck'], _DOUBLES, _DIGITS)} FROM f",
    **_STATS_CTES, f=_FEATURES))
def bottleneck_features(spark, d):
    return rounded(sf.flow_features(b.station_events(spark, d), b.stations(spark, d)), _DIGITS)


_LABEL = with_ctes("ev stations", """
SELECT station_id, target_eligibility_status, CAST(count(*) AS BIGINT) AS n_rows,
  CAST(sum(coalesce(y_bottleneck, 0)) AS BIGINT) AS positives, CAST(count(y_bottleneck) AS BIGINT) AS labelled
FROM f GROUP BY ALL""", **_STATS_CTES, f=_FEATURES)


@query("bottleneck_label", _LABEL)
def bottleneck_label(spark, d):
    f = sf.flow_features(b.station_events(spark, d), b.stations(spark, d))
    return f.groupBy("station_id", "target_eligibility_status").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.coalesce("y_bottleneck", F.lit(0))).alias("positives"),
        F.count("y_bottleneck").alias("labelled"))


@query("station_risk_board", with_ctes("ev stations", """
SELECT station_id, CAST(count(*) AS BIGINT) AS n_events, round(avg(capacity_utilization), 6) AS mean_utilization,
  round(avg(y_bottleneck), 6) AS overflow_rate, CAST(count(y_bottleneck) AS BIGINT) AS labelled
FROM f GROUP BY station_id""", **_STATS_CTES, f=_FEATURES))
def station_risk_board(spark, d):
    f = sf.flow_features(b.station_events(spark, d), b.stations(spark, d))
    return f.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.avg("capacity_utilization"), 6).alias("mean_utilization"),
        F.round(F.avg("y_bottleneck"), 6).alias("overflow_rate"), F.count("y_bottleneck").alias("labelled"))


def _stats(spark, d, cols, digits=None):
    return rounded(sf.window_stats(b.station_events(spark, d)).select("run_id", "station_id", "ts", "seq", *cols), digits)


def _stats_sql(cols, doubles=None, digits=None):
    keys = ["run_id", "station_id", "ts", "seq"]
    return with_ctes("ev", f"SELECT {rounded_sql(keys + cols, set(cols) if doubles is None else doubles, digits)} FROM stats",
                     **_STATS_CTES)


_RECENT = ["queue_mean", "queue_std", "queue_max", "cycle_mean", "cycle_std", "cycle_max"]


@query("recent_stats", _stats_sql(_RECENT))
def recent_stats(spark, d):
    return _stats(spark, d, _RECENT)


@query("previous_stats", _stats_sql(["prev_queue_mean", "prev_arrivals", "prev_services"]))
def previous_stats(spark, d):
    return _stats(spark, d, ["prev_queue_mean", "prev_arrivals", "prev_services"])


@query("carry_forward", _stats_sql(["occupancy", "carry_ts", "carry_steps"], {"occupancy"}))
def carry_forward(spark, d):
    return _stats(spark, d, ["occupancy", "carry_ts", "carry_steps"])


@query("flow_rates", with_ctes("ev", """
SELECT run_id, station_id, ts, seq, round(arrivals / 10::DOUBLE, 5) AS arrival_rate, round(services / 10::DOUBLE, 5) AS service_rate,
  round(prev_arrivals / 10::DOUBLE, 5) AS prev_arrival_rate, round(prev_services / 10::DOUBLE, 5) AS prev_service_rate,
  (arrivals - services)::DOUBLE AS pressure, round((arrivals - services) / 10::DOUBLE, 5) AS net_rate FROM stats""", **_STATS_CTES))
def flow_rates(spark, d):
    s = sf.window_stats(b.station_events(spark, d))
    return rounded(s.select(
        "run_id", "station_id", "ts", "seq", (F.col("arrivals") / 10).alias("arrival_rate"),
        (F.col("services") / 10).alias("service_rate"), (F.col("prev_arrivals") / 10).alias("prev_arrival_rate"),
        (F.col("prev_services") / 10).alias("prev_service_rate"),
        (F.col("arrivals") - F.col("services")).alias("pressure"),
        ((F.col("arrivals") - F.col("services")) / 10).alias("net_rate")))


@query("queue_slope", _stats_sql(["slope", "slope_se"], None, _DIGITS))
def queue_slope(spark, d):
    return _stats(spark, d, ["slope", "slope_se"], _DIGITS)


@query("future_max", _stats_sql(["future_max"]))
def future_max(spark, d):
    return _stats(spark, d, ["future_max"])


_EVENTS, _STATIONS, _RECENT_WIN, _BEFORE = "station_events", "stations", "[t - 10 min, t]", "[t - 20 min, t - 10 min)"
# feature, source, definition, window: what each value is made of
FLOW_PROVENANCE = [
    ("capacity_headroom", _EVENTS, "buffer capacity less occupancy", "up to t"),
    ("station_id", _EVENTS, "the station of the event", "t"),
    ("base_cycle_time_ms", _STATIONS, "configured mean cycle", "run"),
    ("station_archetype", _STATIONS, "configured kind of station", "run"),
    ("configured_cycle_std_ms", _STATIONS, "configured spread of the cycle", "run"),
    ("station_index", _STATIONS, "place on the line from 0", "run"),
    ("buffer_capacity", _STATIONS, "configured buffer places", "run"),
    ("line_fraction", _STATIONS, "station index over the last index", "run"),
    ("queue_max_10m", _EVENTS, "largest queue length", _RECENT_WIN),
    ("queue_mean_10m", _EVENTS, "mean queue length", _RECENT_WIN),
    ("current_occupancy", _EVENTS, "last known queue length, 0 if none", "up to t"),
    ("queue_std_10m", _EVENTS, "sample spread of queue lengths", _RECENT_WIN),
    ("capacity_utilization", _EVENTS, "occupancy over capacity", "up to t"),
    ("arrival_rate_per_min_prev10m", _EVENTS, "arrivals over ten minutes", _BEFORE),
    ("service_rate_per_min_prev10m", _EVENTS, "completions over ten minutes", _BEFORE),
    ("service_rate_per_min_10m", _EVENTS, "completions over ten minutes", _RECENT_WIN),
    ("arrival_rate_per_min_10m", _EVENTS, "arrivals over ten minutes", _RECENT_WIN),
    ("utilization_headroom", _EVENTS, "one less utilization", "up to t"),
    ("cycle_max_10m", _EVENTS, "longest cycle", _RECENT_WIN),
    ("flow_pressure_10m", _EVENTS, "arrivals less completions", _RECENT_WIN),
    ("queue_delta_10m", _EVENTS, "mean queue length less that of the window before", "[t - 20 min, t]"),
    ("cycle_mean_10m", _EVENTS, "mean cycle", _RECENT_WIN),
    ("queue_slope_10m", _EVENTS, "least-squares slope of queue length over time, from two instants on", _RECENT_WIN),
    ("net_flow_rate_10m", _EVENTS, "arrivals less completions over ten minutes", _RECENT_WIN),
    ("cycle_std_10m", _EVENTS, "sample spread of cycles", _RECENT_WIN),
    ("state_confidence", _EVENTS, "1 if the queue is seen now, else exp(-age / 10 min) of the last time, 0 if never", "up to t"),
    ("progress_std", _EVENTS, "0 if the queue is seen now, else its spread times the root of the events since", _RECENT_WIN),
    ("eta_std", _EVENTS, "spread of the time to a full buffer, from those of slope and state, where the slope is positive", _RECENT_WIN),
]


@query("flow_feature_provenance", with_ctes("ev stations", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{source}' AS source, '{text}' AS definition, '{window}' AS \"window\", true AS present, round(avg(CASE WHEN {f} IS NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS null_rate FROM f"
    for f, source, text, window in FLOW_PROVENANCE), **_STATS_CTES, f=_FEATURES))
def flow_feature_provenance(spark, d):
    """Definition rows of all frozen columns beside the share of rows in which each has no value."""
    if [r[0] for r in FLOW_PROVENANCE] != FLOW_FEATURES:
        raise ValueError("provenance rows and the feature contract differ")
    p = spark.createDataFrame(FLOW_PROVENANCE, "feature string, source string, definition string, window string")
    f = sf.flow_features(b.station_events(spark, d), b.stations(spark, d))
    return rounded(p.join(ag.feature_quality(f, FLOW_FEATURES).select("feature", "present", "null_rate"), "feature", "left"), default=6)
