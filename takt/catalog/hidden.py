"""Registered queries over hidden stations: histories, priors, occupancy."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded
from takt.catalog.quality import FIFO
from takt.catalog.sql import with_ctes
from takt.operators import aggregate as ag
from takt.operators import calibrate as ca
from takt.operators import joins as jn
from takt.operators import occupancy as oc
from takt.operators import windows as wn
from takt.plans.dark_flow import dark_features as dark_columns
from takt.session import cut_lineage

QUERIES, ORACLE, query = registry()
DARK = ["S04", "S05", "S06"]
K = 200  # draws a passage in the registered queries, as the library's default


def _dark(spark, d):
    return b.stations(spark, d).filter("is_dark")


@query("dwell_history", with_ctes("ev units", """
SELECT i.run_id, i.unit_id, i.station_id, processing_start AS entry_ts, processing_end AS exit_ts, u.vehicle_model AS variant, (processing_end - processing_start) / 1000.0::DOUBLE AS dwell_s
FROM intervals i JOIN units u ON u.run_id = i.run_id AND u.unit_id = i.unit_id WHERE i.station_id IN ('S04', 'S05', 'S06')""", **FIFO))
def dwell_history(spark, d):
    return ca.dwell_history(b.station_events(spark, d), b.units(spark, d), _dark(spark, d))


def _corridor(spark, d):
    return _dark(spark, d).select("run_id", "station_id", (F.col("station_id") == "S04").alias("is_first"), (F.col("station_id") == "S06").alias("is_last"),
                                  F.lit("S03").alias("upstream_station"))


def residence(spark, d, counted: bool = False):
    return ca.corridor_residence(b.station_events(spark, d), b.units(spark, d), _corridor(spark, d), counted)


_RES = {
    "cand": """
  SELECT run_id, unit_id, timestamp_ms, CASE WHEN station_id = 'S03' AND event_type = 'PROCESSING_COMPLETED' THEN 0
    WHEN station_id = 'S04' AND event_type = 'UNIT_ARRIVED' THEN 1 WHEN station_id = 'S04' AND event_type = 'PROCESSING_STARTED' THEN 2 END AS src FROM ev""",
    "ent": "SELECT * FROM cand WHERE src IS NOT NULL QUALIFY src = min(src) OVER (PARTITION BY run_id)",
    "psg": """
  SELECT e.run_id, e.unit_id, e.timestamp_ms AS t0, x.timestamp_ms AS t1 FROM ent e JOIN ev x ON x.run_id = e.run_id AND x.unit_id = e.unit_id
  WHERE x.station_id = 'S06' AND x.event_type = 'PROCESSING_COMPLETED' AND x.timestamp_ms > e.timestamp_ms""",
    "ld": """
  SELECT run_id, unit_id, arg_max(load, t0 * 10000000 + t1) AS load FROM (SELECT p.*,
    (SELECT count(*) FROM psg q WHERE q.run_id = p.run_id AND q.t0 < p.t0) - (SELECT count(*) FROM psg q WHERE q.run_id = p.run_id AND q.t1 < p.t0) AS load FROM psg p) GROUP BY ALL""",
}


@query("corridor_residence", with_ctes("ev units", """
SELECT s.run_id, s.unit_id, s.station_id, u.vehicle_model AS variant, s.t AS entry_ts, x.timestamp_ms AS exit_ts, ld.load AS corridor_load, s.station_id = 'S04' AS is_first,
  list_extract(['upstream_completed', 'first_arrived', 'first_started'], m.src + 1) AS boundary_source, (x.timestamp_ms - s.t) / 1000.0::DOUBLE AS dwell_s
FROM (SELECT run_id, unit_id, timestamp_ms AS t, 'S04' AS station_id FROM ent
  UNION ALL SELECT run_id, unit_id, timestamp_ms, station_id FROM ev WHERE event_type = 'UNIT_ARRIVED' AND station_id IN ('S05', 'S06')) s
JOIN ev x ON x.run_id = s.run_id AND x.unit_id = s.unit_id AND x.station_id = s.station_id AND x.event_type = 'PROCESSING_COMPLETED' AND x.timestamp_ms > s.t
JOIN ld ON ld.run_id = s.run_id AND ld.unit_id = s.unit_id JOIN units u ON u.run_id = s.run_id AND u.unit_id = s.unit_id
JOIN (SELECT DISTINCT run_id, src FROM ent) m ON m.run_id = s.run_id""", **_RES))
def corridor_residence(spark, d):
    return residence(spark, d)


def _edges(spark, d):
    """Zone entries and exits of the binding: arrivals at the first hidden and at the first visible station after it."""
    e = b.station_events(spark, d).filter("event_type = 'UNIT_ARRIVED'").withColumn("zone_id", F.lit("DZ01"))
    return e.filter("station_index = 3"), e.filter("station_index = 6")


def _newton_sql(source: str, steps: int = 6) -> dict[str, str]:
    """CTEs g0 .. g<steps>: the maximum-likelihood gamma shape k of rows with mean and ml (mean logarithm)."""
    digamma = "(ln(k + 6) - 1 / (2 * (k + 6)) - i2 * (1 / 12.0::DOUBLE - i2 * (1 / 120.0::DOUBLE - i2 * (1 / 252.0::DOUBLE - i2 / 240))) - (" + " + ".join(
        f"1 / (k + {j})" for j in range(6)) + "))"
    trigamma = "(1 / (k + 6) + i2 / 2 + i2 / (k + 6) * (1 / 6.0::DOUBLE - i2 * (1 / 30.0::DOUBLE - i2 * (1 / 42.0::DOUBLE - i2 / 30))) + (" + " + ".join(
        f"1 / ((k + {j}) * (k + {j}))" for j in range(6)) + "))"
    ctes = {"g0": f"SELECT *, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS k FROM (SELECT *, ln(mean) - ml AS s FROM {source}) WHERE s > 1e-9"}
    for n in range(steps):
        ctes[f"g{n + 1}"] = (f"SELECT * REPLACE (greatest(1e-6::DOUBLE, k - (ln(k) - {digamma} - s) / (1 / k - {trigamma})) AS k) "
                             f"FROM (SELECT *, 1 / ((k + 6) * (k + 6)) AS i2 FROM g{n}{'' if not n else ' '})".replace("SELECT *, 1", "SELECT * EXCLUDE (i2), 1" if n else "SELECT *, 1"))
    return ctes


@query("fit_dwell", with_ctes("ev units", """
SELECT w.station_id, w.variant, CASE WHEN o.k IS NOT NULL THEN o.n ELSE p.n END AS n, round(CASE WHEN o.k IS NOT NULL THEN o.mean ELSE p.mean END, 5) AS mean,
  round(coalesce(o.k, p.k), 5) AS shape, round(CASE WHEN o.k IS NOT NULL THEN o.mean / o.k ELSE p.mean / p.k END, 5) AS scale, o.k IS NULL AS fallback
FROM (SELECT DISTINCT station_id, variant FROM fitted WHERE lv = 0) w LEFT JOIN (SELECT * FROM g6 WHERE lv = 0 AND n >= 30) o ON o.station_id = w.station_id AND o.variant = w.variant
LEFT JOIN (SELECT * FROM g6 WHERE lv = 1 AND n >= 8) p ON p.station_id = w.station_id WHERE coalesce(o.k, p.k) IS NOT NULL""",
    **FIFO, dw="""
  SELECT i.station_id, u.vehicle_model AS variant, (processing_end - processing_start) / 1000.0::DOUBLE AS x
  FROM intervals i JOIN units u ON u.run_id = i.run_id AND u.unit_id = i.unit_id WHERE i.station_id IN ('S04', 'S05', 'S06')""",
    lv="SELECT 0 AS lv, * FROM dw UNION ALL SELECT 1, station_id, '', x FROM dw",
    md="SELECT *, count(*) OVER w AS size, median(x) OVER w AS med FROM lv WINDOW w AS (PARTITION BY lv, station_id, variant)",
    mad="SELECT *, 1.4826::DOUBLE * median(abs(x - med)) OVER (PARTITION BY lv, station_id, variant) AS mad FROM md",
    fitted="SELECT lv, station_id, variant, count(*) AS n, avg(x) AS mean, avg(ln(x)) AS ml FROM mad WHERE size < 8 OR mad = 0 OR abs(x - med) / mad < 3.5 GROUP BY ALL",
    **_newton_sql("fitted")))
def fit_dwell(spark, d):
    return rounded(ca.fit_dwell(dwell_history(spark, d)))


@query("fit_residence_by_load")
def fit_residence_by_load(spark, d):
    return rounded(ca.fit_residence_by_load(residence(spark, d, counted=True)))


@query("prior_from_config", with_ctes("stations", """
SELECT *, round((mean / std) ** 2, 5) AS shape, round(std * std / mean, 5) AS scale FROM (
  SELECT run_id, station_id, base_cycle_time_ms / 1000.0::DOUBLE AS mean, cycle_time_std_ms / 1000.0::DOUBLE AS std FROM stations
  UNION ALL SELECT run_id, '__GLOBAL__', avg(base_cycle_time_ms / 1000.0::DOUBLE), avg(cycle_time_std_ms / 1000.0::DOUBLE) FROM stations GROUP BY run_id)"""))
def prior_from_config(spark, d):
    return rounded(ca.prior_from_config(b.stations(spark, d)))


def passages(spark, d):
    """Zone passages written out once: every estimate below reads them several times."""
    return cut_lineage(_passages(spark, d))


def _passages(spark, d):
    """First-in first-out passages of the hidden zone; a unit still inside has no exit."""
    a, z = _edges(spark, d)
    e = a.withColumn("event_type", F.lit("IN")).unionByName(z.withColumn("event_type", F.lit("OUT"))).withColumn("station_id", F.col("zone_id"))
    iv, _ = jn.pair_fifo(e, start="IN", end="OUT", keep_open=True)
    return iv.select("run_id", F.col("station_id").alias("zone_id"), "unit_id", F.col("processing_start").alias("entry_ts"), F.col("processing_end").alias("exit_ts"))


_PASS = {
    "pr": """
  SELECT run_id, unit_id, timestamp_ms, event_sequence, CASE WHEN station_index = 3 THEN 1 ELSE 0 END AS is_start, 'DZ01' AS station_id, 0 AS station_index
  FROM ev WHERE event_type = 'UNIT_ARRIVED' AND station_index IN (3, 6)""",
    **{k: v for k, v in FIFO.items() if k != "pr"},
    "ps": """
  SELECT run_id, 'DZ01' AS zone_id, unit_id, processing_start AS entry_ts, processing_end AS exit_ts FROM intervals
  UNION ALL SELECT run_id, 'DZ01', unit_id, timestamp_ms, NULL FROM run_peaks a WHERE is_start = 1 AND NOT EXISTS (
    SELECT 1 FROM paired p WHERE p.run_id = a.run_id AND p.unit_id = a.unit_id AND p.start_event_sequence = a.event_sequence)""",
    "obs": "SELECT run_id, avg((exit_ts - entry_ts) / 1000.0::DOUBLE) AS observed FROM ps WHERE exit_ts IS NOT NULL GROUP BY run_id",
}


@query("boundary_allocation", with_ctes("ev units", """
, p AS (SELECT run_id, unit_id, entry_ts AS t0, exit_ts AS t1 FROM ps),
m AS (SELECT 'S0' || (i + 1) AS station_id, 36000 + 1000 * i AS w, sum(36000 + 1000 * i) OVER (ORDER BY i) AS cum, sum(36000 + 1000 * i) OVER () AS tot FROM range(3, 6) AS r(i))
SELECT p.run_id, 'DZ01' AS zone_id, p.unit_id, m.station_id, u.vehicle_model AS variant,
  (SELECT count(*) FROM p q WHERE q.run_id = p.run_id AND q.t0 < p.t0) - (SELECT count(*) FROM p q WHERE q.run_id = p.run_id AND q.t1 < p.t0) AS corridor_load,
  round(t0 + (t1 - t0) * (cum - w) / tot::DOUBLE, 5) AS station_entry_ms, round(CASE WHEN cum = tot THEN t1 ELSE t0 + (t1 - t0) * cum / tot::DOUBLE END, 5) AS station_exit_ms
FROM p, m JOIN units u ON u.run_id = p.run_id AND u.unit_id = p.unit_id WHERE t1 IS NOT NULL""", **{k: v for k, v in _PASS.items() if k != "obs"}))
def boundary_allocation(spark, d):
    a, z = _edges(spark, d)
    m = _dark(spark, d).select("run_id", F.lit("DZ01").alias("zone_id"), "station_id", F.col("station_index").alias("pos"), "base_cycle_time_ms")
    return rounded(ca.boundary_allocation(a, z, b.units(spark, d), m))


@query("zone_passages", with_ctes("ev", "SELECT * FROM ps", **_PASS))
def zone_passages(spark, d):
    return _passages(spark, d)


def scaled_priors(spark, d):
    return ca.rescale_priors(_dark(spark, d), passages(spark, d))


@query("rescale_priors", with_ctes("ev stations", """
SELECT s.run_id, s.station_id, round(observed / 120.0::DOUBLE, 5) AS factor, round(base_cycle_time_ms / 1000.0::DOUBLE * observed / 120.0::DOUBLE, 5) AS mean,
  round(cycle_time_std_ms / 1000.0::DOUBLE * observed / 120.0::DOUBLE, 5) AS std, round((base_cycle_time_ms / cycle_time_std_ms::DOUBLE) ** 2, 5) AS shape,
  round(cycle_time_std_ms / 1000.0::DOUBLE * cycle_time_std_ms / base_cycle_time_ms::DOUBLE * observed / 120.0::DOUBLE, 5) AS scale
FROM stations s JOIN obs ON obs.run_id = s.run_id WHERE is_dark""", **_PASS))
def rescale_priors(spark, d):
    return rounded(scaled_priors(spark, d))


@query("calibration_quality")
def calibration_quality(spark, d):
    """Every passage asks at each station of its zone, as its unit's own variant."""
    load = wn.corridor_load(passages(spark, d)).join(b.units(spark, d).select("run_id", "unit_id", F.col("vehicle_model").alias("variant")), ["run_id", "unit_id"])
    req = load.join(_dark(spark, d).select("run_id", "station_id"), "run_id").select(
        F.concat_ws("|", "run_id", "unit_id", "entry_ts", "station_id").alias("request_id"), "station_id", "variant", F.col("load").cast("int").alias("load"),
        (F.col("station_id") == DARK[0]).alias("is_first"))
    dwell = dwell_history(spark, d)
    fb = ca.fit_dwell(dwell).unionByName(ca.fit_dwell(dwell.withColumn("variant", F.lit(ca.ALL))))
    return rounded(ca.calibration_quality(req, ca.fit_residence_by_load(residence(spark, d, counted=True)), fb))


@query("nearest_load", with_ctes("ev", """
SELECT r.request_id, r.station_id, r.variant, r.target_load, m.load, m.n FROM req r LEFT JOIN LATERAL (
  SELECT load, n FROM (SELECT load, n, 0 AS lv FROM md WHERE md.station_id = r.station_id AND md.variant = r.variant
    UNION ALL SELECT load, n, 1 FROM md WHERE md.station_id = r.station_id AND md.variant = '__ALL__') ORDER BY lv, abs(load - r.target_load), load LIMIT 1) m ON true""",
    md="""SELECT station_id, event_type AS variant, CAST(queue_length_after AS INTEGER) AS load, count(*) AS n FROM ev WHERE queue_length_after IS NOT NULL AND event_type <> 'UNIT_ARRIVED' GROUP BY ALL
  UNION ALL SELECT station_id, '__ALL__', CAST(queue_length_after AS INTEGER), count(*) FROM ev WHERE queue_length_after IS NOT NULL GROUP BY ALL""",
    req="SELECT event_sequence AS request_id, station_id, event_type AS variant, CAST(event_sequence % 9 AS INTEGER) AS target_load FROM ev"))
def nearest_load(spark, d):
    e = b.station_events(spark, d)
    q = e.filter("queue_length_after IS NOT NULL").select("station_id", F.col("event_type").alias("variant"), F.col("queue_length_after").cast("int").alias("load"))
    both = q.filter("variant <> 'UNIT_ARRIVED'").unionByName(q.withColumn("variant", F.lit("__ALL__")))
    m = both.groupBy("station_id", "variant", "load").agg(F.count(F.lit(1)).alias("n")).withColumn("mean", F.col("load") * 1.0).withColumn("std", F.lit(1.0))
    r = e.select(F.col("event_sequence").alias("request_id"), "station_id", F.col("event_type").alias("variant"), (F.col("event_sequence") % 9).cast("int").alias("target_load"))
    return jn.nearest_load(r, m).select("request_id", "station_id", "variant", "target_load", "load", "n")


_SPLIT = "CASE WHEN production_day % 5 = 0 THEN 'validation' ELSE 'train' END"


def _split(spark, d):
    return b.runs(spark, d).select("run_id", F.when(F.col("production_day") % 5 == 0, "validation").otherwise("train").alias("split"))


@query("leave_one_run_out", with_ctes("ev runs", f"""
, pr AS (SELECT e.run_id, r.split, e.station_id, count(*) AS n, sum(coalesce(queue_length_after, 0)) AS q FROM ev e JOIN (SELECT run_id, {_SPLIT} AS split FROM runs) r ON r.run_id = e.run_id GROUP BY ALL)
SELECT a.run_id, a.split, a.station_id, count(h.run_id) AS history_runs, CAST(coalesce(sum(h.n), 0) AS BIGINT) AS history_n, coalesce(sum(h.q), 0) AS history_q
FROM pr a LEFT JOIN pr h ON h.station_id = a.station_id AND h.split = 'train' AND h.run_id <> a.run_id GROUP BY ALL"""))
def leave_one_run_out(spark, d):
    per = b.station_events(spark, d).join(_split(spark, d), "run_id").groupBy("run_id", "split", "station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("queue_length_after", F.lit(0.0))).alias("q"))
    return ca.leave_one_run_out(per, ["station_id"], ["n", "q"])


@query("history_guard", with_ctes("runs", f"""
SELECT CASE WHEN h = run_id THEN 'own_run_in_history' ELSE 'history_outside_training' END AS rule, run_id, h AS key FROM (
  SELECT run_id, 'run_' || lpad(CAST(production_day // 2 + 1 AS VARCHAR), 4, '0') AS h FROM runs) x
WHERE h = run_id OR h NOT IN (SELECT run_id FROM (SELECT run_id, {_SPLIT} AS split FROM runs) WHERE split = 'train')"""))
def history_guard(spark, d):
    h = b.runs(spark, d).select("run_id", F.concat(F.lit("run_"), F.lpad((F.floor(F.col("production_day") / 2) + 1).cast("string"), 4, "0")).alias("history_run"))
    return ca.history_guard(h, _split(spark, d))


@query("detect_corridors", with_ctes("stations runs", """
SELECT run_id, 'DZ_S04_S06' AS zone_id, 'corridor' AS kind, 'S04' AS first_station, 'S06' AS last_station, CAST(3 AS BIGINT) AS n_stations, 'S03' AS upstream_station, 'S07' AS downstream_station FROM runs
UNION ALL SELECT run_id, 'DZ_S08', 'single', 'S08', 'S08', 1, 'S07', 'S09' FROM runs"""))
def detect_corridors(spark, d):
    s = b.stations(spark, d).withColumn("is_dark", F.col("is_dark") | (F.col("sensor_coverage") == "NONE"))
    return ca.detect_corridors(s)


@query("dark_stations_from_events", with_ctes("ev stations", """
SELECT run_id, station_id, is_dark OR NOT EXISTS (SELECT 1 FROM ev WHERE ev.run_id = s.run_id AND ev.station_id = s.station_id) AS is_dark FROM stations s"""))
def dark_stations_from_events(spark, d):
    """All events of the log but those that hidden stations keep to themselves: found again are the hidden stations, and any without an event."""
    e, s = b.station_events(spark, d), b.stations(spark, d)
    seen = e.join(s.filter("is_dark").select("run_id", "station_id"), ["run_id", "station_id"], "left_anti")
    return ca.dark_stations_from_events(s, seen).select("run_id", "station_id", "is_dark")


@query("corridor_load", with_ctes("ev", """
SELECT run_id, zone_id, unit_id, entry_ts, exit_ts, (SELECT count(*) FROM ps q WHERE q.run_id = p.run_id AND q.entry_ts < p.entry_ts)
  - (SELECT count(*) FROM ps q WHERE q.run_id = p.run_id AND q.exit_ts < p.entry_ts) AS load FROM ps p""", **_PASS))
def corridor_load(spark, d):
    return wn.corridor_load(passages(spark, d))


@query("station_overlaps", with_ctes("ev", """
SELECT run_id, station_id, count(*) AS intervals, count(*) FILTER (processing_start < prev_end) AS overlaps FROM (
  SELECT *, lag(processing_end) OVER (PARTITION BY run_id, station_id ORDER BY processing_start, processing_end, start_event_sequence) AS prev_end FROM intervals) GROUP BY ALL""", **FIFO))
def station_overlaps(spark, d):
    return wn.station_overlaps(jn.pair_fifo(b.station_events(spark, d))[0])


@query("monotone_filter", with_ctes("preds", """
SELECT run_id, unit_id, seq, CASE WHEN station_index = reach THEN 'refresh' WHEN station_index < reach THEN 'backward' WHEN NOT ok THEN 'low_confidence' ELSE 'accepted' END AS verdict FROM (
  SELECT *, max(CASE WHEN ok THEN station_index END) OVER (PARTITION BY run_id, unit_id ORDER BY timestamp_ms, station_index, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
    SELECT run_id, unit_id, emission AS seq, timestamp_ms, station_index, state_confidence >= 0.6
      OR row_number() OVER (PARTITION BY run_id, unit_id ORDER BY timestamp_ms, station_index, emission) = 1 AS ok FROM preds))"""))
def monotone_filter(spark, d):
    a = b.bottleneck_predictions(spark, d).select("run_id", "unit_id", "timestamp_ms", "station_index", F.col("emission").alias("seq"), "state_confidence")
    return wn.monotone_filter(a, 0.6).select("run_id", "unit_id", "seq", "verdict")


@query("interval_ticks", with_ctes("ev", """
SELECT run_id, zone_id, unit_id, entry_ts, exit_ts, unnest(range(entry_ts + 60000, until + 1, 60000)) AS tick_ms FROM (
  SELECT *, coalesce(exit_ts, max(greatest(entry_ts, exit_ts)) OVER (PARTITION BY run_id)) AS until FROM ps) WHERE until >= entry_ts + 60000""", **_PASS))
def interval_ticks(spark, d):
    return oc.interval_ticks(passages(spark, d))


def with_priors(spark, d):
    """Passages with station, shape and scale arrays."""
    psg = passages(spark, d)
    p = ca.rescale_priors(_dark(spark, d), psg).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("station_id", "shape", "scale"))).alias("a"))
    return cut_lineage(psg.join(p, "run_id").select("run_id", "zone_id", "unit_id", "entry_ts", "exit_ts", F.col("a.station_id").alias("stations"),
                                                       F.col("a.shape").alias("shapes"), F.col("a.scale").alias("scales"), F.lit(0.9).alias("quality")))


def times(spark, d):
    """Zone display times: every ten minutes of the run."""
    return b.runs(spark, d).select("run_id", F.lit("DZ01").alias("zone_id"), F.explode(F.sequence(
        F.lit(600000).cast("long"), F.lit(7200000).cast("long"), F.lit(600000).cast("long"))).alias("t_ms"))


_DRAWS = {
    **_PASS,
    "prior": """
  SELECT s.run_id, s.station_id, row_number() OVER (PARTITION BY s.run_id ORDER BY s.station_id) - 1 AS i, count(*) OVER (PARTITION BY s.run_id) AS n,
    (base_cycle_time_ms / cycle_time_std_ms::DOUBLE) ** 2 AS a, cycle_time_std_ms / 1000.0::DOUBLE * cycle_time_std_ms / base_cycle_time_ms::DOUBLE * observed / 120.0::DOUBLE AS b
  FROM stations s JOIN obs ON obs.run_id = s.run_id WHERE is_dark""",
    "digits": f"""
  SELECT ps.*, particle, station_id, i, n, a, b, sha256('0|' || ps.run_id || '|' || zone_id || '|' || unit_id || '|' || entry_ts || '|' || particle || '|' || i) AS h
  FROM ps JOIN prior ON prior.run_id = ps.run_id, range({K}) AS r(particle)""",
    "drawn": """
  SELECT *, greatest(0.001::DOUBLE, a * b * greatest(0, 1 - 1 / (9 * a) + z / (3 * sqrt(a))) ** 3) AS t FROM (
    SELECT *, sqrt(-2 * ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE))
      * cos(6.283185307179586::DOUBLE * CAST('0x' || substr(h, 14, 13) AS BIGINT) / 4503599627370496.0::DOUBLE) AS z FROM digits)""",
    "hyp": """
  SELECT *, sum(t) OVER w AS c1, coalesce(sum(t) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c0,
    sum(t) OVER (PARTITION BY run_id, unit_id, entry_ts, particle) AS total FROM drawn WINDOW w AS (PARTITION BY run_id, unit_id, entry_ts, particle ORDER BY i)""",
    "times": "SELECT run_id, unnest(range(600000, 7200001, 600000)) AS t_ms FROM runs",
    "qs": """
  SELECT ps.*, t_ms, concat_ws('|', ps.run_id, zone_id, unit_id, entry_ts, t_ms) AS query_id FROM ps JOIN times ON times.run_id = ps.run_id
  WHERE t_ms >= entry_ts AND (exit_ts IS NULL OR t_ms < exit_ts)""",
}
_POST = {
    "seen": """
  SELECT q.query_id, q.run_id, q.zone_id, q.unit_id, q.entry_ts, q.t_ms, particle, h.station_id, i, n, total, (q.t_ms - q.entry_ts) / 1000.0::DOUBLE AS el,
    CASE WHEN total < (q.t_ms - q.entry_ts) / 1000.0::DOUBLE THEN CENSOR ELSE 1.0::DOUBLE END AS w, c0, t
  FROM qs q JOIN hyp h ON h.run_id = q.run_id AND h.unit_id = q.unit_id AND h.entry_ts = q.entry_ts
  WHERE (c0 <= (q.t_ms - q.entry_ts) / 1000.0::DOUBLE OR i = 0) AND ((q.t_ms - q.entry_ts) / 1000.0::DOUBLE < c1 OR i = n - 1)""".replace("CENSOR", f"{oc.CENSOR}::DOUBLE"),
    "cell": """
  SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, station_id, i, n, sum(w) AS sw, sum(w * w) AS sww, sum(w * pr) AS sp, sum(w * pr * pr) AS spp,
    sum(w * rem) AS sr, sum(w * rem * rem) AS srr FROM (SELECT *, least(1, greatest(0, (el - c0) / t)) AS pr, greatest(0, total - el) AS rem FROM seen) GROUP BY ALL""",
    "probs": """
  SELECT *, sw / sum(sw) OVER w AS p, sum(sw) OVER w AS tw, sum(sww) OVER w AS tww, sum(sr) OVER w AS tr, sum(srr) OVER w AS trr FROM cell WINDOW w AS (PARTITION BY query_id)""",
    "est": """
  SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, arg_max(station_id, p - i * 1e-13) AS most_likely_station, max(p) AS confidence,
    -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS entropy, max(n) AS n, arg_max(sp / sw, p - i * 1e-13) AS progress_mean,
    arg_max(sqrt(greatest(0, spp / sw - (sp / sw) ** 2)), p - i * 1e-13) AS progress_std, max(tr / tw) AS eta_s,
    max(sqrt(greatest(0, trr / tw - (tr / tw) ** 2))) AS eta_std_s, max(tw * tw / tww) AS effective_samples
  FROM probs GROUP BY ALL""",
}
_POSTERIOR = {**_DRAWS, **_POST}
_READINGS = {**_POSTERIOR, "times": "SELECT DISTINCT run_id, timestamp_ms AS t_ms FROM se WHERE station_id IN ('S04', 'S05', 'S06')", "shares": """
  SELECT e.run_id, p.zone_id, e.event_sequence AS evidence_id, e.timestamp_ms AS ts_ms, e.station_id, e.station_index, p.unit_id, p / sum(p) OVER (PARTITION BY e.run_id, e.event_sequence) AS share, p AS score
  FROM se e JOIN probs p ON p.run_id = e.run_id AND p.t_ms = e.timestamp_ms AND p.station_id = e.station_id WHERE p > 0"""}
_ONE = {
    **_DRAWS,
    "single": "SELECT *, greatest(0.001::DOUBLE, a * (b * 3) * greatest(0, 1 - 1 / (9 * a) + z / (3 * sqrt(a))) ** 3) AS t3 FROM drawn WHERE i = 0",
    "one": """
  SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, sp / sw AS progress_mean, sqrt(greatest(0, spp / sw - (sp / sw) ** 2)) AS progress_std, sr / sw AS eta_s,
    sqrt(greatest(0, srr / sw - (sr / sw) ** 2)) AS eta_std_s, exp(-sqrt(greatest(0, srr / sw - (sr / sw) ** 2)) / 8) AS confidence FROM (
    SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, sum(w) AS sw, sum(w * pr) AS sp, sum(w * pr * pr) AS spp, sum(w * rem) AS sr, sum(w * rem * rem) AS srr FROM (
      SELECT q.query_id, q.run_id, q.zone_id, q.unit_id, q.entry_ts, q.t_ms, least(1, el / t3) AS pr, greatest(0, t3 - el) AS rem, CASE WHEN t3 < el THEN CENSOR ELSE 1.0::DOUBLE END AS w
      FROM (SELECT *, (t_ms - entry_ts) / 1000.0::DOUBLE AS el FROM qs) q JOIN single h ON h.run_id = q.run_id AND h.unit_id = q.unit_id AND h.entry_ts = q.entry_ts) GROUP BY ALL)""".replace(
        "CENSOR", f"{oc.CENSOR}::DOUBLE"),
}


def _snapshots(share: float, fractions: tuple) -> str:
    """SQL of the queries that ``backtest_queries`` makes."""
    return f"""
  SELECT *, concat_ws('|', run_id, zone_id, unit_id, entry_ts, fraction) AS query_id, (exit_ts - t_ms) / 1000.0::DOUBLE AS true_remaining_s FROM (
    SELECT *, CAST(trunc(entry_ts + fraction * (exit_ts - entry_ts)) AS BIGINT) AS t_ms FROM (
      SELECT *, unnest([{', '.join(f'{f}::DOUBLE' for f in fractions)}]) AS fraction FROM (
        SELECT *, quantile_cont(entry_ts, {share}) OVER (PARTITION BY run_id) AS cutoff FROM ps WHERE exit_ts - entry_ts >= 15000) WHERE entry_ts >= cutoff))"""


_BACK = {**_ONE, "qs": _snapshots(0.7, (0.25, 0.5, 0.75)), "errors": """
  SELECT q.fraction, o.confidence, abs(progress_mean - fraction) AS p_err, abs(eta_s - true_remaining_s) AS e_err FROM one o JOIN qs q ON q.query_id = o.query_id"""}


@query("draw_hypotheses", with_ctes("ev stations", "SELECT run_id, zone_id, unit_id, entry_ts, CAST(particle AS INTEGER) AS particle, round(total, 5) AS total_s FROM hyp WHERE i = n - 1",
                                    **{k: v for k, v in _DRAWS.items() if k not in ("times", "qs")}))
def draw_hypotheses(spark, d):
    h = oc.draw_hypotheses(with_priors(spark, d), K)
    return h.select("run_id", "zone_id", "unit_id", "entry_ts", "particle", F.round(F.element_at("cum_t", -1), 5).alias("total_s"))


def _posterior(spark, d, k=K):
    p = with_priors(spark, d)
    q = oc.active_queries(p, times(spark, d))
    return p, q, *oc.station_posterior(p, q.drop("quality"), k)


def posterior(spark, d, k: int):
    """Estimates of every active unit and display time from k draws a passage."""
    return _posterior(spark, d, k)[3]


@query("station_posterior", with_ctes("ev stations runs", """
SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, most_likely_station, round(confidence, 5) AS confidence, round(entropy, 5) AS entropy,
  round(coalesce(entropy / nullif(ln(n), 0), 0), 5) AS entropy_normalized, round(progress_mean, 5) AS progress_mean, round(progress_std, 5) AS progress_std,
  round(eta_s, 5) AS eta_s, round(eta_std_s, 5) AS eta_std_s, round(effective_samples, 5) AS effective_samples FROM est""", **_POSTERIOR))
def station_posterior(spark, d):
    return rounded(_posterior(spark, d)[3])


@query("station_probabilities", with_ctes("ev stations runs", "SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, station_id, round(p, 5) AS p FROM probs", **_POSTERIOR))
def station_probabilities(spark, d):
    return rounded(_posterior(spark, d)[2])


@query("expected_queue", with_ctes("ev stations runs", """
SELECT run_id, zone_id, station_id, t_ms, round(m + 1e-9, 5) AS queue_mean, round(sqrt(greatest(0, v - m * m)) + 1e-9, 5) AS queue_std, round(exp(-sqrt(greatest(0, v - m * m))) * 0.9 + 1e-9, 5) AS confidence FROM (
  SELECT *, s1 - 1 + p0 AS m, sv + (s1 - 1) ** 2 - p0 AS v FROM (
    SELECT run_id, zone_id, station_id, t_ms, sum(p) AS s1, sum(p * (1 - p)) AS sv, product(1 - p) AS p0 FROM (SELECT run_id, zone_id, station_id, t_ms, least(p, 1) AS p FROM probs) GROUP BY ALL))""", **_POSTERIOR))
def expected_queue(spark, d):
    _, q, probs, _ = _posterior(spark, d)
    # chances are multiples of 1 / K, so sums and products fall on exact halves of the last digit: both sides lift them alike
    queue = oc.expected_queue(probs, q)
    return rounded(queue.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else c for c, t in queue.dtypes]))


@query("expected_crossings", with_ctes("ev stations runs", f"""
, cross_ AS (SELECT run_id, station_id, CAST(round(entry_ts * 1000 + 1e6 * c0) AS BIGINT) AS i_us, CAST(round(entry_ts * 1000 + 1e6 * c1) AS BIGINT) AS o_us FROM hyp)
SELECT t.run_id, 'DZ01' AS zone_id, s.station_id, t_ms,
  round(count(*) FILTER (i_us <= t_ms * 1000 AND i_us >= (t_ms - 600000) * 1000) / {K}.0::DOUBLE, 5) AS arrivals10,
  round(count(*) FILTER (i_us < (t_ms - 600000) * 1000 AND i_us >= (t_ms - 1200000) * 1000) / {K}.0::DOUBLE, 5) AS arrivals_prev,
  round(count(*) FILTER (o_us <= t_ms * 1000 AND o_us >= (t_ms - 600000) * 1000) / {K}.0::DOUBLE, 5) AS services10,
  round(count(*) FILTER (o_us < (t_ms - 600000) * 1000 AND o_us >= (t_ms - 1200000) * 1000) / {K}.0::DOUBLE, 5) AS services_prev
FROM times t JOIN stations s ON s.run_id = t.run_id AND is_dark LEFT JOIN cross_ c ON c.run_id = t.run_id AND c.station_id = s.station_id GROUP BY ALL""",
                                      **{k: v for k, v in _DRAWS.items() if k != "qs"}))
def expected_crossings(spark, d):
    h = oc.draw_hypotheses(oc.merged(with_priors(spark, d)), K)
    q = times(spark, d).withColumn("station_id", F.explode(F.array(*[F.lit(s) for s in DARK])))
    return rounded(oc.expected_crossings(h, q))


def checkpoint_reads(spark, d):
    """Identified reads of the binding: manual checks at hidden stations, of three kinds, at a tenth of the station."""
    m = b.manual_checks(spark, d).filter(F.col("station_id").isin(DARK))
    kind = F.element_at(F.array(*map(F.lit, ("RFID", "POWER_DRAW", "ANDON"))), (F.col("event_sequence") % 3 + 1).cast("int"))
    return m.select("run_id", F.lit("DZ01").alias("zone_id"), "unit_id", "station_id", kind.alias("checkpoint_type"), F.col("timestamp_ms").alias("ts_ms"),
                    F.col("event_sequence").alias("checkpoint_id"), ((F.col("event_sequence") % 10) / 10.0).alias("progress"))


def _identified(spark, d):
    """Checkpoint reads placed into the passage of their unit."""
    from takt.operators.slices import as_of
    p = passages(spark, d)
    got = as_of(checkpoint_reads(spark, d), p, ["run_id", "zone_id", "unit_id"], "ts_ms", "entry_ts", ["entry_ts", "exit_ts"], right_tie=["exit_ts"])
    return got.filter("entry_ts IS NOT NULL AND (exit_ts IS NULL OR ts_ms <= exit_ts)")


_READS = {
    "reads": """
  SELECT m.run_id, 'DZ01' AS zone_id, m.unit_id, m.station_id, list_extract(['RFID', 'POWER_DRAW', 'ANDON'], m.event_sequence % 3 + 1) AS checkpoint_type, m.timestamp_ms AS ts_ms,
    m.event_sequence AS checkpoint_id, (m.event_sequence % 10) / 10.0::DOUBLE AS seen, p.entry_ts, p.exit_ts
  FROM (SELECT * FROM ma WHERE station_id IN ('S04', 'S05', 'S06')) m ASOF JOIN (
    SELECT * FROM ps QUALIFY row_number() OVER (PARTITION BY run_id, unit_id, entry_ts ORDER BY exit_ts DESC NULLS LAST) = 1) p
    ON p.run_id = m.run_id AND p.unit_id = m.unit_id AND m.timestamp_ms >= p.entry_ts WHERE p.exit_ts IS NULL OR m.timestamp_ms <= p.exit_ts""",
    "logs": """
  SELECT run_id, unit_id, entry_ts, particle, ts_ms, ln(greatest(CASE WHEN held = station_id THEN exp(-0.5 * ((pr - seen) / std) ** 2) / (std * 2.5066282746310002::DOUBLE) ELSE 0.02 END, 1e-300::DOUBLE)) AS ll FROM (
    SELECT r.*, particle, h.station_id AS held, least(1, greatest(0, (el - c0) / t)) AS pr, CASE checkpoint_type WHEN 'RFID' THEN 0.05::DOUBLE WHEN 'POWER_DRAW' THEN 0.12 ELSE 0.03 END AS std
    FROM (SELECT *, (ts_ms - entry_ts) / 1000.0::DOUBLE AS el FROM reads) r JOIN hyp h ON h.run_id = r.run_id AND h.unit_id = r.unit_id AND h.entry_ts = r.entry_ts
    WHERE (c0 <= el OR i = 0) AND (el < c1 OR i = n - 1))""",
    "raw": """
  SELECT *, exp(ll - max(ll) OVER (PARTITION BY query_id)) AS raw FROM (SELECT query_id, particle, sum(ll) AS ll FROM qs JOIN logs ON logs.run_id = qs.run_id AND logs.unit_id = qs.unit_id
    AND logs.entry_ts = qs.entry_ts AND ts_ms <= t_ms GROUP BY ALL)""",
}


@query("checkpoint_weight", with_ctes("ev ma stations runs", """
SELECT query_id, round(max(raw) / sum(raw), 5) AS top_weight, round(sum(raw) ** 2 / sum(raw * raw), 5) AS effective_samples FROM raw GROUP BY query_id""", **_DRAWS, **_READS))
def checkpoint_weight(spark, d):
    p = with_priors(spark, d)
    q = oc.active_queries(p, times(spark, d))
    w = oc.checkpoint_weight(oc.draw_hypotheses(oc.merged(p), K), _identified(spark, d), q)
    return rounded(w.groupBy("query_id").agg(F.max("weight").alias("top_weight"), F.max("effective_samples").alias("effective_samples")))


@query("evidence_association", with_ctes("ev se stations", "SELECT * EXCLUDE (station_index, share, score), round(share, 5) AS share, round(score, 5) AS score FROM shares", **_READINGS))
def evidence_association(spark, d):
    return rounded(_association(spark, d))


def _association(spark, d):
    e = b.sensor_readings(spark, d).filter(F.col("station_id").isin(DARK)).select(
        "run_id", F.lit("DZ01").alias("zone_id"), F.col("event_sequence").alias("evidence_id"), F.col("timestamp_ms").alias("ts_ms"), "station_id")
    p = with_priors(spark, d)
    q = oc.active_queries(p, e.select("run_id", "zone_id", F.col("ts_ms").alias("t_ms")).distinct())
    return oc.evidence_association(oc.station_posterior(p, q.drop("quality"), K, apart=True)[0], e)


_SURVIVE = f"CASE WHEN total < @ THEN {oc.CENSOR}::DOUBLE ELSE 1.0::DOUBLE END"


def _fit(r: int) -> dict[str, str]:
    """CTEs of round r: each draw's weight and likelihood at the observation, each unit's score and share."""
    before = "" if r == 1 else f" * coalesce(1 - b{r - 1}.share + b{r - 1}.share * l{r - 1}.lik / b{r - 1}.score, 1)"
    joins = "" if r == 1 else f" LEFT JOIN b{r - 1} USING (run_id, unit_id, entry_ts, t_ms) LEFT JOIN l{r - 1} USING (run_id, unit_id, entry_ts, t_ms, particle)"
    return {
        f"l{r}": f"""
  SELECT o.run_id, o.t_ms, h.unit_id, h.entry_ts, particle, CASE WHEN h.station_id = o.st THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS lik, {_SURVIVE.replace("@", "((o.ts - h.entry_ts) / 1000.0::DOUBLE)")} AS alive
  FROM obs_r o JOIN hyp h ON h.run_id = o.run_id AND o.r = {r} AND h.entry_ts <= o.ts AND (h.exit_ts IS NULL OR h.exit_ts > o.ts)
  WHERE (c0 <= (o.ts - h.entry_ts) / 1000.0::DOUBLE OR i = 0) AND ((o.ts - h.entry_ts) / 1000.0::DOUBLE < c1 OR i = n - 1)""",
        f"b{r}": f"""
  SELECT *, score / sum(score) OVER (PARTITION BY run_id, t_ms) AS share FROM (
    SELECT l{r}.run_id, l{r}.t_ms, l{r}.unit_id, l{r}.entry_ts, sum(l{r}.alive{before} * l{r}.lik) / sum(l{r}.alive{before}) AS score FROM l{r}{joins} GROUP BY ALL)""",
    }


_FEEDBACK = {
    **_DRAWS,
    "obs_r": """
  SELECT *, row_number() OVER (PARTITION BY run_id, t_ms ORDER BY ts, id) AS r FROM (
    SELECT t.run_id, t_ms, e.event_sequence AS id, e.timestamp_ms AS ts, e.station_id AS st FROM times t JOIN se e ON e.run_id = t.run_id AND e.timestamp_ms <= t_ms AND e.timestamp_ms > t_ms - 600000
      AND e.station_id IN ('S04', 'S05', 'S06') QUALIFY row_number() OVER (PARTITION BY t.run_id, t_ms ORDER BY e.timestamp_ms DESC, e.event_sequence DESC) <= 2)""",
    **_fit(1), **_fit(2),
    "last": f"""
  SELECT q.query_id, q.run_id, q.unit_id, q.entry_ts, q.t_ms, h.station_id, {_SURVIVE.replace("@", "((q.t_ms - q.entry_ts) / 1000.0::DOUBLE)")}
    * coalesce(1 - b1.share + b1.share * l1.lik / b1.score, 1) * coalesce(1 - b2.share + b2.share * l2.lik / b2.score, 1) AS w
  FROM qs q JOIN hyp h ON h.run_id = q.run_id AND h.unit_id = q.unit_id AND h.entry_ts = q.entry_ts
    LEFT JOIN b1 ON b1.run_id = q.run_id AND b1.unit_id = q.unit_id AND b1.entry_ts = q.entry_ts AND b1.t_ms = q.t_ms
    LEFT JOIN l1 ON l1.run_id = q.run_id AND l1.unit_id = q.unit_id AND l1.entry_ts = q.entry_ts AND l1.t_ms = q.t_ms AND l1.particle = h.particle
    LEFT JOIN b2 ON b2.run_id = q.run_id AND b2.unit_id = q.unit_id AND b2.entry_ts = q.entry_ts AND b2.t_ms = q.t_ms
    LEFT JOIN l2 ON l2.run_id = q.run_id AND l2.unit_id = q.unit_id AND l2.entry_ts = q.entry_ts AND l2.t_ms = q.t_ms AND l2.particle = h.particle
  WHERE (c0 <= (q.t_ms - q.entry_ts) / 1000.0::DOUBLE OR i = 0) AND ((q.t_ms - q.entry_ts) / 1000.0::DOUBLE < c1 OR i = n - 1)""",
}


@query("evidence_feedback", with_ctes("ev se stations runs", """
SELECT query_id, run_id, unit_id, entry_ts, t_ms, station_id, round(sum(w) / max(whole), 5) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY query_id) AS whole FROM last) GROUP BY ALL""", **_FEEDBACK))
def evidence_feedback(spark, d):
    """Station chances of every unit and display time after the two readings before it have changed the draws' weights."""
    e = b.sensor_readings(spark, d).filter(F.col("station_id").isin(DARK)).select(
        "run_id", F.lit("DZ01").alias("zone_id"), F.col("event_sequence").alias("evidence_id"), F.col("timestamp_ms").alias("ts_ms"), "station_id")
    return rounded(oc.evidence_feedback(with_priors(spark, d), times(spark, d), e, 2, k=K)[0].drop("zone_id"))


@query("attribute_readings", with_ctes("ev se stations", """
SELECT run_id, evidence_id, CASE WHEN conf >= 0.55 THEN unit_id END AS unit_id, round(conf, 5) AS confidence FROM (
  SELECT s.run_id, evidence_id, s.unit_id, share / sum(share) OVER (PARTITION BY s.run_id, evidence_id) AS conf FROM shares s LEFT JOIN (
    SELECT run_id, unit_id, max(station_index) AS reached FROM ev WHERE station_index BETWEEN 3 AND 4 AND event_type = 'PROCESSING_COMPLETED' GROUP BY ALL) r
    ON r.run_id = s.run_id AND r.unit_id = s.unit_id WHERE reached IS NULL OR reached <= station_index)
QUALIFY row_number() OVER (PARTITION BY run_id, evidence_id ORDER BY conf DESC, unit_id DESC) = 1""", **_READINGS))
def attribute_readings(spark, d):
    a = _association(spark, d).withColumn("station_index", F.substring("station_id", 2, 2).cast("int") - 1)
    reached = b.station_events(spark, d).filter("station_index BETWEEN 3 AND 4 AND event_type = 'PROCESSING_COMPLETED'").groupBy("run_id", "unit_id").agg(
        F.max("station_index").alias("reached_index"))
    return rounded(oc.attribute_readings(a, reached))


@query("evidence_gates", with_ctes("ev ma stations", """
SELECT e.query_id, CASE WHEN checkpoint_type = 'RFID' AND abs(seen - progress_mean) / greatest(progress_std, 1e-3::DOUBLE) > 4 THEN 'rfid_beyond_gate'
  WHEN checkpoint_type = 'ANDON' AND seen > 0 AND el / greatest(mean_s, 1e-3::DOUBLE) < seen * 0.15 THEN 'andon_implausible' END AS reason
FROM (SELECT *, (t_ms - entry_ts) / 1000.0::DOUBLE AS el FROM qs) e JOIN est ON est.query_id = e.query_id JOIN (SELECT run_id, sum(a * b) AS mean_s FROM prior GROUP BY run_id) m ON m.run_id = e.run_id""",
    **{**{k: v for k, v in _DRAWS.items() if k not in ("times", "qs")}, "reads": _READS["reads"],
       "qs": "SELECT *, ts_ms AS t_ms, concat_ws('|', run_id, unit_id, entry_ts, ts_ms, checkpoint_id) AS query_id FROM reads", **_POST}))
def evidence_gates(spark, d):
    """Verdict on every identified read, against the belief and the expected duration of its passage."""
    p = with_priors(spark, d)
    e = _identified(spark, d).withColumn("query_id", F.concat_ws("|", "run_id", "unit_id", "entry_ts", "ts_ms", "checkpoint_id"))
    one = oc.station_posterior(p, e.select("query_id", "run_id", "zone_id", "unit_id", "entry_ts", F.col("ts_ms").alias("t_ms")), K)[1]
    mean = F.aggregate(F.zip_with("shapes", "scales", lambda a, z: a * z), F.lit(0.0), lambda x, y: x + y)
    long = p.groupBy("run_id").agg(F.max(mean).alias("mean_duration_s"))
    j = e.join(one.select("query_id", "progress_mean", "progress_std"), "query_id").join(long, "run_id").withColumn("elapsed_s", (F.col("ts_ms") - F.col("entry_ts")) / 1000.0)
    ok, bad = oc.evidence_gates(j)
    return ok.select("query_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("query_id", "reason"))


@query("single_station_progress", with_ctes("ev stations runs", """
SELECT query_id, run_id, zone_id, unit_id, entry_ts, t_ms, round(progress_mean, 5) AS progress_mean, round(progress_std, 5) AS progress_std, round(eta_s, 5) AS eta_s,
  round(eta_std_s, 5) AS eta_std_s, round(confidence, 5) AS confidence FROM one""", **_ONE))
def single_station_progress(spark, d):
    p = with_priors(spark, d).select("run_id", "zone_id", "unit_id", "entry_ts", "exit_ts", F.slice("stations", 1, 1).alias("stations"), F.slice("shapes", 1, 1).alias("shapes"),
                                     F.transform(F.slice("scales", 1, 1), lambda s: s * 3).alias("scales"))
    q = oc.active_queries(p, times(spark, d))
    return rounded(oc.single_station_progress(oc.draw_hypotheses(oc.merged(p), K), q))


def _backtest(spark, d):
    p = with_priors(spark, d).select("run_id", "zone_id", "unit_id", "entry_ts", "exit_ts", F.slice("stations", 1, 1).alias("stations"), F.slice("shapes", 1, 1).alias("shapes"),
                                     F.transform(F.slice("scales", 1, 1), lambda s: s * 3).alias("scales"))
    q = oc.backtest_queries(p)
    est = oc.single_station_progress(oc.draw_hypotheses(oc.merged(p), K), q.select("query_id", "run_id", "zone_id", "unit_id", "entry_ts", "t_ms"))
    return oc.occupancy_backtest(est, q)


@query("occupancy_backtest", with_ctes("ev stations", """
SELECT fraction, count(*) AS n, round(avg(p_err), 5) AS progress_mae, round(avg(e_err), 5) AS eta_mae_s, round(avg(confidence), 5) AS mean_confidence,
  round(quantile_cont(p_err, 0.5), 5) AS progress_median_error FROM errors GROUP BY fraction""", **{k: v for k, v in _BACK.items() if k != "times"}))
def occupancy_backtest(spark, d):
    return rounded(_backtest(spark, d)[0])


@query("occupancy_backtest_confidence", with_ctes("ev stations", "SELECT count(*) AS n, round(corr(confidence, p_err), 5) AS corr_confidence_error FROM errors",
                                                 **{k: v for k, v in _BACK.items() if k != "times"}))
def occupancy_backtest_confidence(spark, d):
    return rounded(_backtest(spark, d)[1])


@query("posterior_calibration", with_ctes("ev stations", """
SELECT fraction, count(*) AS n, round(avg(CASE WHEN most_likely_station = true_station THEN 1.0::DOUBLE ELSE 0 END), 5) AS top1_accuracy, round(avg(s2 - 2 * pt + 1), 5) AS brier,
  round(avg(-ln(greatest(pt, 1e-9::DOUBLE))), 5) AS log_loss, round(avg(confidence), 5) AS mean_confidence FROM (
  SELECT t.query_id, fraction, true_station, sum(p * p) AS s2, coalesce(sum(p) FILTER (station_id = true_station), 0) AS pt FROM probs p JOIN truth t ON t.query_id = p.query_id GROUP BY ALL) x
JOIN est ON est.query_id = x.query_id GROUP BY fraction""", **{**{k: v for k, v in _POSTERIOR.items() if k != "times"}, "qs": _snapshots(0.0, (0.15, 0.3, 0.5, 0.7, 0.85)),
    "truth": "SELECT query_id, fraction, list_extract(['S04', 'S05', 'S06'], CAST(least(3, floor(fraction * 3) + 1) AS BIGINT)) AS true_station FROM qs"}))
def posterior_calibration(spark, d):
    p = with_priors(spark, d)
    q = oc.backtest_queries(p, 0.0, (0.15, 0.3, 0.5, 0.7, 0.85))
    probs, est = oc.station_posterior(p, q.select("query_id", "run_id", "zone_id", "unit_id", "entry_ts", "t_ms"), K)
    truth = q.select("query_id", "fraction", F.element_at("stations", F.least(F.lit(3), F.floor(F.col("fraction") * 3).cast("int") + 1)).alias("true_station"))
    return rounded(oc.posterior_calibration(probs, est, truth)[0])


@query("confirmed_exits", with_ctes("ev", """
SELECT run_id, unit_id, station_id, processing_start AS entry_ts, processing_end AS exit_ts, (processing_end - processing_start) / 1000.0::DOUBLE AS dwell_s, true AS observed FROM intervals""", **FIFO))
def confirmed_exits(spark, d):
    return oc.confirmed_exits(jn.pair_fifo(b.station_events(spark, d))[0])


@query("robust_trim", with_ctes("ev", """
, m AS (SELECT station_id, count(cycle_time_ms) AS n, median(cycle_time_ms) AS med FROM ev GROUP BY station_id),
s AS (SELECT e.station_id, 1.4826::DOUBLE * median(abs(cycle_time_ms - med)) AS mad FROM ev e JOIN m ON m.station_id = e.station_id WHERE cycle_time_ms IS NOT NULL GROUP BY e.station_id)
SELECT e.run_id, e.station_id, e.event_sequence, e.cycle_time_ms FROM ev e JOIN m ON m.station_id = e.station_id JOIN s ON s.station_id = e.station_id
WHERE cycle_time_ms IS NOT NULL AND (n < 8 OR mad = 0 OR abs(cycle_time_ms - med) / mad < 3.5)"""))
def robust_trim(spark, d):
    e = b.station_events(spark, d).filter("cycle_time_ms IS NOT NULL").select("run_id", "station_id", "event_sequence", "cycle_time_ms")
    return ag.robust_trim(e, ["station_id"], "cycle_time_ms")


@query("poisson_binomial_queue", with_ctes("bp", """
SELECT run_id, station_id, round(m, 6) AS queue_mean, round(sqrt(greatest(0, v - m * m)), 6) AS queue_std, round(exp(-sqrt(greatest(0, v - m * m))) * q, 6) AS confidence FROM (
  SELECT run_id, station_id, s1 - 1 + p0 AS m, sv + (s1 - 1) ** 2 - p0 AS v, q FROM (
    SELECT run_id, station_id, sum(p) AS s1, sum(p * (1 - p)) AS sv, CASE WHEN max(p) >= 1 THEN 0 ELSE exp(sum(ln(1 - p))) END AS p0, min(state_confidence) AS q
    FROM (SELECT *, least(0.95::DOUBLE, probability) * 0.98765432187::DOUBLE AS p FROM bp) GROUP BY ALL))"""))
def poisson_binomial_queue(spark, d):
    p = b.bottleneck_predictions(spark, d).withColumn("p", F.least(F.lit(0.95), F.col("probability")) * 0.98765432187)
    return rounded(ag.poisson_binomial_queue(p, ["run_id", "station_id"], "p", "state_confidence"), default=6)


@query("weighted_stats", with_ctes("bp", """
SELECT station_id, round(sum(w * x) / sum(w), 6) AS w_mean, round(sqrt(sum(w * x * x) / sum(w) - (sum(w * x) / sum(w)) ** 2), 5) AS w_std,
  round(min(x) FILTER (cum / tot >= 0.9 - 1e-12), 6) AS w_quantile FROM (
  SELECT station_id, x, w, sum(w) OVER (PARTITION BY station_id ORDER BY x) AS cum, sum(w) OVER (PARTITION BY station_id) AS tot
  FROM (SELECT station_id, risk_percent AS x, round(state_confidence * 10) AS w FROM bp)) GROUP BY station_id"""))
def weighted_stats(spark, d):
    p = b.bottleneck_predictions(spark, d).withColumn("w", F.round(F.col("state_confidence") * 10))
    return rounded(ag.weighted_stats(p, ["station_id"], "risk_percent", "w", 0.9), {"w_mean": 6, "w_quantile": 6})


def dark_feature_rows(spark, d):
    p, q, probs, _ = _posterior(spark, d)
    ledger = oc.expected_queue(probs, q)
    rates = oc.expected_crossings(oc.draw_hypotheses(oc.merged(p), K), times(spark, d).withColumn("station_id", F.explode(F.array(*[F.lit(s) for s in DARK]))))
    return dark_columns(ledger, rates, scaled_priors(spark, d), b.stations(spark, d))


@query("dark_features")
def dark_features(spark, d):
    return rounded(dark_feature_rows(spark, d), {"queue_slope_10m": 9})
