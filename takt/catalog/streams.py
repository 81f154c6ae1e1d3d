"""Registered streaming queries: the given tables are replayed through a file stream until drained."""
from __future__ import annotations

from pyspark.sql import functions as F

from takt import bindings as b
from takt.catalog.base import registry, rounded, rounded_sql
from takt.catalog.evaluate import POLICY_CTES
from takt.catalog.flow import _DIGITS, _STATS_CTES
from takt.catalog.flow import ORACLE as ORACLE_FLOW
from takt.catalog.quality import _DBL, UNIT_CTES
from takt.catalog.sql import with_ctes
from takt.catalog.rollup import FB, _periods_sql
from takt.catalog.records import BUS, _contract_preds, runtime_bus
from takt.contracts import HORIZON_MS, QUALITY_FEATURES, QUALITY_META, TABLES
from takt.operators.joins import pair_fifo
from takt.session import cut_lineage
from takt.sources.runs import read_run_documents, run_of_path, shared_folder
from takt.sources.sinks import write_predictions
from takt.streaming import operators as so
from takt.streaming.timed import DAY_MS, PROVIDER, ROCKSDB, station_readings_stream
from takt.streaming.timed import interval_ticks_stream as interval_ticks

QUERIES, ORACLE, query = registry()


class Replay:
    """A table fed to a file stream in chunks by a column; each chunk is drained before the next one is
    written, so a query is also stopped and resumed from its checkpoint in between. ``then`` is fed last. A chunk may be a
    function that feeds something else.

    The stateful operators need the RocksDB store; as the application, this sets it for the session.
    """

    def __init__(self, spark, df, order: str, parts: int = 3, cuts: list | None = None, then=None):
        self.spark, self.df, self.root, self.progress = spark, df, shared_folder(spark), []
        spark.conf.set(PROVIDER, ROCKSDB)
        cuts = cuts or (df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else [])
        edges = [None, *cuts, None]
        o = F.col(order)
        self.chunks = [df.filter((F.lit(True) if lo is None else o > lo) & (F.lit(True) if hi is None else o <= hi)) for lo, hi in zip(edges, edges[1:])]
        self.chunks[-1] = df.filter(o.isNull() | (F.lit(True) if edges[-2] is None else o > edges[-2]))  # rows without a place in the order come last
        self.chunks += [] if then is None else [then]
        self._feed(self.chunks[0])
        self.stream = spark.readStream.schema(df.schema).parquet(f"{self.root}/in")

    def _feed(self, chunk):
        chunk.write.mode("append").parquet(f"{self.root}/in")

    def drain(self, run_once):
        run_once()
        for chunk in self.chunks[1:]:
            if callable(chunk):
                chunk()
            else:
                self._feed(chunk)
            run_once()

    def files(self, out):
        """Append the stream's output to files and read them back."""
        def once():
            self.progress += so.run_to_end(out, f"{self.root}/out", f"{self.root}/checkpoint").recentProgress
        self.drain(once)
        return self.spark.read.schema(out.schema).parquet(f"{self.root}/out")

    def state(self, what: str) -> list[int]:
        """A figure of the first stateful operator, one a micro-batch."""
        return [p["stateOperators"][0][what] for p in self.progress if p["stateOperators"]]


def heartbeat(df, ms: int):
    """One row without a run, ``ms`` after the last event: what an idle stream gets to move its watermark."""
    late = df.agg((F.max("event_time") + F.make_dt_interval(secs=F.lit(ms / 1000))).alias("event_time"))
    return late.select(*[F.col(c) if c == "event_time" else F.lit(None).cast(t).alias(c) for c, t in df.dtypes])


def delivered(df, ms: int = 300_000):
    """Rows with the time they arrive at: every fiftieth comes ``ms`` late, out of order."""
    return b.on_clock(df).withColumn("arrival", F.unix_millis("event_time") + F.when(F.col("event_sequence") % 50 == 0, ms).otherwise(0))


_WIN = ["queue_mean", "queue_std", "queue_max", "arrivals", "services", "prev_arrivals", "prev_services", "occupancy"]


@query("flow_windows_stream", with_ctes("ev", "SELECT run_id, station_id, ts, seq, " + ", ".join(f"round({c}, 5) AS {c}" for c in _WIN) + ", round(slope, 9) AS slope, carry_ts FROM stats", **_STATS_CTES))
def flow_windows_stream(spark, d):
    r = Replay(spark, b.station_events(spark, d), "event_sequence")
    out = r.files(so.flow_windows_stream(r.stream))
    return rounded(out.select("run_id", "station_id", "ts", "seq", *_WIN, "slope", "carry_ts"), _DIGITS)


@query("alert_policy_stream", with_ctes("series", """
SELECT run_id, unit_id, seq, raw, round(ema_03, 6) AS ema_03, round(ema_05, 6) AS ema_05, round(ema_07, 6) AS ema_07, two_consecutive, two_of_three FROM pol""", **POLICY_CTES))
def alert_policy_stream(spark, d):
    r = Replay(spark, b.scored_series(spark, d).select("run_id", "unit_id", "seq", "score"), "seq")
    return rounded(r.files(so.alert_policy_stream(r.stream)), {"raw": 12, "two_consecutive": 12, "two_of_three": 12}, 6)


@query("dark_transitions_stream", with_ctes("preds", """
SELECT run_id, unit_id, seq, CASE WHEN station_index = reach THEN 'refresh' WHEN station_index < reach THEN 'backward' WHEN NOT ok THEN 'low_confidence' ELSE 'accepted' END AS verdict FROM (
  SELECT *, max(CASE WHEN ok THEN station_index END) OVER (PARTITION BY run_id, unit_id ORDER BY timestamp_ms, station_index, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (
    SELECT run_id, unit_id, emission AS seq, timestamp_ms, station_index, state_confidence >= 0.6
      OR row_number() OVER (PARTITION BY run_id, unit_id ORDER BY timestamp_ms, station_index, emission) = 1 AS ok FROM preds))"""))
def dark_transitions_stream(spark, d):
    p = b.bottleneck_predictions(spark, d).select("run_id", "unit_id", "timestamp_ms", "station_index", F.col("emission").alias("seq"), "state_confidence")
    r = Replay(spark, p, "seq")
    return r.files(so.dark_transitions_stream(r.stream))


@query("state_after_completion", with_ctes("bp runs", "SELECT CAST(count(DISTINCT (run_id, unit_id)) AS BIGINT) AS keys_left FROM bp JOIN runs USING (run_id) WHERE runs.production_day % 3 = 0"))
def state_after_completion(spark, d):
    """Marker documents end the state of every unit of their runs; only runs without a readable marker keep theirs."""
    p = b.bottleneck_predictions(spark, d).select("run_id", "unit_id", "timestamp_ms", "station_index", F.col("emission").alias("seq"), "state_confidence")
    r = Replay(spark, p, "seq", 2)
    r.chunks.append(lambda: _write_markers(spark, d, f"{r.root}/docs"))
    ends = so.end_rows(so.finished_runs(spark, f"{r.root}/docs/*/*"), b.units(spark, d).select("run_id", "unit_id"))
    r.files(so.dark_transitions_stream(r.stream, ends))
    return spark.createDataFrame([(r.state("numRowsTotal")[-1],)], "keys_left long")


@query("warning_sessions", with_ctes("bp", "SELECT run_id, station_id AS series_key, start_ms, end_ms, point_count, open_ended FROM (" + _periods_sql("bp", "station_id") + ")", **FB))
def warning_sessions(spark, d):
    p = b.bottleneck_predictions(spark, d).select("run_id", "station_id", "timestamp_ms", "emission", "warning")
    r = Replay(spark, p, "emission")
    out = r.files(so.warning_sessions(r.stream, "station_id"))
    # a period reported open and later extended or closed counts once, in its last form
    return out.groupBy("run_id", "series_key", "start_ms").agg(F.max_by(F.struct("end_ms", "point_count", "open_ended"), F.struct(
        "point_count", F.when(F.col("open_ended"), 0).otherwise(1))).alias("r")).select("run_id", "series_key", "start_ms", "r.*")


# rows of a run's third of the month come together; every seventieth comes with the next third, mostly too late
_THIRDS = {
    "fed": """SELECT *, production_day::BIGINT * 86400000 + timestamp_ms AS et, least(3, (production_day - 1) // 10 + 1 + CASE WHEN event_id % 70 = 0 THEN 1 ELSE 0 END) AS third FROM ev""",
    "marks": """SELECT third, coalesce(max(max(et)) OVER (ORDER BY third ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 600000, 0) AS mark FROM fed GROUP BY third""",
    "placed": """SELECT f.*, unnest(range(timestamp_ms // 60000 * 60000 - 540000, timestamp_ms // 60000 * 60000 + 1, 60000)) AS w, mark FROM fed f JOIN marks USING (third)""",
    "judged": """SELECT *, w + production_day::BIGINT * 86400000 + 600000 <= mark AS late FROM placed""",
}


def _rate_replay(spark, d):
    e = b.on_clock(b.station_events(spark, d)).withColumn("day", F.substring("run_id", 5, 4).cast("int"))
    e = e.withColumn("third", F.least(F.lit(3), F.expr("(day - 1) div 10 + 1").cast("int") + F.when(F.col("event_sequence") % 70 == 0, 1).otherwise(0)))
    r = Replay(spark, e, "third", cuts=[1, 2], then=heartbeat(e, 3_600_000))
    return r, r.files(so.rate_windows(r.stream.withWatermark("event_time", "10 minutes")))


@query("rate_windows", with_ctes("ev", """
SELECT run_id, station_id, w AS window_start_ms, count(*) FILTER (event_type = 'UNIT_ARRIVED') AS arrivals, count(*) FILTER (event_type = 'PROCESSING_COMPLETED') AS services
FROM judged WHERE NOT late GROUP BY ALL""", **_THIRDS))
def rate_windows(spark, d):
    """Windows as the stream appends them, each once, when the watermark has passed its end; what came later is left out."""
    out = _rate_replay(spark, d)[1].filter("run_id IS NOT NULL")
    return out.withColumn("window_start_ms", F.col("window_start_ms") - F.substring("run_id", 5, 4).cast("long") * 86_400_000)


@query("rate_windows_late", with_ctes("ev", "SELECT CAST(count(DISTINCT (third, run_id, station_id, w)) AS BIGINT) AS late_groups FROM judged WHERE late", **_THIRDS))
def rate_windows_late(spark, d):
    """How many windows of a micro-batch came too late, as the query's progress counts them."""
    r, _ = _rate_replay(spark, d)
    return spark.createDataFrame([(sum(r.state("numRowsDroppedByWatermark")),)], "late_groups long")


@query("latest_state", with_ctes("bp", "SELECT run_id, station_id, timestamp_ms, warning FROM bp QUALIFY row_number() OVER (PARTITION BY run_id, station_id ORDER BY emission DESC) = 1"))
def latest_state(spark, d):
    p = b.bottleneck_predictions(spark, d).select("run_id", "station_id", "timestamp_ms", "emission", "warning")
    r = Replay(spark, p, "emission")
    final = so.latest_state(r.stream, "station_id", ["emission", "timestamp_ms", "warning"])
    sink = so.idempotent_sink(f"{r.root}/out", ["run_id", "station_id"], "emission")
    r.drain(lambda: final.writeStream.outputMode("update").trigger(availableNow=True).option(
        "checkpointLocation", f"{r.root}/ck").foreachBatch(sink).start().awaitTermination())
    return so.read_idempotent(spark, f"{r.root}/out", ["run_id", "station_id"], "emission").select("run_id", "station_id", "timestamp_ms", "warning")


@query("bus_stream", with_ctes("line_log", "SELECT run_id, kind AS record_type, count(*) AS n FROM rb GROUP BY ALL", **BUS))
def bus_stream(spark, d):
    bus = runtime_bus(spark, d)
    names = TABLES["runtime_bus"].names
    root = shared_folder(spark)
    bus.select("run_id", *names).write.partitionBy("run_id").option("header", True).csv(f"{root}/bus")
    s = so.bus_stream(spark, f"{root}/bus/*").select(run_of_path().alias("run_id"), F.upper("record_type").alias("record_type"))
    so.run_to_end(s, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(s.schema).parquet(f"{root}/out").groupBy("run_id", "record_type").agg(F.count(F.lit(1)).alias("n"))


@query("prediction_stream", with_ctes("bp", "SELECT run_id, count(*) AS n, count(*) FILTER (warning) AS warnings FROM bp GROUP BY run_id"))
def prediction_stream(spark, d):
    root = shared_folder(spark)
    write_predictions(_contract_preds(spark, d), f"{root}/lines", "bottleneck")
    s = so.prediction_stream(spark, f"{root}/lines", "bottleneck").select("run_id", "warning")
    so.run_to_end(s, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(s.schema).parquet(f"{root}/out").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("warning").alias("warnings"))


@query("ordered_input", with_ctes("line_log", """
SELECT run_id, station_id, event_sequence, coalesce(t < max(t) OVER (PARTITION BY run_id, station_id ORDER BY event_sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late
FROM (SELECT *, CASE WHEN event_id % 70 = 0 THEN greatest(0, timestamp_ms - 900000) ELSE timestamp_ms END AS t FROM line_log)"""))
def ordered_input(spark, d):
    e = b.line_log(spark, d).select("run_id", "station_id", "event_sequence", F.when(F.col("event_id") % 70 == 0, F.greatest(
        F.lit(0), F.col("timestamp_ms") - 900000)).otherwise(F.col("timestamp_ms")).alias("timestamp_ms"))
    r = Replay(spark, e, "event_sequence")
    out = r.files(so.ordered_input(r.stream, ["run_id", "station_id"], "run_id string, station_id string, event_sequence long, timestamp_ms long"))
    return out.drop("timestamp_ms")


@query("bottleneck_features_stream", ORACLE_FLOW["bottleneck_features"])
def bottleneck_features_stream(spark, d):
    """Events out of order within the watermark's delay, stopped and resumed: the batch table, labels included."""
    e = delivered(b.station_events(spark, d))
    r = Replay(spark, e, "arrival", then=heartbeat(e, 2 * DAY_MS))
    return rounded(so.labelled_flow_features(r.files(so.bottleneck_features_stream(r.stream, b.stations(spark, d)))), _DIGITS)


_LIVE = [c for c in QUALITY_META if c != "label_completeness_status"] + QUALITY_FEATURES


@query("defect_features_stream", with_ctes("ev se ma units", f"SELECT {rounded_sql(_LIVE, _DBL)} FROM f", **UNIT_CTES))
def defect_features_stream(spark, d):
    """Both stages, each stopped and resumed; the second reads the table the first one wrote.

    A start that never completes is only known at the end, so the log is fed without such starts; they are no interval in
    the batch table either.
    """
    pairs, _ = pair_fifo(b.station_events(spark, d))
    log = b.line_log(spark, d)
    done = pairs.select("run_id", F.col("start_event_sequence").alias("event_sequence"))
    starts = F.coalesce(F.col("event_type") == "PROCESSING_STARTED", F.lit(False))
    kept = log.filter(~starts).unionByName(log.filter(starts).join(done, ["run_id", "event_sequence"], "left_semi").select(*log.columns))
    bus = delivered(kept.select("run_id", "station_id", "station_index", "unit_id", "timestamp_ms", "event_sequence", "record_type", "event_type",
                                "queue_length_after", "cycle_time_ms", "sensor_type", F.col("sensor_value").alias("value"), F.col("check_result").alias("result")))
    path = f"{shared_folder(spark)}/bus"  # cut into chunks and read for its end, so pairing is done once
    bus.write.parquet(path)
    bus = spark.read.schema(bus.schema).parquet(path)
    first = Replay(spark, bus, "arrival", then=heartbeat(bus, 2 * DAY_MS))
    elements = first.files(station_readings_stream(first.stream))
    elements = elements.withColumn("position", F.unix_millis("event_time"))
    second = Replay(spark, elements, "position", 2, then=heartbeat(elements, 2 * DAY_MS))
    units, stations = cut_lineage(b.units(spark, d)), cut_lineage(b.stations(spark, d))  # every micro-batch joins them
    return rounded(second.files(so.defect_features_stream(second.stream, units, stations)).select(*_LIVE))


@query("interval_ticks_stream", with_ctes("ev", f"""
, edges AS (SELECT run_id, unit_id, timestamp_ms AS t, station_index = 6 AS leaves FROM ev WHERE event_type = 'UNIT_ARRIVED' AND station_index IN (3, 6)),
cuts AS (SELECT *, coalesce(lag(leaves) OVER o OR t - lag(t) OVER o > {HORIZON_MS}, false) AS fresh FROM edges WINDOW o AS (PARTITION BY run_id, unit_id ORDER BY t, leaves)),
stays AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY run_id, unit_id ORDER BY t, leaves ROWS UNBOUNDED PRECEDING) AS stay FROM cuts),
spans AS (SELECT run_id, unit_id, stay, min(t) FILTER (NOT leaves) AS entry_ts, coalesce(min(t) FILTER (leaves), max(t) + {HORIZON_MS}) AS last_ts FROM stays GROUP BY ALL)
SELECT run_id, unit_id, entry_ts, unnest(range(entry_ts + 60000, last_ts + 1, 60000)) AS tick_ms FROM spans WHERE last_ts >= entry_ts + 60000"""))
def interval_ticks_stream(spark, d):
    """Units tick while inside, without further rows of their own, until they leave or have been silent for half an hour."""
    e = delivered(b.station_events(spark, d).filter("event_type = 'UNIT_ARRIVED' AND station_index IN (3, 6)").select(
        "run_id", "unit_id", "timestamp_ms", "event_sequence", F.when(F.col("station_index") == 3, "ENTER").otherwise("EXIT").alias("kind")))
    r = Replay(spark, e, "arrival", then=heartbeat(e, DAY_MS))
    return r.files(interval_ticks(r.stream))


@query("unit_enrichment", with_ctes("ev units", "SELECT e.run_id, event_sequence, vehicle_model FROM ev e JOIN units u ON u.run_id = e.run_id AND u.unit_id = e.unit_id"))
def unit_enrichment(spark, d):
    r = Replay(spark, b.station_events(spark, d).select("run_id", "unit_id", "event_sequence"), "event_sequence")
    body = so.unit_enrichment(r.stream, lambda: b.units(spark, d), so.idempotent_sink(f"{r.root}/out", ["event_sequence"], "event_sequence"))
    r.drain(lambda: r.stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{r.root}/ck").foreachBatch(body).start().awaitTermination())
    return spark.read.parquet(f"{r.root}/out").select("run_id", "event_sequence", "vehicle_model")


@query("run_completion", with_ctes("runs", "SELECT run_id FROM runs WHERE production_day % 3 <> 0"))
def run_completion(spark, d):
    """Only runs with a readable marker count as finished: every third marker is torn."""
    return so.completed_runs(spark, _documents(spark, d), "run_id=*/*")


def _documents(spark, d):
    folder = shared_folder(spark) + "/docs"
    _write_markers(spark, d, folder)
    return folder


def _write_markers(spark, d, folder):
    doc = F.to_json(F.struct("run_id", F.lit("1.0").alias("schema_version"), F.col("production_day").cast("long").alias("random_seed")))
    b.runs(spark, d).select("run_id", F.when(F.col("production_day") % 3 == 0, '{"run_id": ').otherwise(doc).alias("value")).repartition("run_id").write.partitionBy("run_id").text(folder)


@query("read_run_documents", with_ctes("runs", "SELECT run_id, CASE WHEN production_day % 3 <> 0 THEN CAST(production_day AS BIGINT) END AS random_seed, production_day % 3 <> 0 AS readable FROM runs"))
def read_documents(spark, d):
    return read_run_documents(spark, _documents(spark, d) + "/run_id=*/*").select("run_id", F.col("doc.random_seed").alias("random_seed"), F.col("doc").isNotNull().alias("readable"))
