"""Unit quality features: what an arriving unit has been through upstream, strictly in the past.

An arrival at (t, station s) needs aggregates over observations with source station < s that were
available before t, for all time and for the last ten minutes. The arrival asks each upstream
station once (fan-out = line length) and every question is answered by a running state, never by
pairing arrivals with observations:

* all-time aggregates: sliced running sums / maxima of the source station's observations;
* recent sums and counts: the same scan, where an observation enters when it becomes available and
  leaves ten minutes after it was made;
* recent maxima (not subtractable): an observation lives on (available, made + 10 min]. Its life is
  hung on the widest dyadic time slice whose boundary it crosses, as an open head in its first
  slice, whole slices between, and an open tail in its last. A question reads one running maximum up
  and one down in its slice per level in use.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takt.contracts import QUALITY_FEATURES, QUALITY_META, RECENT_MS, SIGNALS
from takt.functions import scalar as sc
from takt.operators.joins import assign_by_interval, pair_fifo
from takt.operators.slices import UNBOUNDED, latest, peak, running, tasks_for, total
from takt.session import cut_lineage

LEVELS = list(range(18, -1, -2))  # slices of 2^18 ms (4.4 min) down to 1 ms
_SIG = {s: s.lower() for s in SIGNALS}
QID = ["run_id", "unit_id", "prediction_time", "prediction_event_sequence"]


def prediction_rows(events: DataFrame, final: DataFrame) -> DataFrame:
    """Arrivals of known units up to the final inspection station."""
    return (events.filter((F.col("event_type") == "UNIT_ARRIVED") & F.col("unit_id").isNotNull()
                          & F.col("timestamp_ms").isNotNull())
            .join(final, "run_id").filter(F.col("station_index") <= F.col("final_station_index")))


def final_station(stations: DataFrame) -> DataFrame:
    """Last INSPECTION station of each run by line position."""
    return (stations.filter(F.upper(F.trim("archetype")) == "INSPECTION").groupBy("run_id")
            .agg(F.max_by("station_id", "station_index").alias("final_station"),
                 F.max("station_index").alias("final_station_index")))


def _questions(pred: DataFrame) -> DataFrame:
    """One row per arrival and upstream station; an arrival at the line start keeps one NULL row."""
    up = F.when(F.col("prediction_station_index") > 0,
                F.sequence(F.lit(0), F.col("prediction_station_index") - 1))
    return pred.select(*QID, F.explode_outer(up).alias("src"))


def _state(questions: DataFrame, elements: DataFrame, keys: list[str], recent_ms: int, width: int, tasks: int) -> DataFrame:
    """Running state of every source at each question (sources: what, signal, value, ts, avail, seq)."""
    ask = questions.select(*keys, F.col("prediction_time").alias("__t"), F.lit(0).alias("__k"),
                           F.struct(*[F.col(c) for c in QID]).alias("__q"), F.lit(0).cast("long").alias("__seq"))
    # a lasting reading also enters the recent window when available and leaves it ten minutes after it was made
    lasting = (F.col("what") == "sensor") & (F.col("avail") < F.col("ts") + recent_ms)
    step = lambda what, t: F.struct(what.alias("what"), t.alias("t"))
    steps = F.when(lasting, F.array(step(F.lit("sensor"), F.col("avail")), step(F.lit("in"), F.col("avail")), step(F.lit("out"), F.col("ts") + recent_ms))
                   ).otherwise(F.array(step(F.col("what"), F.col("avail"))))
    base = elements.withColumn("__x", F.explode(steps)).select(
        *keys, F.col("__x.t").alias("__t"), F.lit(1).alias("__k"), F.col("seq").alias("__seq"), F.col("__x.what").alias("what"), "signal", "value", "ts")
    rows = base.unionByName(ask, allowMissingColumns=True)
    v, what = F.col("value"), F.col("what")
    cols = {}
    for sig, p in _SIG.items():
        on = F.col("signal") == sig
        hist, inn, out = (what == "sensor") & on, (what == "in") & on, (what == "out") & on
        cols[f"{p}_n"] = total(F.when(hist, 1.0))
        cols[f"{p}_s"] = total(F.when(hist, v))
        cols[f"{p}_mx"] = peak(F.when(hist, v))
        cols[f"{p}_rn"] = total(F.when(inn, 1.0).when(out, -1.0))
        cols[f"{p}_rs"] = total(F.when(inn, v).when(out, -v))
    cols["torque_ss"] = total(F.when((what == "sensor") & (F.col("signal") == "TORQUE"), v * v))
    for kind in ("queue", "cycle"):
        on = what == kind
        cols[f"{kind}_n"], cols[f"{kind}_s"] = total(F.when(on, 1.0)), total(F.when(on, v))
        cols[f"{kind}_ss"], cols[f"{kind}_mx"] = total(F.when(on, v * v)), peak(F.when(on, v))
    check = F.struct(F.col("ts").alias("ts"), F.col("__seq").alias("seq"), v.alias("fail"), F.col("src").alias("src"))
    cols["checks"] = total(F.when(what == "manual", 1.0))
    cols["fails"] = total(F.when(what == "manual", v))
    cols["last_check"] = latest(F.when(what == "manual", check))
    cols["last_fail"] = latest(F.when((what == "manual") & (v == 1.0), check))
    out = running(rows, keys, ["__t", "__k", "ts", "__seq"], cols, width, tasks=tasks)
    return out.filter(F.col("__q").isNotNull()).select("__q.*", *cols)


def _recent_peaks(questions: DataFrame, elements: DataFrame, keys: list[str], recent_ms: int, tasks: int) -> DataFrame:
    """Largest value per signal among observations alive at each question."""
    e = (elements.filter((F.col("what") == "sensor") & (F.col("avail") < F.col("ts") + recent_ms))
         .select(*keys, "signal", "value", (F.col("avail") + 1).alias("a"), (F.col("ts") + recent_ms).alias("b")))
    level = F.coalesce(*[F.when(F.shiftright("a", k) < F.shiftright("b", k), k) for k in LEVELS], F.lit(0))

    def entry(side: int, slice_: Column, pos: Column) -> Column:
        return F.struct(F.lit(side).alias("side"), slice_.alias("slice"), pos.alias("pos"))

    e = e.withColumn("k", level)
    head, tail = F.expr("shiftright(a, k)"), F.expr("shiftright(b, k)")
    e = e.withColumn("first", head).withColumn("last", tail)
    inner = F.when(F.col("last") - F.col("first") > 1, F.transform(
        F.sequence(F.col("first") + 1, F.col("last") - 1), lambda s: entry(0, s, F.lit(-1).cast("long")))
    ).otherwise(F.expr("array()").cast("array<struct<side:int,slice:bigint,pos:bigint>>"))
    ends = F.when(F.col("first") < F.col("last"), F.array(entry(0, F.col("first"), F.col("a")),
                                                          entry(1, F.col("last"), F.col("b")))
                  ).otherwise(F.array(entry(0, F.col("first"), F.lit(-1).cast("long"))))
    nodes = e.select(*keys, "k", "signal", "value", F.explode(F.concat(ends, inner)).alias("n")).select(
        *keys, "k", "n.slice", "n.side", "n.pos", "signal", "value")
    levels = e.groupBy(*keys).agg(F.collect_set("k").alias("ks"))
    ask = (questions.filter(F.col("src").isNotNull()).join(levels, keys)
           .select(*keys, *[c for c in QID if c not in keys], F.explode("ks").alias("k"))
           .withColumn("slice", F.expr("shiftright(prediction_time, k)"))
           .select(*keys, "k", "slice", F.lit(2).alias("side"), F.col("prediction_time").alias("pos"),
                   F.struct(*[F.col(c) for c in QID]).alias("__q")))
    g = Window.partitionBy(*keys, "k", "slice")
    up = g.orderBy("pos", "side").rowsBetween(UNBOUNDED, 0)
    down = g.orderBy(F.col("pos").desc()).rangeBetween(UNBOUNDED, 0)
    both = (nodes.unionByName(ask, allowMissingColumns=True).repartition(tasks, *keys, "k", "slice")
            .sortWithinPartitions(*keys, "k", "slice", "pos", "side"))
    of = lambda side, sig: F.max(F.when((F.col("side") == side) & (F.col("signal") == sig), F.col("value")))
    seen = both.select("*", *[of(0, sig).over(up).alias(f"u_{p}") for sig, p in _SIG.items()])
    seen = seen.select("*", *[of(1, sig).over(down).alias(f"d_{p}") for sig, p in _SIG.items()])
    return seen.filter(F.col("side") == 2).select(
        "__q.*", *[F.greatest(f"u_{p}", f"d_{p}").alias(f"{p}_rmx") for p in _SIG.values()])


def _gather(parts: list[DataFrame], tasks: int) -> DataFrame:
    """Merge per-source states into one row per arrival; its sources come from different tasks."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    structs = [c for c in ("last_check", "last_fail") if c in rows.columns]
    peaks = [c for c in rows.columns if c.endswith("mx")]
    sums = [c for c in rows.columns if c not in QID + structs + peaks]
    return rows.repartition(tasks, *QID).groupBy(*QID).agg(*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in peaks],
                                  *[F.max(c).alias(c) for c in structs])


def _features(pred: DataFrame, state: DataFrame, units: DataFrame, stations: DataFrame) -> DataFrame:
    return feature_rows(pred.join(state, QID), units, stations)


def feature_rows(rows: DataFrame, units: DataFrame, stations: DataFrame) -> DataFrame:
    """The 30 features with meta columns and label of rows that hold an arrival's upstream state."""
    line = stations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_stations"))
    j = (rows.join(units.select("run_id", "unit_id", "vehicle_model", "supplier_batch"), ["run_id", "unit_id"], "left")
         .join(line, "run_id"))

    def mean(p, r=""):
        return sc.ratio(f"{p}_{r}s", f"{p}_{r}n")

    def std(p):
        n, s, ss = F.col(f"{p}_n"), F.col(f"{p}_s"), F.col(f"{p}_ss")
        return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), ss - s * s / n) / (n - 1)))

    # leaving observations cancel the entering ones exactly in count; a zero count means none is left
    recent = {p: F.when(F.col(f"{p}_rn") > 0, mean(p, "r")) for p in _SIG.values()}
    idx = F.col("prediction_station_index")
    f = {
        "torque_delta_recent_vs_history": recent["torque"] - mean("torque"),
        "vibration_delta_recent_vs_history": recent["vibration"] - mean("vibration"),
        "manual_fail_count_cum": F.coalesce("fails", F.lit(0.0)),
        "manual_check_count_cum": F.coalesce("checks", F.lit(0.0)),
        "last_manual_fail": F.col("last_check.fail"),
        "stations_since_last_manual_fail": (idx - F.col("last_fail.src")).cast("double"),
        "line_fraction": sc.line_fraction(idx, "n_stations"),
        "queue_history_mean": mean("queue"), "queue_history_std": std("queue"),
        "cycle_history_max": F.col("cycle_mx"), "cycle_history_std": std("cycle"),
        "torque_std_history": std("torque"),
        "current_missing_recent": F.when(recent["current"].isNull(), 1.0).otherwise(0.0),
    }
    for p in _SIG.values():
        f[f"{p}_mean_history"], f[f"{p}_max_history"] = mean(p), F.col(f"{p}_mx")
        f[f"{p}_mean_recent"], f[f"{p}_max_recent"] = recent[p], F.col(f"{p}_rmx")
    keep = ["prediction_station_index", "supplier_batch", "vehicle_model"]
    return j.select(*QUALITY_META, *[F.col(c) if c in keep else f[c].alias(c) for c in QUALITY_FEATURES], "y_defect")


def _label_after(pred: DataFrame, qa: DataFrame, inclusive: bool) -> DataFrame:
    """y = some FAIL after t; NULL (censored) when no final result follows. Per unit only the last
    result and the last FAIL matter, so the inspections shrink to one row per unit first."""
    per_unit = qa.groupBy("run_id", "unit_id").agg(
        F.max("timestamp_ms").alias("last_qa"),
        F.max(F.when(F.col("result") == "FAIL", F.col("timestamp_ms"))).alias("last_fail_qa"))
    j = pred.join(per_unit, ["run_id", "unit_id"], "left")
    t = F.col("prediction_time")
    after = (lambda c: F.col(c) >= t) if inclusive else (lambda c: F.col(c) > t)
    seen = F.coalesce(after("last_qa"), F.lit(False))
    return (j.withColumn("label_completeness_status", F.when(seen, "complete").otherwise("censored"))
            .withColumn("y_defect", F.when(seen, F.coalesce(after("last_fail_qa"), F.lit(False)).cast("int")))
            .drop("last_qa", "last_fail_qa"))


def _valid_results(inspections: DataFrame) -> DataFrame:
    r = F.upper(F.trim("result"))
    return inspections.withColumn("result", r).filter(F.col("result").isin("PASS", "FAIL")
                                                      & F.col("timestamp_ms").isNotNull())


def label_rows(pred: DataFrame, inspections: DataFrame, final: DataFrame) -> DataFrame:
    """Strictly-after label on the last INSPECTION station."""
    qa = _valid_results(inspections).join(final.select("run_id", F.col("final_station").alias("station_id")),
                                          ["run_id", "station_id"], "left_semi")
    return _label_after(pred, qa, inclusive=False)


def _as_pred(rows: DataFrame) -> DataFrame:
    return rows.select("run_id", "unit_id", F.col("station_id").alias("prediction_station"),
                       F.col("timestamp_ms").alias("prediction_time"),
                       F.col("event_sequence").alias("prediction_event_sequence"),
                       F.col("station_index").alias("prediction_station_index"), "final_station_index")


def _tasks(events: DataFrame, sensors: DataFrame, manual: DataFrame) -> int:
    """Tasks for all rows of a scan: events, checks, three steps a reading, and a question an arrival and upstream station."""
    n = events.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.when(F.col("event_type") == "UNIT_ARRIVED", F.greatest("station_index", F.lit(1)))).alias("asked")).first()
    return tasks_for(events.sparkSession, n["rows"] + (n["asked"] or 0) + 3 * sensors.count() + manual.count())


def _unit_elements(events: DataFrame, manual: DataFrame) -> DataFrame:
    cycles = events.filter((F.col("event_type") == "PROCESSING_COMPLETED") & F.col("cycle_time_ms").isNotNull()
                           & F.col("unit_id").isNotNull())
    return _element(cycles, "cycle", "cycle_time_ms").unionByName(
        _element(manual.filter(F.col("unit_id").isNotNull()).withColumn(
            "__f", (F.upper(F.trim("result")) == "FAIL").cast("double")), "manual", "__f"))


def _element(df: DataFrame, what: str, value: str, avail: str = "timestamp_ms", signal: Column | None = None) -> DataFrame:
    unit = F.col("unit_id") if "unit_id" in df.columns else F.lit(None).cast("string")
    return df.select("run_id", unit.alias("unit_id"), F.col("station_index").alias("src"), F.lit(what).alias("what"),
                     (signal if signal is not None else F.lit(None).cast("string")).alias("signal"),
                     F.col(value).cast("double").alias("value"), F.col("timestamp_ms").alias("ts"),
                     F.col(avail).alias("avail"), F.col("event_sequence").alias("seq"))


def quality_features(events: DataFrame, sensors: DataFrame, manual: DataFrame, units: DataFrame, stations: DataFrame,
                     inspections: DataFrame, recent_ms: int = RECENT_MS, width: int = 600_000) -> DataFrame:
    """Unit scope: only this unit's own observations; a reading counts once its interval has ended."""
    final = final_station(stations)
    pred = label_rows(_as_pred(prediction_rows(events, final)), inspections, final)
    tasks = _tasks(events, sensors, manual)
    intervals, _ = pair_fifo(events, tasks=tasks)
    readings = sensors.filter(F.col("sensor_type").isin(SIGNALS) & F.col("value").isNotNull()
                              & F.col("timestamp_ms").isNotNull())
    # the assigned readings feed several scans below: write them once instead of pairing and joining again
    assigned = cut_lineage(assign_by_interval(readings, intervals, tasks=tasks).select(
        "run_id", F.col("assigned_unit_id").alias("unit_id"), "station_index", "sensor_type", "value", "timestamp_ms", "processing_end", "event_sequence"))
    queues = events.filter((F.col("event_type") == "UNIT_ARRIVED") & F.col("queue_length_after").isNotNull()
                           & F.col("unit_id").isNotNull())
    elements = (_element(assigned, "sensor", "value", "processing_end", F.col("sensor_type"))
                .unionByName(_element(queues, "queue", "queue_length_after"))
                .unionByName(_unit_elements(events, manual)))
    keys = ["run_id", "unit_id", "src"]
    q = _questions(pred)
    state = _gather([_state(q, elements, keys, recent_ms, width, tasks), _recent_peaks(q, elements, keys, recent_ms, tasks)], tasks)
    return _features(pred, state, units, stations)


def quality_features_line(events: DataFrame, sensors: DataFrame, manual: DataFrame, units: DataFrame,
                          stations: DataFrame, inspections: DataFrame, recent_ms: int = RECENT_MS,
                          width: int = 600_000) -> DataFrame:
    """Line scope (older contract): readings and queues of all upstream stations, usable at once;
    the label looks at the last station of the line and includes its own instant."""
    last = stations.groupBy("run_id").agg(F.max("station_index").alias("final_station_index"),
                                          F.max_by("station_id", "station_index").alias("final_station"))
    rows = events.filter((F.col("event_type") == "UNIT_ARRIVED") & F.col("unit_id").isNotNull()).join(last, "run_id")
    qa = inspections.join(last.select("run_id", F.col("final_station").alias("station_id")),
                          ["run_id", "station_id"], "left_semi")
    pred = _label_after(_as_pred(rows), qa, inclusive=True)
    line = (_element(sensors.filter(F.col("sensor_type").isin(SIGNALS) & F.col("value").isNotNull()), "sensor",
                     "value", signal=F.col("sensor_type"))
            .unionByName(_element(events.filter(F.col("queue_length_after").isNotNull()), "queue", "queue_length_after")))
    q = _questions(pred)
    own = _unit_elements(events, manual)
    tasks = _tasks(events, sensors, manual)
    state = _gather([_state(q, line, ["run_id", "src"], recent_ms, width, tasks),
                     _recent_peaks(q, line, ["run_id", "src"], recent_ms, tasks),
                     _state(q, own, ["run_id", "unit_id", "src"], recent_ms, width, tasks)], tasks)
    return _features(pred, state, units, stations)
