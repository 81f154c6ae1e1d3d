"""Station flow features: one row per station event, past-only windows, future-overflow label.

Every aggregate over [t - 10 min, t] is the sum of three parts of the same station's time line cut
into slices: the tail of the slice holding t - 10 min, the whole slices in between, and the head of
the current slice up to this event. Each event is copied once per shifted edge so that tail and head
are plain running aggregates (one ascending, one descending sort of a slice): the cost is linear in
the events however dense a window is, and one task holds one slice, not one station.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takt.contracts import BOUNDARY_EVENTS, FLOW_FEATURES, FLOW_META, HORIZON_MS, RECENT_MS, frozen_projection
from takt.functions import scalar as sc
from takt.operators.slices import UNBOUNDED, slice_number, tasks_for

KEYS = ["run_id", "station_id"]
_SUMS = {  # name -> (guard column, expression)
    "nq": ("q", lambda x: F.lit(1.0)), "sq": ("q", lambda x: F.col("q")),
    "sqq": ("q", lambda x: F.col("q") * F.col("q")), "sx": ("q", lambda x: x),
    "sxx": ("q", lambda x: x * x), "sxq": ("q", lambda x: x * F.col("q")),
    "nc": ("c", lambda x: F.lit(1.0)), "sc": ("c", lambda x: F.col("c")),
    "scc": ("c", lambda x: F.col("c") * F.col("c")),
    "arr": (None, lambda x: F.col("arr")), "srv": (None, lambda x: F.col("srv")),
}
_PREV = ["nq", "sq", "arr", "srv"]


def _part(cond: Column, name: str, x: Column) -> Column:
    guard, expr = _SUMS[name]
    ok = cond if guard is None else cond & F.col(guard).isNotNull()
    return F.when(ok, expr(x))


def _peaks(cond: Column, x: Column) -> dict[str, Column]:
    seen = cond & F.col("q").isNotNull()
    return {"mq": F.max(F.when(seen, F.col("q"))), "mc": F.max(F.when(cond, F.col("c"))),
            "x_hi": F.max(F.when(seen, x)), "x_lo": F.min(F.when(seen, x))}


def flow_windows(events: DataFrame, recent_ms: int = RECENT_MS, horizon_ms: int = HORIZON_MS,
                 slice_ms: int = 60_000) -> DataFrame:
    """Window moments per station event: recent_*, prev_*, carry_*, future_max, station_last_ts."""
    if recent_ms % slice_ms or horizon_ms % slice_ms:
        raise ValueError("slice_ms must divide the window lengths")
    k, h = recent_ms // slice_ms, horizon_ms // slice_ms
    w = F.lit(float(slice_ms))
    n_events = events.count()
    few, many = (tasks_for(events.sparkSession, n_events * f) for f in (1, 4))
    here = (events.filter(~F.col("event_type").isin(BOUNDARY_EVENTS))
            .select(*KEYS, F.col("timestamp_ms").alias("ts"), F.col("event_sequence").alias("seq"),
                    F.col("queue_length_after").cast("double").alias("q"),
                    F.col("cycle_time_ms").cast("double").alias("c"),
                    F.when(F.col("event_type") == "UNIT_ARRIVED", 1.0).otherwise(0.0).alias("arr"),
                    F.when(F.col("event_type") == "PROCESSING_COMPLETED", 1.0).otherwise(0.0).alias("srv"))
            .withColumn("slice", slice_number("ts", slice_ms)).repartition(few, *KEYS, "slice")
            .withColumn("idx", F.row_number().over(
                Window.partitionBy(*KEYS, "slice").orderBy("ts", "seq")).cast("long")))

    # one summary row per slice, then frames over slices only
    own_x = (F.col("ts") - F.col("slice") * w).cast("double")
    always = F.lit(True)
    per_slice = here.groupBy(*KEYS, "slice").agg(
        *[F.sum(_part(always, n, own_x)).alias(n) for n in _SUMS],
        *[c.alias(n) for n, c in _peaks(always, own_x).items()],
        F.count(F.lit(1)).alias("n_ev"), F.max("ts").alias("last_ts"),
        F.max_by(F.struct("q", "ts", "idx"),
                 F.when(F.col("q").isNotNull(), F.struct("ts", "seq"))).alias("rep"))
    order = Window.partitionBy(*KEYS).orderBy("slice")
    j = F.col("slice").cast("double")
    per_slice = per_slice.withColumn(
        "n_before", F.coalesce(F.sum("n_ev").over(order.rowsBetween(UNBOUNDED, -1)), F.lit(0)))

    def between(lo: int, hi: int, tag: str, names) -> list[Column]:
        """Sums over whole slices lo..hi away, time moments shifted to this slice's start."""
        if lo > hi:
            return [F.lit(None).cast("double").alias(f"{tag}_{n}") for n in names]
        f = order.rangeBetween(lo, hi)
        s = lambda c: F.coalesce(F.sum(c).over(f), F.lit(0.0))
        out = {n: s(F.col(n)) for n in names if n not in ("sx", "sxx", "sxq", "x_hi", "x_lo", "mq", "mc")}
        if "sx" in names:
            sn, sx, sq = s(F.col("nq")), s(F.col("sx")), s(F.col("sq"))
            jn, jx, jq, jjn = s(j * F.col("nq")), s(j * F.col("sx")), s(j * F.col("sq")), s(j * j * F.col("nq"))
            out["sx"] = sx + w * (jn - j * sn)
            out["sxx"] = s(F.col("sxx")) + 2 * w * (jx - j * sx) + w * w * (jjn - 2 * j * jn + j * j * sn)
            out["sxq"] = s(F.col("sxq")) + w * (jq - j * sq)
            out["x_hi"] = F.max(j * w + F.col("x_hi")).over(f) - j * w
            out["x_lo"] = F.min(j * w + F.col("x_lo")).over(f) - j * w
            out["mq"], out["mc"] = F.max("mq").over(f), F.max("mc").over(f)
        return [out[n].alias(f"{tag}_{n}") for n in names]

    full = list(_SUMS) + ["mq", "mc", "x_hi", "x_lo"]
    rep_global = F.when(F.col("rep").isNotNull(), F.struct(
        F.col("rep.q").alias("q"), F.col("rep.ts").alias("ts"),
        (F.col("n_before") + F.col("rep.idx")).alias("pos")))
    slices = per_slice.select(
        *KEYS, "slice", "n_before",
        *between(-(k - 1), -1, "rm", full), *between(-(2 * k - 1), -(k + 1), "pm", _PREV),
        (F.max("mq").over(order.rangeBetween(1, h - 1)) if h > 1 else F.lit(None).cast("double")).alias("fm_mq"),
        F.last(rep_global, ignorenulls=True).over(order.rowsBetween(UNBOUNDED, -1)).alias("rep_before"),
        F.max("last_ts").over(Window.partitionBy(*KEYS)).alias("station_last_ts"))

    # shifted copies: 0 the event, 1/2 its recent / previous edge, -1 its horizon edge
    shift = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(d).cast("long").alias("d"))
                                for kind, d in ((-1, -horizon_ms), (0, 0), (1, recent_ms), (2, 2 * recent_ms))]))
    copies = (here.select("*", shift.alias("cp")).select(
        *KEYS, F.col("cp.kind").alias("kind"), (F.col("ts") + F.col("cp.d")).alias("tt"), "ts", "seq", "q", "c",
        "arr", "srv", "idx").withColumn("slice", slice_number("tt", slice_ms))
        .repartition(many, *KEYS, "slice").sortWithinPartitions(*KEYS, "slice", "tt", "kind", "seq")
        .withColumn("x", (F.col("ts") - F.col("slice") * w).cast("double")))
    group = Window.partitionBy(*KEYS, "slice")
    up = group.orderBy("tt", "kind", "seq").rowsBetween(UNBOUNDED, 0)
    down = group.orderBy(F.col("tt").desc()).rangeBetween(UNBOUNDED, 0)
    after = group.orderBy(F.col("tt").desc()).rangeBetween(UNBOUNDED, -1)
    is0, is1, is2, isf = (F.col("kind") == v for v in (0, 1, 2, -1))
    x = F.col("x")
    scanned = copies.select(
        "*",
        *[F.sum(_part(is0, n, x)).over(up).alias(f"rh_{n}") for n in _SUMS],
        *[c.over(up).alias(f"rh_{n}") for n, c in _peaks(is0, x).items()],
        *[F.sum(_part(is1, n, x)).over(up).alias(f"ph_{n}") for n in _PREV],
        F.max(F.when(isf, F.col("q"))).over(up).alias("fh_mq"),
        F.last(F.when(is0 & F.col("q").isNotNull(), F.struct("q", "ts", "idx")), ignorenulls=True)
        .over(up).alias("rep_here"),
    ).select(
        "*",
        *[F.sum(_part(is1, n, x)).over(down).alias(f"rt_{n}") for n in _SUMS],
        *[c.over(down).alias(f"rt_{n}") for n, c in _peaks(is1, x).items()],
        *[F.sum(_part(is2, n, x)).over(down).alias(f"pt_{n}") for n in _PREV],
        F.max(F.when(is0, F.col("q"))).over(after).alias("ft_mq"),
    ).filter(is0).join(slices, [*KEYS, "slice"], "left")

    def add(tag: str, n: str) -> Column:
        return sum((F.coalesce(F.col(f"{tag}{p}_{n}"), F.lit(0.0)) for p in "thm"), F.lit(0.0))

    def most(n: str, f=F.greatest) -> Column:
        return f(*[F.col(f"r{p}_{n}") for p in "thm"])

    rep = F.coalesce(
        F.when(F.col("rep_here").isNotNull(), F.struct(
            F.col("rep_here.q").alias("q"), F.col("rep_here.ts").alias("ts"),
            (F.col("n_before") + F.col("rep_here.idx")).alias("pos"))), F.col("rep_before"))
    return scanned.select(
        *KEYS, "ts", "seq", "q", "station_last_ts",
        *[add("r", n).alias(n) for n in _SUMS], most("mq").alias("mq"), most("mc").alias("mc"),
        most("x_hi").alias("x_hi"), most("x_lo", F.least).alias("x_lo"),
        *[add("p", n).alias(f"prev_{n}") for n in _PREV],
        F.greatest("fh_mq", "ft_mq", "fm_mq").alias("future_max"),
        rep["q"].alias("carry_q"), rep["ts"].alias("carry_ts"),
        (F.col("n_before") + F.col("idx") - rep["pos"]).alias("carry_steps"))


def _sample_std(n: str, s: str, ss: str) -> Column:
    n_, s_, ss_ = F.col(n), F.col(s), F.col(ss)
    return F.when(n_ > 1, F.sqrt(F.greatest(F.lit(0.0), ss_ - s_ * s_ / n_) / (n_ - 1)))


def window_stats(events: DataFrame, **kw) -> DataFrame:
    """Readable window statistics (recent, previous, carried, slope, future) per station event."""
    m = flow_windows(events, **kw)
    n, sx, sq = F.col("nq"), F.col("sx"), F.col("sq")
    sxx = F.col("sxx") - sc.ratio(sx * sx, n)
    sxy = F.col("sxq") - sc.ratio(sx * sq, n)
    syy = F.col("sqq") - sc.ratio(sq * sq, n)
    # three or more distinct times <=> some time lies strictly between the first and the last
    spread = (F.col("x_lo") + F.col("x_hi")) * sx - F.col("sxx") - n * F.col("x_lo") * F.col("x_hi")
    two_times, three_times = F.col("x_hi") > F.col("x_lo"), spread > 0.5
    slope = F.when(two_times, sc.ratio(sxy, sxx))
    resid = F.greatest(F.lit(0.0), syy - sc.ratio(sxy * sxy, sxx))
    slope_se = F.when(two_times & three_times & (n > 2),
                      F.sqrt(sc.ratio(sc.ratio(resid, n - 2), sxx)))
    return m.select(
        *KEYS, "ts", "seq", "q", "station_last_ts", "future_max", "carry_ts", "carry_steps",
        F.coalesce("carry_q", F.lit(0.0)).alias("occupancy"),
        sc.ratio("sq", "nq").alias("queue_mean"), _sample_std("nq", "sq", "sqq").alias("queue_std"),
        F.col("mq").alias("queue_max"),
        sc.ratio("sc", "nc").alias("cycle_mean"), _sample_std("nc", "sc", "scc").alias("cycle_std"),
        F.col("mc").alias("cycle_max"), F.col("arr").alias("arrivals"), F.col("srv").alias("services"),
        sc.ratio("prev_sq", "prev_nq").alias("prev_queue_mean"),
        F.col("prev_arr").alias("prev_arrivals"), F.col("prev_srv").alias("prev_services"),
        slope.alias("slope"), slope_se.alias("slope_se"))


def flow_features(events: DataFrame, stations: DataFrame, horizon_ms: int = HORIZON_MS, **kw) -> DataFrame:
    """The 28 station flow features with meta columns and the overflow label."""
    stats = window_stats(events, horizon_ms=horizon_ms, **kw)
    return feature_rows(stats.withColumn("seen", F.col("station_last_ts") >= F.col("ts") + horizon_ms), stations)


def feature_rows(stats: DataFrame, stations: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Features and label of window statistics; ``seen`` says whether the horizon has passed (NULL: not yet known)."""
    line = stations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_stations"))
    dim = stations.join(line, "run_id").select(
        "run_id", "station_id", "archetype", "base_cycle_time_ms", "cycle_time_std_ms",
        sc.station_index("station_id").alias("station_index"),
        F.col("buffer_capacity").cast("double").alias("capacity"), "n_stations")
    f = stats.join(dim, KEYS)
    occ, cap, seen = F.col("occupancy"), F.col("capacity"), F.col("seen")
    full = sc.at_capacity(occ, cap)
    pstd = sc.progress_std("q", "carry_ts", "queue_std", "carry_steps")
    out = f.select(
        "run_id", F.col("station_id").alias("station_id_buffer_id"), F.col("ts").alias("prediction_time"),
        F.col("seq").alias("prediction_event_sequence"), cap.alias("capacity"),
        full.alias("currently_at_capacity"),
        F.when(full, "already_full").when(seen, "eligible").when(~seen, "censored").otherwise("pending")
        .alias("target_eligibility_status"),
        (cap - occ).alias("capacity_headroom"), "station_id", "base_cycle_time_ms",
        F.col("archetype").alias("station_archetype"),
        F.col("cycle_time_std_ms").alias("configured_cycle_std_ms"), "station_index",
        cap.alias("buffer_capacity"), sc.line_fraction("station_index", "n_stations").alias("line_fraction"),
        F.col("queue_max").alias("queue_max_10m"), F.col("queue_mean").alias("queue_mean_10m"),
        occ.alias("current_occupancy"), F.col("queue_std").alias("queue_std_10m"),
        sc.utilization(occ, cap).alias("capacity_utilization"),
        (F.col("prev_arrivals") / 10).alias("arrival_rate_per_min_prev10m"),
        (F.col("prev_services") / 10).alias("service_rate_per_min_prev10m"),
        (F.col("services") / 10).alias("service_rate_per_min_10m"),
        (F.col("arrivals") / 10).alias("arrival_rate_per_min_10m"),
        (1 - sc.utilization(occ, cap)).alias("utilization_headroom"),
        F.col("cycle_max").alias("cycle_max_10m"),
        (F.col("arrivals") - F.col("services")).alias("flow_pressure_10m"),
        (F.col("queue_mean") - F.col("prev_queue_mean")).alias("queue_delta_10m"),
        F.col("cycle_mean").alias("cycle_mean_10m"), F.col("slope").alias("queue_slope_10m"),
        ((F.col("arrivals") - F.col("services")) / 10).alias("net_flow_rate_10m"),
        F.col("cycle_std").alias("cycle_std_10m"),
        sc.state_confidence("q", "ts", "carry_ts").alias("state_confidence"),
        pstd.alias("progress_std"),
        sc.eta_std(cap - occ, F.col("slope"), F.col("slope_se"), pstd).alias("eta_std"),
        F.when(~full & seen, F.coalesce(F.col("future_max") >= cap, F.lit(False)).cast("int"))
        .alias("y_bottleneck"), *extra)
    return frozen_projection(out, [*FLOW_META, *FLOW_FEATURES, "y_bottleneck", *extra])
