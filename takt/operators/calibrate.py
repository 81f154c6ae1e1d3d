"""Histories of hidden stations turned into dwell and residence distributions."""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from takt.functions import scalar as sc
from takt.functions.gamma import gamma_shape
from takt.operators.aggregate import trim_limits, within_limits
from takt.operators.joins import pair_fifo
from takt.operators.slices import as_of, numbered, running, slice_number, tasks_for, total
from takt.operators.windows import corridor_load
from takt.session import cut_lineage

ALL = "__ALL__"
BLOCK_MS = 1 << 18  # clocks that meet at once when pairs are counted
AT_ONCE = 1 << 22  # pairs that a task holds
COUNTED = "station_id string, variant string, is_first boolean, band string, corridor_load long, x double, n long, sx double, sl double"


def dwell_history(events: DataFrame, units: DataFrame, stations: DataFrame) -> DataFrame:
    """First-in first-out processing intervals at the given stations with the unit's variant; no variant, no row."""
    here = events.join(stations.select("run_id", "station_id"), ["run_id", "station_id"], "left_semi")
    p = pair_fifo(here)[0].select("run_id", "unit_id", "station_id", F.col("processing_start").alias("entry_ts"), F.col("processing_end").alias("exit_ts"))
    v = units.filter("vehicle_model IS NOT NULL").select("run_id", "unit_id", F.col("vehicle_model").alias("variant"))
    return p.join(v, ["run_id", "unit_id"]).withColumn("dwell_s", (F.col("exit_ts") - F.col("entry_ts")) / 1000.0)


def corridor_residence(events: DataFrame, units: DataFrame, corridor: DataFrame, counted: bool = False) -> DataFrame:
    """Residence per corridor station of units with a complete passage, and the load at their entry.

    ``corridor``: run_id, station_id, is_first, is_last, upstream_station. A run's entry source is the
    upstream completion if it has any, else the first station's arrivals, else its starts. A start has a row with every later end of its unit
    and station; ``counted`` counts the same rows and doesn't list them (``_pair_counts``).
    """
    c = corridor.select("run_id", "station_id", "is_first", "is_last", "upstream_station")
    e = events.select("run_id", "unit_id", "station_id", "event_type", "timestamp_ms")
    first = c.filter("is_first").select("run_id", F.col("station_id").alias("first"), "upstream_station")
    cand = e.join(first, "run_id").select(
        "run_id", "unit_id", "timestamp_ms", "first", "upstream_station",
        F.when((F.col("station_id") == F.col("upstream_station")) & (F.col("event_type") == "PROCESSING_COMPLETED"), 0)
        .when((F.col("station_id") == F.col("first")) & (F.col("event_type") == "UNIT_ARRIVED"), 1)
        .when((F.col("station_id") == F.col("first")) & (F.col("event_type") == "PROCESSING_STARTED"), 2).alias("src")).filter("src IS NOT NULL")
    best = cand.groupBy("run_id").agg(F.min("src").alias("src"))
    entry = cand.join(best, ["run_id", "src"]).select("run_id", "unit_id", F.col("timestamp_ms").alias("entry_ts"), F.col("first").alias("station_id"), "src")
    last = c.filter("is_last").select("run_id", "station_id")
    exits = e.filter("event_type = 'PROCESSING_COMPLETED'")
    out = exits.join(last, ["run_id", "station_id"], "left_semi").select("run_id", "unit_id", F.col("timestamp_ms").alias("exit_ts"))
    load = _last_load(entry.select("run_id", "unit_id", "entry_ts"), out)
    inner = (e.filter("event_type = 'UNIT_ARRIVED'").join(c.filter("NOT is_first"), ["run_id", "station_id"], "left_semi")
             .select("run_id", "unit_id", F.col("timestamp_ms").alias("entry_ts"), "station_id"))
    starts = entry.select("run_id", "unit_id", "entry_ts", "station_id").unionByName(inner)
    ends = exits.join(c, ["run_id", "station_id"], "left_semi").select("run_id", "unit_id", "station_id", F.col("timestamp_ms").alias("exit_ts"))
    source = best.select("run_id", F.element_at(F.array(F.lit("upstream_completed"), F.lit("first_arrived"), F.lit("first_started")),
                                                F.col("src") + 1).alias("boundary_source"))
    v = units.select("run_id", "unit_id", F.col("vehicle_model").alias("variant"))
    # all that a start says is joined before it meets its ends
    known = (starts.join(load, ["run_id", "unit_id"]).join(v, ["run_id", "unit_id"], "left").join(source, "run_id")
             .join(c.select("run_id", "station_id", "is_first"), ["run_id", "station_id"]))
    known = known.withColumn("variant", F.coalesce("variant", F.lit("__UNKNOWN__")))
    if counted:
        return _pair_counts(known, ends)
    return (known.join(ends, ["run_id", "unit_id", "station_id"]).filter("exit_ts > entry_ts")
            .select("run_id", "unit_id", "station_id", "variant", "entry_ts", "exit_ts",
                    "corridor_load", "is_first", "boundary_source", ((F.col("exit_ts") - F.col("entry_ts")) / 1000.0).alias("dwell_s")))


def _pair_counts(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Pairs of a start and a later end of its unit and station, counted: n of each residence x (s) by load band; of first stations also n, the
    sum of x and the sum of its logarithm by load (x NULL). Parts of a sum are rows of their own.

    Starts and ends meet by blocks of ``BLOCK_MS`` of their clocks. Two blocks that lie d apart have residences of d - 1 to d + 1 blocks, so a
    task that goes through all block pairs of one band and distance needs two blocks of counters, and at most ``AT_ONCE`` pairs at a time.
    """
    unit, kept = ["run_id", "unit_id", "station_id"], ["station_id", "variant", "is_first", "band", "d"]
    s = starts.filter("entry_ts IS NOT NULL").groupBy(*unit, "variant", "is_first", "corridor_load", slice_number("entry_ts", BLOCK_MS).alias("i")).agg(F.collect_list("entry_ts").alias("starts"))
    e = ends.filter("exit_ts IS NOT NULL").groupBy(*unit, slice_number("exit_ts", BLOCK_MS).alias("j")).agg(F.collect_list("exit_ts").alias("exits"))
    met = s.join(e, unit).filter("j >= i").select("station_id", "variant", "is_first", sc.load_band("corridor_load").alias("band"), (F.col("j") - F.col("i")).alias("d"),
                                                  F.col("corridor_load").cast("long").alias("corridor_load"), "starts", "exits")

    def flush(key: tuple, counts: np.ndarray, loads: dict) -> Iterator[pd.DataFrame]:
        station, variant, first, band, d = key
        at = np.nonzero(counts)[0]
        rows = [pd.DataFrame({"corridor_load": pd.array([pd.NA] * len(at), "Int64"), "x": (at + (d - 1) * BLOCK_MS) / 1000.0, "n": counts[at], "sx": None, "sl": None})]
        if loads:
            rows.append(pd.DataFrame([(load, None, *sums) for load, sums in loads.items()], columns=["corridor_load", "x", "n", "sx", "sl"]))
        for r in rows:
            for a in range(0, len(r), 1 << 16):
                yield r.iloc[a:a + (1 << 16)].assign(station_id=station, variant=variant, is_first=first, band=band)[[c.split()[0] for c in COUNTED.split(", ")]]

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, counts, loads, waiting, held = None, np.zeros(2 * BLOCK_MS, np.int64), {}, [], 0
        for batch in batches:
            for *now, load, begun, ended in zip(*[batch[c] for c in (*kept, "corridor_load", "starts", "exits")]):
                if tuple(now) != key:
                    if waiting:
                        counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                    if key is not None:
                        yield from flush(key, counts, loads)
                    key, loads, waiting, held = tuple(now), {}, [], 0
                    counts[:] = 0
                begun, ended = np.asarray(begun, np.int64), np.asarray(ended, np.int64)
                step = max(1, AT_ONCE // len(ended))
                for a in range(0, len(begun), step):
                    x = (ended[None] - begun[a:a + step, None]).ravel()
                    x = x[x > 0]
                    if not len(x):
                        continue
                    if key[2]:
                        sums, s = loads.setdefault(load, [0, 0.0, 0.0]), x / 1000.0
                        sums[0], sums[1], sums[2] = sums[0] + len(x), sums[1] + float(s.sum()), sums[2] + float(np.log(s).sum())
                    waiting.append(x - (key[4] - 1) * BLOCK_MS)
                    held += len(x)
                    if held >= AT_ONCE:
                        counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
                        waiting, held = [], 0
        if waiting:
            counts += np.bincount(np.concatenate(waiting), minlength=len(counts))
        if key is not None:
            yield from flush(key, counts, loads)

    tasks = tasks_for(starts.sparkSession, 0)
    return met.repartition(tasks, *kept).sortWithinPartitions(*kept).mapInPandas(count, COUNTED)


def _last_load(entries: DataFrame, exits: DataFrame, width: int = 600_000) -> DataFrame:
    """Per unit the load at its last entry that has a later exit: passages begun before it minus passages ended before it, in its run.

    A passage is an entry with any later exit of its unit, so an entry begins as many as it has later exits and an exit ends as many
    as it has earlier entries. Counts stand for the pairs, which are not made.
    """
    unit = ["run_id", "unit_id"]
    moves = entries.select(*unit, F.col("entry_ts").alias("__t"), F.lit(0).cast("long").alias("out"), F.lit(1).cast("long").alias("in")).unionByName(
        exits.select(*unit, F.col("exit_ts").alias("__t"), F.lit(1).cast("long").alias("out"), F.lit(0).cast("long").alias("in"))).filter(
        F.col("__t").isNotNull() & F.col("unit_id").isNotNull()).groupBy(*unit, "__t").agg(F.sum("in").alias("in"), F.sum("out").alias("out"))
    seen = running(moves, unit, ["__t"], {"ins": total("in"), "outs": total("out")}, width)
    whole = moves.groupBy(*unit).agg(F.sum("out").alias("all_out"))
    pairs = seen.join(whole, unit).select(*unit, "__t", (F.col("in") * (F.col("all_out") - F.col("outs"))).alias("begun"),
                                          (F.col("out") * (F.col("ins") - F.col("in"))).alias("ended"))
    at = pairs.groupBy("run_id", "__t").agg((F.sum("begun") - F.sum("ended")).alias("d"))
    before = running(at, ["run_id"], ["__t"], {"load": total("d")}, width, strict=True).select("run_id", F.col("__t").alias("entry_ts"), "load")
    last = pairs.filter("begun > 0").groupBy(*unit).agg(F.max("__t").alias("entry_ts"))
    return last.join(before, ["run_id", "entry_ts"]).select(*unit, F.col("load").alias("corridor_load"))


def boundary_allocation(entered: DataFrame, exited: DataFrame, units: DataFrame, members: DataFrame) -> DataFrame:
    """Total zone residence split over its stations in proportion to base cycle times.

    ``entered`` / ``exited``: run_id, zone_id, unit_id, timestamp_ms, event_sequence; ``members``: run_id, zone_id,
    station_id, pos, base_cycle_time_ms. Passages pair first in, first out; units still inside count in the load
    only. The last station takes the remainder, so parts add up.
    """
    edge = lambda df, kind: df.select(
        "run_id", F.col("zone_id").alias("station_id"), "unit_id", "timestamp_ms", "event_sequence", F.lit(kind).alias("event_type"))
    p = pair_fifo(edge(entered, "IN").unionByName(edge(exited, "OUT")), start="IN", end="OUT", keep_open=True)[0].select(
        "run_id", F.col("station_id").alias("zone_id"), "unit_id", F.col("processing_start").alias("entry_ts"), F.col("processing_end").alias("exit_ts"))
    p = corridor_load(p, ["run_id", "zone_id"]).filter("exit_ts IS NOT NULL")
    order = Window.partitionBy("run_id", "zone_id").orderBy("pos")
    w = F.greatest(F.col("base_cycle_time_ms").cast("double"), F.lit(1.0))
    m = (members.withColumn("w", w).withColumn("cum", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("tot", F.sum("w").over(Window.partitionBy("run_id", "zone_id")))
         .withColumn("is_last", F.col("pos") == F.max("pos").over(Window.partitionBy("run_id", "zone_id"))))
    total = (F.col("exit_ts") - F.col("entry_ts")).cast("double")
    lo = F.col("entry_ts") + total * (F.col("cum") - F.col("w")) / F.col("tot")
    hi = F.when(F.col("is_last"), F.col("exit_ts").cast("double")).otherwise(F.col("entry_ts") + total * F.col("cum") / F.col("tot"))
    v = units.select("run_id", "unit_id", F.col("vehicle_model").alias("variant"))
    return (p.join(m, ["run_id", "zone_id"]).join(v, ["run_id", "unit_id"], "left")
            .select("run_id", "zone_id", "unit_id", "station_id", F.coalesce("variant", F.lit("__UNKNOWN__")).alias("variant"),
                    F.col("load").alias("corridor_load"), lo.alias("station_entry_ms"), hi.alias("station_exit_ms")))


def _gamma_params(hist: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("n")
    g = hist.groupBy(*keys).agg(F.sum(n).alias("n"), (F.sum(n * F.col("x")) / F.sum(n)).alias("mean"), (F.sum(n * F.ln("x")) / F.sum(n)).alias("mean_log"))
    return g.withColumn("shape", gamma_shape(F.col("mean"), F.col("mean_log"))).withColumn("scale", sc.ratio("mean", "shape")).drop("mean_log")


def value_counts(dwell: DataFrame, keys: list[str], x: str = "dwell_s") -> DataFrame:
    """Positive dwell values as (keys, x, n), written out once: every fit below reads only this."""
    return cut_lineage(dwell.filter(F.col(x) > 0).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")))


def fit_dwell(dwell: DataFrame, x: str = "dwell_s", own_min: int = 30, pooled_min: int = 8, trim: bool = True) -> DataFrame:
    """Gamma fit per (station, variant), pooled per station where rows are too few, else no row."""
    return fit_counts(value_counts(dwell, ["station_id", "variant"], x), own_min, pooled_min, trim)


def fit_counts(hist: DataFrame, own_min: int, pooled_min: int = 8, trim: bool = True, extra: list[str] = ()) -> DataFrame:
    """The fit on value counts (station_id, variant, extra, x, n)."""
    extra = list(extra)

    def cut(keys: list[str]) -> DataFrame:
        return hist.join(trim_limits(hist, keys), keys).filter(within_limits("x")) if trim else hist

    pooled_keys, own_keys = ["station_id", *extra], ["station_id", "variant", *extra]
    pooled = _gamma_params(cut(pooled_keys), pooled_keys).filter((F.col("n") >= pooled_min) & F.col("shape").isNotNull()).select(
        *pooled_keys, F.struct("n", "mean", "shape", "scale").alias("p"))
    own = _gamma_params(cut(own_keys), own_keys)
    ok = (F.col("n") >= own_min) & F.col("shape").isNotNull()
    j = own.withColumn("o", F.when(ok, F.struct("n", "mean", "shape", "scale"))).select(*own_keys, "o").join(pooled, pooled_keys, "left")
    pick = F.coalesce("o", "p")
    return j.filter(pick.isNotNull()).select(*own_keys, pick["n"].alias("n"), pick["mean"].alias("mean"), pick["shape"].alias("shape"),
                                             pick["scale"].alias("scale"), F.col("o").isNull().alias("fallback"))


def _with_pooled(rows: DataFrame) -> DataFrame:
    return rows.unionByName(rows.withColumn("variant", F.lit(ALL)))


def fit_residence_by_load(residence: DataFrame, bin_min: int = 15, any_min: int = 20) -> DataFrame:
    """Residence models: by load band, for all loads, and - first station only - by single load.

    First stations keep their full distribution (both the free and the queued regime are real); inner
    ones are trimmed. Output level: 'band', 'all' or 'local'; load_key names the band or load. ``residence`` may be counted.
    """
    if "sl" in residence.columns:
        whole = cut_lineage(residence.groupBy("station_id", "variant", "is_first", "band", "corridor_load", "x").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sl")]))
        banded, counts = whole.filter("x IS NOT NULL").drop("corridor_load", "sx", "sl"), whole.filter("x IS NULL").drop("band", "x")
    else:
        counts = value_counts(residence, ["station_id", "variant", "is_first", "corridor_load"])
        banded = counts.groupBy("station_id", "variant", "is_first", sc.load_band("corridor_load").alias("band"), "x").agg(F.sum("n").alias("n"))

    def fits(rows: DataFrame, own_min: int, trim: bool, extra: list[str]) -> DataFrame:
        """Own variants with a pooled fallback, and the pooled variant by itself."""
        own = fit_counts(rows, own_min, trim=trim, extra=extra)
        return own.unionByName(fit_counts(rows.withColumn("variant", F.lit(ALL)), own_min, trim=trim, extra=extra))

    parts = []
    for rows, trim in ((banded.filter("NOT is_first"), True), (banded.filter("is_first"), False)):
        band = fits(rows, bin_min, trim, ["band"])
        parts.append(band.withColumn("level", F.lit("band")).withColumn("load_key", F.col("band")).drop("band"))
        parts.append(fits(rows, any_min, trim, []).withColumn("level", F.lit("all")).withColumn("load_key", F.lit("all")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # model tables are as small as stations x variants x loads; written out so that users do not refit
    return cut_lineage(out.withColumn("radius", F.lit(None).cast("int")).unionByName(local_load_models(counts.filter("is_first"))))


def local_load_models(counts: DataFrame, min_samples: int = 20) -> DataFrame:
    """First station, each integer load: fit on the smallest symmetric load neighbourhood with enough rows.

    Rows shrink to one histogram line per load. A neighbourhood that one ring less would leave too small holds fewer than ``min_samples``
    levels inside and two at its edge, so each load looks at that many levels on either side of it and at no others.
    """
    f = counts.withColumn("load", F.greatest(F.lit(0), F.round("corridor_load").cast("int")))
    n = F.col("n")
    if "sl" not in f.columns:
        f = f.withColumn("sx", n * F.col("x")).withColumn("sl", n * F.ln("x"))
    hist = cut_lineage(_with_pooled(f).groupBy("station_id", "variant", "load").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sl")]))
    levels = numbered(hist.filter(F.col("variant") == ALL).select("station_id", "load", "n"), ["station_id"], ["load"], 1 << 16)
    near = levels.select("station_id", F.explode(F.sequence(F.col("rn") - min_samples, F.col("rn") + min_samples)).alias("rn"), F.struct("load", "n").alias("l")).groupBy(
        "station_id", "rn").agg(F.collect_list("l").alias("near"))
    # a level stands for the loads from it up to the next one
    following = levels.select("station_id", (F.col("rn") - 1).alias("rn"), F.col("load").alias("next"))
    t = levels.join(following, ["station_id", "rn"], "left").join(near, ["station_id", "rn"]).select(
        "station_id", F.explode(F.sequence("load", F.coalesce(F.col("next") - 1, F.col("load")))).alias("target"), "near")
    rings = F.array_sort(F.transform("near", lambda l: F.struct(F.abs(l["load"] - F.col("target")).alias("r"), l["n"].alias("n"))))
    # nearest level first: acc counts rows, r is the first radius that is enough
    ring = F.aggregate(rings, F.struct(F.lit(0).cast("long").alias("acc"), F.lit(None).cast("int").alias("r")), lambda a, l: F.struct(
        (a["acc"] + l["n"]).cast("long").alias("acc"), F.when(a["r"].isNotNull(), a["r"]).when(a["acc"] + l["n"] >= min_samples, l["r"]).cast("int").alias("r")))
    # fewer rows than needed in total: the whole history is the neighbourhood
    reach = F.array_max(F.transform("near", lambda l: F.abs(l["load"] - F.col("target"))))
    picked = t.withColumn("radius", F.coalesce(ring["r"], reach)).select("station_id", "target", "radius", F.explode(F.filter(
        F.transform("near", lambda l: l["load"]), lambda l: F.abs(l - F.col("target")) <= F.col("radius"))).alias("load"))
    g = picked.join(hist, ["station_id", "load"]).groupBy("station_id", "variant", "target", "radius").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sl").alias("sl"))
    g = g.withColumn("mean", F.col("sx") / F.col("n")).withColumn("shape", gamma_shape(F.col("mean"), F.col("sl") / F.col("n"))).withColumn(
        "scale", sc.ratio("mean", "shape"))
    own_min, pooled_min = max(8, min_samples // 2), 8
    pooled = g.filter((F.col("variant") == ALL) & (F.col("n") >= pooled_min) & F.col("shape").isNotNull()).select(
        "station_id", "target", F.struct("n", "mean", "shape", "scale").alias("p"))
    ok = (F.col("n") >= own_min) & F.col("shape").isNotNull()
    j = g.withColumn("o", F.when(ok, F.struct("n", "mean", "shape", "scale"))).join(pooled, ["station_id", "target"], "left")
    pick = F.coalesce("o", "p")
    return j.filter(pick.isNotNull()).select(
        "station_id", "variant", pick["n"].alias("n"), pick["mean"].alias("mean"), pick["shape"].alias("shape"), pick["scale"].alias("scale"),
        F.col("o").isNull().alias("fallback"), F.lit("local").alias("level"), F.col("target").cast("string").alias("load_key"), F.col("radius").cast("int").alias("radius"))


def prior_from_config(stations: DataFrame) -> DataFrame:
    """Gamma by moments from the configured cycle; plus one global row from the mean of the stations."""
    mean = F.greatest(F.col("base_cycle_time_ms") / 1000.0, F.lit(1e-3))
    std = F.col("cycle_time_std_ms") / 1000.0
    s = (stations.withColumn("mean", mean).withColumn("std", F.when(F.coalesce(std, F.lit(0.0)) > 1e-6, std).otherwise(
        F.greatest(0.1 * F.col("mean"), F.lit(0.5)))))
    own = s.select("run_id", "station_id", "mean", "std")
    pooled = own.groupBy("run_id").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std")).withColumn("station_id", F.lit("__GLOBAL__"))
    both = own.unionByName(pooled)
    return both.withColumn("shape", F.pow(F.col("mean") / F.col("std"), 2)).withColumn("scale", F.col("std") * F.col("std") / F.col("mean"))


def rescale_priors(stations: DataFrame, windows: DataFrame) -> DataFrame:
    """Scale configured means and stds so that the corridor's sum equals its observed mean (seconds)."""
    observed = windows.filter("exit_ts IS NOT NULL").groupBy("run_id").agg(F.avg((F.col("exit_ts") - F.col("entry_ts")) / 1000.0).alias("observed"))
    mean, std = F.col("base_cycle_time_ms") / 1000.0, F.col("cycle_time_std_ms") / 1000.0
    declared = stations.groupBy("run_id").agg(F.sum(mean).alias("declared"))
    j = stations.join(declared, "run_id").join(observed, "run_id")
    k = F.col("observed") / F.col("declared")
    out = j.select("run_id", "station_id", k.alias("factor"), (mean * k).alias("mean"), (std * k).alias("std"))
    return out.withColumn("shape", F.pow(sc.ratio("mean", "std"), 2)).withColumn("scale", sc.ratio(F.col("std") * F.col("std"), "mean"))


def calibration_quality(requests: DataFrame, models: DataFrame, fallback: DataFrame) -> DataFrame:
    """Best available model of each request and how far to trust it, one row a request.

    Order: nearest local load (first stations), load band, all loads, plain dwell; own variant before pooled.
    Few rows and far loads lower the quality. Requests: request_id, station_id, variant, load, is_first. ``fallback``
    holds plain dwell fits by station and variant, pooled ones under ``__ALL__``.

    A (station, variant) has few models by band: they stand in one array and each request picks from its own and the pooled one.
    """
    entry = F.struct("level", F.col("load_key").try_cast("int").alias("at"), "load_key", "shape", "scale", "n", "radius")
    local = models.filter("level = 'local'").select("station_id", "variant", F.col("load_key").try_cast("int").alias("at"), entry.alias("m"))
    arrays = models.filter("level <> 'local'").groupBy("station_id", "variant").agg(F.array_sort(F.collect_list(entry)).alias("own"))
    pooled = arrays.filter(F.col("variant") == ALL).select("station_id", F.col("own").alias("pooled"))
    # local models are as many as there are loads: each load that is asked for finds its nearest by two as-of joins, and requests take it from there
    want = F.coalesce(F.col("load").cast("int"), F.lit(-(1 << 31)))
    asked = requests.filter("is_first").select("station_id", "variant", want.alias("want")).distinct()
    own = _nearest(asked, local).withColumnRenamed("m", "near_own")
    every = _nearest(asked.withColumn("variant", F.lit(ALL)).distinct(), local).select("station_id", "want", F.col("m").alias("near_all"))
    j = requests.withColumn("want", F.when(F.col("is_first"), want)).join(arrays, ["station_id", "variant"], "left").join(pooled, "station_id", "left").join(
        own, ["station_id", "variant", "want"], "left").join(every, ["station_id", "want"], "left")

    def exactly(side: str, level: str, key: Column) -> Column:
        return F.get(F.filter(side, lambda m: (m["level"] == level) & (m["load_key"] == key)), F.lit(0))

    def judged(m: Column, base: float, floor: float) -> Column:
        near = 1.0 / (1.0 + 0.08 * F.coalesce(m["radius"], F.lit(0))) if floor > 0.5 else F.lit(1.0)
        quality = F.lit(base) * F.least(F.lit(1.0), F.greatest(F.lit(floor), m["n"] / 80.0)) * near
        return F.when(m.isNotNull(), F.struct(m["level"].alias("level"), m["load_key"].alias("load_key"), m["shape"].alias("shape"), m["scale"].alias("scale"), quality.alias("quality")))

    band = sc.load_band("load")
    chain = [judged(F.col("near_own"), 0.97, 0.55), judged(F.col("near_all"), 0.92, 0.55), judged(exactly("own", "band", band), 0.95, 0.45),
             judged(exactly("pooled", "band", band), 0.88, 0.45), judged(exactly("own", "all", F.lit("all")), 0.68, 0.45), judged(exactly("pooled", "all", F.lit("all")), 0.60, 0.45)]
    picked = j.select(*requests.columns, F.coalesce(*chain).alias("m"))
    fit = F.struct("shape", "scale")
    own_fb = fallback.filter(F.col("variant") != ALL).select("station_id", "variant", fit.alias("f_own"))
    all_fb = fallback.filter(F.col("variant") == ALL).select("station_id", fit.alias("f_all"))
    fb = F.coalesce("f_own", "f_all")
    return picked.join(own_fb, ["station_id", "variant"], "left").join(all_fb, "station_id", "left").select(
        *requests.columns, F.coalesce("m.level", F.lit("processing_dwell")).alias("level"), F.col("m.load_key").alias("load_key"),
        F.coalesce("m.shape", fb["shape"]).alias("shape"), F.coalesce("m.scale", fb["scale"]).alias("scale"), F.coalesce("m.quality", F.lit(0.42)).alias("quality"))


def _nearest(asked: DataFrame, local: DataFrame, width: int = 1 << 10) -> DataFrame:
    """asked (station_id, variant, want) with the local model m whose load is closest to ``want``; the lower of two, none where there is none."""
    keys = ["station_id", "variant"]
    below = as_of(asked, local, keys, "want", "at", ["m"], ["m"], width).withColumnRenamed("m", "lo")
    back = local.withColumn("__back", -F.col("at").cast("long"))
    both = as_of(below.withColumn("__want", -F.col("want").cast("long")), back, keys, "__want", "__back", ["m"], ["m"], width)
    far = F.col("m.at").cast("long") - F.col("want") < F.col("want").cast("long") - F.col("lo.at")
    return both.select(*keys, "want", F.when(F.col("lo").isNull() | far, F.col("m")).otherwise(F.col("lo")).alias("m"))


def leave_one_run_out(per_run: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """History of each run = all training runs except itself, from additive per-run parts.

    ``per_run`` has one row per (run, keys) with a ``split``; a run's own part is subtracted from the
    training total, so no run x run product is formed. Validation runs see all training runs.
    """
    train = F.col("split") == "train"
    total = per_run.filter(train).groupBy(*keys).agg(*[F.sum(c).alias(f"t_{c}") for c in sums], F.count(F.lit(1)).alias("t_runs"))
    j = per_run.join(total, keys, "left")
    own = F.when(train, 1).otherwise(0)
    return j.select("run_id", "split", *keys, (F.coalesce("t_runs", F.lit(0)) - own).alias("history_runs"),
                    *[(F.coalesce(f"t_{c}", F.lit(0)) - own * F.col(c)).alias(f"history_{c}") for c in sums])


def history_guard(history: DataFrame, split: DataFrame) -> DataFrame:
    """History rows a run may not learn from: its own, and anything outside the training runs."""
    h = history.join(split.select(F.col("run_id").alias("history_run"), F.col("split").alias("history_split")), "history_run", "left")
    rule = F.when(F.col("history_run") == F.col("run_id"), "own_run_in_history").when(
        F.coalesce("history_split", F.lit("unknown")) != "train", "history_outside_training")
    return h.withColumn("rule", rule).filter("rule IS NOT NULL").select("rule", "run_id", F.col("history_run").alias("key"))


def detect_corridors(stations: DataFrame) -> DataFrame:
    """Maximal stretches of hidden stations by line order: single station or corridor, with neighbours."""
    order = Window.partitionBy("run_id").orderBy("station_index")
    s = (stations.select("run_id", "station_id", "station_index", "is_dark")
         .withColumn("before", F.lag("station_id").over(order)).withColumn("after", F.lead("station_id").over(order))
         .withColumn("island", F.sum(F.when(F.col("is_dark"), 0).otherwise(1)).over(order)))
    g = s.filter("is_dark").groupBy("run_id", "island").agg(
        F.min_by("station_id", "station_index").alias("first_station"), F.max_by("station_id", "station_index").alias("last_station"),
        F.count(F.lit(1)).alias("n_stations"), F.min_by("before", "station_index").alias("upstream_station"),
        F.max_by("after", "station_index").alias("downstream_station"))
    single = F.col("n_stations") == 1
    return g.select("run_id", F.when(single, F.concat(F.lit("DZ_"), "first_station")).otherwise(
        F.concat_ws("_", F.lit("DZ"), "first_station", "last_station")).alias("zone_id"), F.when(single, "single").otherwise("corridor").alias("kind"),
        "first_station", "last_station", "n_stations", "upstream_station", "downstream_station")


def dark_stations_from_events(stations: DataFrame, events: DataFrame) -> DataFrame:
    """Stations without a single event of their own are hidden; boundary events mark zone edges too."""
    own = events.filter(~F.col("event_type").isin("DARK_ZONE_ENTERED", "DARK_ZONE_EXITED")).select("run_id", "station_id").distinct()
    return stations.drop("is_dark").join(own.withColumn("__seen", F.lit(True)), ["run_id", "station_id"], "left").withColumn(
        "is_dark", F.col("__seen").isNull()).drop("__seen")
