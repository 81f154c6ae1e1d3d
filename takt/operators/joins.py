"""Pairing, interval, as-of, range and key-set joins."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from takt.functions import scalar as sc
from takt.operators.slices import UNBOUNDED, as_of, slice_number


def dimension_join(facts: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join; ``dimension_missing`` marks facts without a dimension row."""
    marked = dim.withColumn("__hit", F.lit(True))
    out = facts.join(marked, list(keys), "left")
    return out.withColumn("dimension_missing", F.col("__hit").isNull()).drop("__hit")


def pair_by_key(entries: DataFrame, exits: DataFrame, keys=("run_id", "unit_id", "station_id")) -> DataFrame:
    """Every entry with every later exit of the same key (``entry_ts`` < ``exit_ts``)."""
    a = entries.select(*keys, F.col("timestamp_ms").alias("entry_ts"))
    z = exits.select(*keys, F.col("timestamp_ms").alias("exit_ts"))
    return a.join(z, list(keys)).filter(F.col("exit_ts") > F.col("entry_ts"))


def pair_fifo(events: DataFrame, keys=("run_id", "unit_id", "station_id"), start="PROCESSING_STARTED",
              end="PROCESSING_COMPLETED", width: int = 600_000, keep_open: bool = False, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """First-in first-out intervals and per-run pairing counts; with ``keep_open`` starts without an end too.

    With D = completions - starts so far and U = the largest D seen before (at least 0), a
    completion finds an open start iff D <= U, and that start is number C - U. Both sides then meet
    in one grouping on (key, ordinal); D and U are scanned slice-wise, so no key is held whole.
    """
    keys = list(keys)
    e = (events.filter(F.col("event_type").isin(start, end) & F.col("unit_id").isNotNull()
                       & F.col("station_id").isNotNull() & F.col("timestamp_ms").isNotNull())
         .select(*keys, "timestamp_ms", "event_sequence",
                 F.when(F.col("event_type") == start, 1).otherwise(0).cast("long").alias("is_start"))
         .withColumn("slice", slice_number("timestamp_ms", width)))
    if tasks:
        e = e.repartition(tasks, *keys, "slice")
    w = Window.partitionBy(*keys, "slice").orderBy("timestamp_ms", "event_sequence")
    upto, before = w.rowsBetween(UNBOUNDED, 0), w.rowsBetween(UNBOUNDED, -1)
    local = (e.withColumn("s_l", F.sum("is_start").over(upto))
             .withColumn("d_l", F.sum(1 - 2 * F.col("is_start")).over(upto))
             .withColumn("m_l", F.max("d_l").over(before)))
    sums = local.groupBy(*keys, "slice").agg(F.sum("is_start").alias("s"),
                                             F.sum(1 - 2 * F.col("is_start")).alias("d"),
                                             F.max("d_l").alias("m"))
    earlier = Window.partitionBy(*keys).orderBy("slice").rowsBetween(UNBOUNDED, -1)
    carried = (sums.withColumn("s_b", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
               .withColumn("d_b", F.coalesce(F.sum("d").over(earlier), F.lit(0)))
               .withColumn("u_b", F.max(F.col("d_b") + F.col("m")).over(earlier))
               .select(*keys, "slice", "s_b", "d_b", "u_b"))
    rows = local.join(carried, [*keys, "slice"])
    d, s = F.col("d_b") + F.col("d_l"), F.col("s_b") + F.col("s_l")
    u = F.greatest(F.lit(0), F.col("u_b"), F.col("d_b") + F.col("m_l"))
    ordinal = F.when(F.col("is_start") == 1, s).when(d <= u, d + s - u)
    rows = rows.withColumn("ordinal", ordinal)
    if tasks:  # the two sides of a pair mostly come from different tasks
        rows = rows.repartition(tasks, *keys, "ordinal")
    paired = (rows.groupBy(*keys, "ordinal",
              F.when(F.col("ordinal").isNull(), F.col("event_sequence")).alias("lone")).agg(
        F.max(F.when(F.col("is_start") == 1, F.col("timestamp_ms"))).alias("processing_start"),
        F.max(F.when(F.col("is_start") == 0, F.col("timestamp_ms"))).alias("processing_end"),
        F.max(F.when(F.col("is_start") == 1, F.col("event_sequence"))).alias("start_event_sequence"),
        F.max(F.when(F.col("is_start") == 0, F.col("event_sequence"))).alias("end_event_sequence")))
    both = F.col("processing_start").isNotNull() & F.col("processing_end").isNotNull()
    positive = F.col("processing_end") > F.col("processing_start")
    still = F.col("processing_end").isNull() if keep_open else F.lit(False)
    intervals = paired.filter(both & positive | still).drop("ordinal", "lone")
    diagnostics = paired.groupBy("run_id").agg(
        F.count_if(both & positive).alias("valid_intervals"),
        F.count_if(F.col("processing_end").isNull()).alias("unmatched_starts"),
        F.count_if(F.col("processing_start").isNull()).alias("unmatched_completions"),
        F.count_if(both & ~positive).alias("invalid_intervals"))
    return intervals, diagnostics


def assign_by_interval(readings: DataFrame, intervals: DataFrame, width: int = 600_000, tasks: int | None = None) -> DataFrame:
    """Reading -> unit being processed at its station; the latest start wins, both ends inclusive."""
    r = intervals.select("run_id", "station_id", F.col("unit_id").alias("assigned_unit_id"),
                         "processing_start", "processing_end", "start_event_sequence")
    got = as_of(readings, r, ["run_id", "station_id"], "timestamp_ms", "processing_start",
                ["assigned_unit_id", "processing_start", "processing_end"],
                right_tie=["processing_end", "start_event_sequence"], width=width, tasks=tasks)
    return got.filter(F.col("timestamp_ms") <= F.col("processing_end"))


def latest_at_or_before(preds: DataFrame, times: DataFrame, key: str, take: Sequence[str],
                        width: int = 600_000) -> DataFrame:
    """Latest prediction of a key at or before each display time (times carry run, key, display_ms)."""
    keys = ["run_id", key]
    got = as_of(times, preds, keys, "display_ms", "timestamp_ms", list(take), right_tie=["emission"], width=width)
    return got.filter(F.col(take[0]).isNotNull())


def parity_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
                tol: float = 1e-12) -> DataFrame:
    """Per column: rows on both sides / one side, mismatches (NULL equals NULL), largest difference."""
    keys = list(keys)
    l = a.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in cols], F.lit(1).alias("in_a"))
    r = b.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in cols], F.lit(1).alias("in_b"))
    j = l.join(r, keys, "full_outer")
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    aggs = [F.count_if(both).alias("n_both"), F.count_if(F.col("in_b").isNull()).alias("left_only"),
            F.count_if(F.col("in_a").isNull()).alias("right_only")]
    for c in cols:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        gap = F.abs(x - y)
        same = (x.isNull() & y.isNull()) | F.coalesce(gap <= tol + tol * F.abs(y), F.lit(False))
        aggs += [F.count_if(both & ~same).alias(f"m_{c}"), F.max(F.when(both, gap)).alias(f"g_{c}")]
    per_col = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mismatches"),
                                           F.col(f"g_{c}").alias("max_abs_diff")) for c in cols]))
    return j.agg(*aggs).select("n_both", "left_only", "right_only", per_col.alias("x")).select(
        "n_both", "left_only", "right_only", "x.*")


def expand_ranges(zones: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Zone start..end (inclusive, by line position) -> member stations, plus violations."""
    pos = stations.select("run_id", "station_id", F.col("station_index").alias("pos"))
    z = (zones.join(pos.select("run_id", F.col("station_id").alias("start_station_id"), F.col("pos").alias("lo")),
                    ["run_id", "start_station_id"], "left")
         .join(pos.select("run_id", F.col("station_id").alias("end_station_id"), F.col("pos").alias("hi")),
               ["run_id", "end_station_id"], "left"))
    ok = F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("lo") <= F.col("hi"))
    flags = [c for c in ("sensor_telemetry", "manual_checks", "checkpoints") if c in zones.columns]
    members = (z.filter(ok).withColumn("pos", F.explode(F.sequence("lo", "hi")))
               .join(pos, ["run_id", "pos"]).select("run_id", "dark_zone_id", "station_id", "pos", "lo", "hi", *flags))
    bad = z.filter(F.coalesce(~ok, F.lit(True))).select(
        F.when(F.col("lo").isNull() | F.col("hi").isNull(), "unknown_zone_station")
        .otherwise("reversed_zone_range").alias("rule"), "run_id", F.col("dark_zone_id").alias("key"),
        F.concat_ws("..", "start_station_id", "end_station_id").alias("detail"))
    return members, bad


def dark_flags(members: DataFrame) -> DataFrame:
    """Per station: is it hidden, and what a hidden station still shows."""
    return members.groupBy("run_id", "station_id").agg(
        F.lit(True).alias("is_dark"), F.bool_or("sensor_telemetry").alias("sensor_visible"),
        F.bool_or("manual_checks").alias("manual_visible"), F.bool_or("checkpoints").alias("checkpoint_visible"))


def keep_units(df: DataFrame, units: DataFrame, keys=("run_id", "unit_id")) -> DataFrame:
    return df.join(units, list(keys), "left_semi")


def orphans(df: DataFrame, dim: DataFrame, keys) -> DataFrame:
    return df.join(dim, list(keys), "left_anti")


def checkpoint_window_check(checkpoints: DataFrame, intervals: DataFrame, width: int = 600_000) -> DataFrame:
    """Drop checkpoints outside every observed interval of their unit; units never seen are kept."""
    keys = ["run_id", "unit_id", "station_id"]
    spans = intervals.select(*keys, "processing_start", "processing_end", "start_event_sequence")
    # inside some interval <=> the largest end among intervals started by then reaches the checkpoint
    from takt.operators.slices import peak, running
    both = (checkpoints.select(*keys, F.col("timestamp_ms").alias("__t"), F.lit(1).alias("__k"),
                               F.struct(*[F.col(c) for c in checkpoints.columns]).alias("__row"))
            .unionByName(spans.select(*keys, F.col("processing_start").alias("__t"), F.lit(0).alias("__k"),
                                      F.col("processing_end").alias("__end")), allowMissingColumns=True))
    marked = running(both, keys, ["__t", "__k"], {"__reach": peak("__end")}, width).filter(F.col("__k") == 1)
    known = spans.select(*keys).distinct().withColumn("__known", F.lit(True))
    return (marked.join(known, keys, "left")
            .filter(F.col("__known").isNull() | (F.col("__reach") >= F.col("__t"))).select("__row.*"))


def checkpoint_progress(events: DataFrame, defs: DataFrame) -> DataFrame:
    """(station, checkpoint) -> nominal progress; anonymous events only from POWER_DRAW points."""
    return (events.join(defs.select("run_id", "station_id", "checkpoint_id", "checkpoint_type",
                                    "nominal_progress_fraction"), ["run_id", "station_id", "checkpoint_id"])
            .filter(F.col("unit_id").isNotNull() | (F.col("checkpoint_type") == "POWER_DRAW")))


def nearest_load(requests: DataFrame, models: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Model with the load closest to the requested one, own variant first, then ``__ALL__``; the lower of two.

    A (station, variant) has as few models as load levels: they stand in one array, each request picks from it,
    and no request is paired with every level.
    """
    level = F.struct("load", "mean", "std", "n")
    arrays = models.groupBy("station_id", "variant").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    own = arrays.select("station_id", "variant", F.col("levels").alias("own"))
    pooled = arrays.filter("variant = '__ALL__'").select("station_id", F.col("levels").alias("pooled"))
    j = requests.join(own, ["station_id", "variant"], "left").join(pooled, "station_id", "left")
    pick = F.aggregate(F.coalesce("own", "pooled"), F.lit(None).cast(arrays.schema["levels"].dataType.elementType), lambda best, m: F.when(
        best.isNull() | (F.abs(m["load"] - F.col("target_load")) < F.abs(best["load"] - F.col("target_load"))), m).otherwise(best))
    level = F.when(F.col("own").isNotNull(), 0).when(F.col("pooled").isNotNull(), 1)
    return j.select(*requests.columns, level.alias("level"), pick.alias("m")).select(*requests.columns, "level", "m.*")


def unrecorded_runs(runs: DataFrame, history: DataFrame) -> DataFrame:
    return runs.filter("complete").join(history.select("run_id"), "run_id", "left_anti")


def artifact_match(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """Run -> prediction folder: by manifest run folder, then batch name, then run id; newest wins."""
    newest = lambda key: manifests.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by("predictions_dir", F.struct("generated_at", "predictions_dir")).alias("d"))
    by_dir = newest("run_dir").select("run_dir", F.col("d").alias("d1"))
    by_batch = newest("batch_name").select("batch_name", F.col("d").alias("d2"))
    by_run = newest("run_id").select("run_id", F.col("d").alias("d3"))
    j = runs.join(by_dir, "run_dir", "left").join(by_batch, "batch_name", "left").join(by_run, "run_id", "left")
    return j.select(*runs.columns, F.coalesce("d1", "d2", "d3").alias("predictions_dir"),
                    F.when(F.col("d1").isNotNull(), "manifest").when(F.col("d2").isNotNull(), "batch_name")
                    .when(F.col("d3").isNotNull(), "run_name").otherwise("none").alias("matched_by"))


def oracle_compare(pred: DataFrame, truth: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per feature over rows known on both sides: n, MAE, RMSE, bias and rank correlation."""
    from takt.operators.slices import running, total
    keys = list(keys)
    j = (pred.select(*keys, *[F.col(c).cast("double").alias(f"p_{c}") for c in cols])
         .join(truth.select(*keys, *[F.col(c).cast("double").alias(f"t_{c}") for c in cols]), keys))
    long = j.select(*keys, F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"p_{c}").alias("p"), F.col(f"t_{c}").alias("t")) for c in cols])).alias("x")
    ).select(*keys, "x.*").filter(F.col("p").isNotNull() & F.col("t").isNotNull())

    def mid_rank(value: str) -> DataFrame:
        """Average rank of each distinct value per feature, from counts (never from row lists)."""
        hist = long.groupBy("feature", value).agg(F.count(F.lit(1)).alias("n"))
        bucket = (F.signum(value) * F.floor(F.log2(1 + F.abs(F.col(value))) * 32)).cast("long")
        cum = running(hist, ["feature"], [value], {"cum": total("n")}, slice_col=bucket)
        return cum.select("feature", value, (F.col("cum") - (F.col("n") - 1) / 2).alias(f"rank_{value}"))

    ranked = long.join(mid_rank("p"), ["feature", "p"]).join(mid_rank("t"), ["feature", "t"])
    err = F.col("p") - F.col("t")
    return ranked.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(err).alias("bias"), F.try_divide(F.covar_pop("rank_p", "rank_t"), F.nullif(
            F.stddev_pop("rank_p") * F.stddev_pop("rank_t"), F.lit(0.0))).alias("spearman"))
