"""Per-key series operators built on sliced scans (see ``slices``)."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takt.operators.slices import last_rows, latest, numbered, peak, previous, running, slice_number, total

EMA_ALPHAS = (0.3, 0.5, 0.7)
EMA_BLOCK = 1 << 16


def ema_name(alpha: float) -> str:
    return f"ema_{int(alpha * 10):02d}"


def exponential_means(numbered_rows: DataFrame, keys: list[str], score: str, block: int = EMA_BLOCK) -> DataFrame:
    """Ordered exponential means of every row of a numbered key (``rn`` from 1), whole histories included.

    A score x that comes g rows after the last one moves the mean e to (b^g e + a x) / (b^g + a) with b = 1 - a;
    rows without a score repeat the mean before them. Such steps e -> p e + s compose, so rows are folded inside
    blocks of equal size, blocks to one (p, s) each, and the mean before a block is folded from the blocks
    before it. No task holds more than a block's batch, no row an array.
    """
    gap = running(numbered_rows, keys, ["rn"], {"__last": latest(F.when(F.col(score).isNotNull(), F.col("rn")))}, block, strict=True)
    rows = gap.withColumn("__block", slice_number(F.col("rn") - 1, block)).withColumn("__gap", F.col("rn") - F.col("__last")).drop("__last")
    folded = [f"__{x}_{ema_name(a)}" for a in EMA_ALPHAS for x in "ps"]
    schema = rows.schema
    for name in folded:
        schema = schema.add(name, "double")
    names = [*keys, "__block"]

    def fold(batches):
        group, state = None, None
        for part in batches:
            made = np.empty((len(part), len(folded)))
            groups = list(zip(*[part[c] for c in names]))
            gaps, values = part["__gap"].to_numpy(float), part[score].to_numpy(float)
            for i, g in enumerate(groups):
                if g != group:
                    group, state = g, [1.0, 0.0] * len(EMA_ALPHAS)
                x = values[i]
                if x == x:
                    for k, alpha in enumerate(EMA_ALPHAS):
                        if gaps[i] == gaps[i]:
                            old = (1 - alpha) ** gaps[i]
                            p, s = old / (old + alpha), alpha * x / (old + alpha)
                        else:  # the key's first score
                            p, s = 0.0, x
                        state[2 * k:2 * k + 2] = p * state[2 * k], p * state[2 * k + 1] + s
                made[i] = state
            yield part.assign(**{name: made[:, k] for k, name in enumerate(folded)})

    scanned = rows.repartition(*names).sortWithinPartitions(*names, "rn").mapInPandas(fold, schema)
    ends = scanned.groupBy(*names).agg(*[F.max_by(c, "rn").alias(c) for c in folded])
    # one row a block of a key: lists as short as rows / block
    held = F.array_sort(F.collect_list(F.struct("__block", *folded)))
    before = ends.groupBy(*keys).agg(held.alias("__ends"))
    out = scanned.filter("__block = 0").withColumn("__ends", F.lit(None).cast(before.schema["__ends"].dataType)).unionByName(
        scanned.filter("__block > 0").join(before, keys))

    def carried(alpha: float) -> Column:
        p, s = f"__p_{ema_name(alpha)}", f"__s_{ema_name(alpha)}"
        earlier = F.filter(F.coalesce("__ends", F.array().cast(before.schema["__ends"].dataType)), lambda b: b["__block"] < F.col("__block"))
        start = F.aggregate(earlier, F.lit(0.0), lambda e, b: b[p] * e + b[s])
        return F.when(F.col(score).isNotNull() | F.col("__gap").isNotNull(), F.col(p) * start + F.col(s)).alias(ema_name(alpha))

    return out.select(*numbered_rows.columns, *[carried(a) for a in EMA_ALPHAS])


def second_highest(scores: Column) -> Column:
    """Second largest value of an array (NULLs already dropped), NULL under two values."""
    return F.get(F.reverse(F.array_sort(scores)), F.lit(1))


def alert_policies(scored: DataFrame, keys=("run_id", "unit_id"), order="seq", score="score",
                   width: int = 1 << 16) -> DataFrame:
    """Six policy columns per row: raw, three exponential means, two in a row, two of three."""
    n = exponential_means(numbered(scored, list(keys), [order], width), list(keys), score)
    s = F.col(score)
    # structs keep rows without a score in their places
    lists = last_rows(n, list(keys), "rn", {"__r3": F.collect_list(F.struct(s.alias("v")))}, back=2)
    prev = F.when(F.col("rn") > 1, F.get(F.col("__r3"), F.size("__r3") - 2)["v"])
    return lists.select(
        *scored.columns, s.alias("raw"), *[ema_name(a) for a in EMA_ALPHAS],
        F.when(prev.isNotNull() & s.isNotNull(), F.least(s, prev)).alias("two_consecutive"),
        second_highest(F.filter(F.col("__r3.v"), lambda x: x.isNotNull())).alias("two_of_three"))


def prev_next(df: DataFrame, keys, order, value: str, flag: str, width: int = 1 << 16) -> DataFrame:
    """Previous value and previous flag of the same key."""
    return previous(df, list(keys), [order], {"prev_value": value, "prev_flag": flag}, width)


def _flag_scan(preds: DataFrame, key: str, width: int) -> DataFrame:
    """Previous record of the key and the number of unflagged records before it (the island id)."""
    held = F.struct(F.col("timestamp_ms").alias("ts"), F.col("warning").alias("w"))
    return running(preds, ["run_id", key], ["emission"], {
        "prev": latest(held), "island": total(F.when(~F.col("warning"), 1))}, width, strict=True)


def warning_periods(preds: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """Contiguous flagged records of a key; the last one is open while nothing unflagged follows."""
    s = _flag_scan(preds, key, width)
    islands = s.filter("warning").groupBy("run_id", key, "island").agg(
        F.min_by("timestamp_ms", "emission").alias("start_ms"), F.max_by("timestamp_ms", "emission").alias("end_ms"),
        F.count(F.lit(1)).alias("point_count"))
    ends = preds.groupBy("run_id", key).agg(F.count_if(~F.col("warning")).alias("all_clear"))
    return (islands.join(ends, ["run_id", key])
            .select("run_id", key, "start_ms", "end_ms", "point_count",
                    (F.col("island") == F.col("all_clear")).alias("open_ended")))


def warning_totals(preds: DataFrame, key: str, width: int = 1 << 16) -> DataFrame:
    """Per key: crossings into warning and time between consecutive flagged records."""
    s = _flag_scan(preds, key, width)
    was = F.coalesce(F.col("prev.w"), F.lit(False))
    gap = F.greatest(F.lit(0), F.col("timestamp_ms") - F.col("prev.ts"))
    return s.groupBy("run_id", key).agg(
        F.count_if(F.col("warning") & ~was).alias("threshold_crossings"),
        F.coalesce(F.sum(F.when(F.col("warning") & was, gap)), F.lit(0)).alias("time_above_ms"))


def trend(preds: DataFrame, key: str, window: int = 20, deadband: float = 0.02) -> DataFrame:
    """Mean of the newest points against the equally long stretch before them."""
    from pyspark.sql import Window
    keys = ["run_id", key]
    counts = preds.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    # only the newest 2 * window points per key can matter: the rank filter is applied before the shuffle
    newest = (preds.select(*keys, "emission", "probability").withColumn("r", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.col("emission").desc()))).filter(F.col("r") <= 2 * window))
    j = newest.join(counts, keys).withColumn("w", F.least(F.lit(window), F.floor(F.col("n") / 2)))
    late = F.avg(F.when(F.col("r") <= F.col("w"), F.col("probability")))
    early = F.avg(F.when((F.col("r") > F.col("w")) & (F.col("r") <= 2 * F.col("w")), F.col("probability")))
    got = j.groupBy(*keys).agg(F.max("n").alias("n"), (late - early).alias("d"))
    delta = F.when(F.col("n") >= 4, F.col("d")).otherwise(0.0)
    return got.select(*keys, F.when(F.col("n") < 4, "UNKNOWN").when(F.abs(delta) < deadband, "STABLE")
                      .when(delta > 0, "RISING").otherwise("FALLING").alias("trend"), delta.alias("trend_delta"))


def corridor_load(intervals: DataFrame, keys=("run_id",), width: int = 600_000) -> DataFrame:
    """Units inside at each entry: entries strictly before minus exits strictly before. A NULL exit is a unit still inside."""
    keys = list(keys)
    ask = intervals.select(*keys, F.col("entry_ts").alias("__t"), F.lit(0).alias("__k"), F.lit(0).alias("__d"),
                           F.struct(*[F.col(c) for c in intervals.columns]).alias("__row"))
    moves = intervals.select(*keys, F.explode(F.array(
        F.struct(F.col("entry_ts").alias("t"), F.lit(1).alias("d")),
        F.struct(F.col("exit_ts").alias("t"), F.lit(-1).alias("d")))).alias("m")).select(
        *keys, F.col("m.t").alias("__t"), F.lit(1).alias("__k"), F.col("m.d").alias("__d")).filter(F.col("__t").isNotNull())
    both = ask.unionByName(moves, allowMissingColumns=True)
    out = running(both, keys, ["__t", "__k"], {"load": total("__d")}, width)
    return out.filter(F.col("__k") == 0).select("__row.*", "load")


def station_overlaps(intervals: DataFrame, width: int = 600_000) -> DataFrame:
    """Per station: intervals starting before the previous one (by start, end) has ended."""
    p = previous(intervals, ["run_id", "station_id"], ["processing_start", "processing_end", "start_event_sequence"],
                 {"prev_end": "processing_end"}, width)
    return p.groupBy("run_id", "station_id").agg(
        F.count(F.lit(1)).alias("intervals"),
        F.count_if(F.col("processing_start") < F.col("prev_end")).alias("overlaps"))


def monotone_filter(arrivals: DataFrame, min_confidence: float, width: int = 600_000) -> DataFrame:
    """Accept inferred stations that move a unit downstream.

    The first arrival of a unit counts at any confidence; later ones only from ``min_confidence``.
    A row is accepted iff it is eligible and lies beyond every eligible row before it, because an
    eligible row that goes further is always accepted itself.
    """
    keys, order = ["run_id", "unit_id"], ["timestamp_ms", "station_index", "seq"]
    firsts = arrivals.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    a = (arrivals.join(firsts, keys)
         .withColumn("__ok", (F.struct(*order) == F.col("__first")) | (F.col("state_confidence") >= min_confidence)))
    r = running(a, keys, order, {"__reach": peak(F.when(F.col("__ok"), F.col("station_index")))}, width, strict=True)
    verdict = (F.when(F.col("station_index") == F.col("__reach"), "refresh")
               .when(F.col("station_index") < F.col("__reach"), "backward")
               .when(~F.col("__ok"), "low_confidence").otherwise("accepted"))
    return r.select(*arrivals.columns, verdict.alias("verdict"))
