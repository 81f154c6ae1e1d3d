"""Grouped summaries and audits. All of them merge map-side; none collects a group."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takt.contracts import SIGNALS
from takt.functions import scalar as sc
from takt.operators.slices import hist_quantiles, running, total
from takt.session import cut_lineage


def stream_summary(preds: DataFrame) -> DataFrame:
    """Shape of each run's prediction stream."""
    crossed = F.col("threshold_crossed") if "threshold_crossed" in preds.columns else F.lit(False)
    unknown = F.col("unknown_categories") if "unknown_categories" in preds.columns else F.lit(False)
    return preds.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.count_if("warning").alias("warning_count"),
        F.count_if(crossed).alias("crossed_count"), F.min("timestamp_ms").alias("first_timestamp_ms"),
        F.max("timestamp_ms").alias("last_timestamp_ms"), F.count_distinct("station_id").alias("stations"),
        F.count_distinct("unit_id").alias("units"), F.coalesce(F.bool_or(unknown), F.lit(False)).alias("unknown_categories_seen"))


def category_counts(preds: DataFrame, columns: Sequence[str] = ("route", "zone")) -> DataFrame:
    """Counts per run of each route and zone, as long rows."""
    long = preds.select("run_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(c).alias("value")) for c in columns])).alias("x")).select("run_id", "x.*")
    return long.filter(F.col("value").isNotNull() & (F.col("value") != "")).groupBy("run_id", "category", "value").agg(
        F.count(F.lit(1)).alias("n"))


def bus_summary(bus: DataFrame) -> DataFrame:
    kinds = ["STATION", "SENSOR", "MANUAL", "EVIDENCE"]
    k = sc.clean_text("record_type")
    return bus.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("records"), F.min_by("timestamp_ms", "sequence").alias("first_timestamp_ms"),
        F.max_by("timestamp_ms", "sequence").alias("last_timestamp_ms"),
        *[F.count_if(k == v).alias(f"n_{v.lower()}") for v in kinds])


def defect_rate(inspections: DataFrame, final: DataFrame, splits: DataFrame) -> DataFrame:
    """Last final-station result per unit, rolled up per run, per split and overall."""
    q = inspections.join(final.select("run_id", F.col("final_station").alias("station_id")), ["run_id", "station_id"], "left_semi")
    last = q.groupBy("run_id", "unit_id").agg(F.max_by(F.upper(F.trim("result")), F.struct("timestamp_ms", "event_sequence")).alias("result"))
    c = last.join(splits, "run_id").rollup("split", "run_id").agg(
        F.count_if(F.col("result") == "PASS").alias("pass_units"), F.count_if(F.col("result") == "FAIL").alias("defective_units"))
    n = F.col("pass_units") + F.col("defective_units")
    return c.select("split", "run_id", n.alias("total_units"), "pass_units", "defective_units",
                    sc.ratio("defective_units", n).alias("actual_defect_rate"))


def trim_limits(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Median, scaled median deviation and size per group from value counts (keys, x, n)."""
    keys = list(keys)
    h = hist.groupBy(*keys, F.col("x").alias("__x")).agg(F.sum("n").alias("__n"))
    med = hist_quantiles(h, keys, {"__med": 0.5})
    dev = h.join(med, keys).groupBy(*keys, F.abs(F.col("__x") - F.col("__med")).alias("__d")).agg(F.sum("__n").alias("__n")).withColumnRenamed("__d", "__x")
    mad = hist_quantiles(dev, keys, {"__mad": 0.5}).withColumn("__mad", F.col("__mad") * 1.4826)
    return h.groupBy(*keys).agg(F.sum("__n").alias("__size")).join(med, keys).join(mad, keys)


def within_limits(x, min_n: int = 8, limit: float = 3.5) -> Column:
    z = sc.ratio(F.abs(sc.col(x) - F.col("__med")), "__mad")
    return (F.col("__size") < min_n) | (F.col("__mad") == 0) | (z < limit)


def robust_trim(df: DataFrame, keys: Sequence[str], x: str, min_n: int = 8, limit: float = 3.5) -> DataFrame:
    """Drop values at 3.5 or more scaled median deviations; small groups and zero deviation stay whole.

    Median and deviation are exact. They come from merged value counts, written out once because the
    two scans over them would otherwise each go back to the source rows.
    """
    keys = list(keys)
    hist = cut_lineage(df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n")))
    return df.join(trim_limits(hist, keys), keys).filter(within_limits(x, min_n, limit)).select(*df.columns)


def feature_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per feature: NULL share, infinities, and whether the column is there at all (one pass, then long)."""
    have = [c for c in columns if c in df.columns]
    kinds = dict(df.dtypes)
    inf = {c: F.count_if(F.abs(F.col(c)) == float("inf")) if kinds[c] in ("double", "float") else F.lit(0).cast("long") for c in have}
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in have],
                 *[(inf[c] if kinds[c] in ("double", "float") else F.max(F.lit(0)).cast("long")).alias(f"i_{c}") for c in have])
    cells = [F.struct(F.lit(c).alias("feature"), F.lit(c in have).alias("present"),
                      (sc.ratio(F.col(f"n_{c}"), "n") if c in have else F.lit(None).cast("double")).alias("null_rate"),
                      (F.col(f"i_{c}") if c in have else F.lit(None).cast("long")).alias("infinite_count")) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("x")).select("x.*")


def signal_coverage(features: DataFrame) -> DataFrame:
    """Share of prediction rows with any past and with any recent value of each signal."""
    def seen(signal: str, past: str) -> Column:
        have = [f"{signal.lower()}_{stat}_{past}" for stat in ("mean", "max") if f"{signal.lower()}_{stat}_{past}" in features.columns]
        return F.coalesce(*[F.col(c) for c in have]).isNotNull().cast("double")

    row = features.groupBy("run_id").agg(*[F.avg(seen(s, k)).alias(f"{k[0]}_{s}") for s in SIGNALS for k in ("history", "recent")])
    return row.select("run_id", F.explode(F.array(*[F.struct(
        F.lit(s).alias("signal"), F.col(f"h_{s}").alias("history_coverage"), F.col(f"r_{s}").alias("recent_coverage"))
        for s in SIGNALS])).alias("x")).select("run_id", "x.*")


def contract_audit(stations: DataFrame, events: DataFrame, sensors: DataFrame, required: Sequence[str] = tuple(SIGNALS)) -> DataFrame:
    """Per run: stations, signals, event types, and the state of the torque readings."""
    st = stations.groupBy("run_id").agg(F.count_distinct("station_id").alias("station_count"))
    et = events.groupBy("run_id").agg(F.array_sort(F.collect_set(sc.clean_text("event_type"))).alias("event_types"))
    torque = sc.clean_text("sensor_type") == "TORQUE"
    has_station = F.coalesce(F.trim("station_id") != "", F.lit(False))
    bad = F.col("timestamp_ms").isNull() | F.col("value").isNull() | ~has_station
    sg = sensors.groupBy("run_id").agg(
        F.array_sort(F.collect_set(sc.clean_text("sensor_type"))).alias("signals"), F.count_if(torque).alias("torque_rows"),
        F.count_distinct(F.when(torque & has_station, F.col("station_id"))).alias("torque_stations"),
        F.min(F.when(torque & ~bad, F.col("timestamp_ms"))).alias("torque_first_ms"),
        F.max(F.when(torque & ~bad, F.col("timestamp_ms"))).alias("torque_last_ms"), F.count_if(torque & bad).alias("torque_invalid"))
    j = st.join(et, "run_id", "left").join(sg, "run_id", "left")
    return j.withColumn("missing_signals", F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce("signals", F.array().cast("array<string>")))
                        ).withColumn("torque_usable", F.coalesce((F.col("torque_rows") > 0) & (F.col("torque_invalid") == 0), F.lit(False)))


def queue_moments(p: Column | str, quality: Column | str) -> list[Column]:
    """Aggregates giving the moments of max(N - 1, 0) for independent presences with chance p.

    P0 = prod(1 - p): E = sum(p) - 1 + P0 and E2 = sum(p (1 - p)) + (sum(p) - 1)^2 - P0.
    """
    p = sc.col(p)
    s1, sv = F.sum(p), F.sum(p * (1 - p))
    p0 = F.product(1 - p)
    mean = s1 - 1 + p0
    var = sv + (s1 - 1) * (s1 - 1) - p0 - mean * mean
    std = F.sqrt(F.greatest(F.lit(0.0), var))
    return [mean.alias("queue_mean"), std.alias("queue_std"), (F.exp(-std) * F.min(quality)).alias("confidence")]


def poisson_binomial_queue(probs: DataFrame, keys: Sequence[str], p: str = "p", quality: str = "quality") -> DataFrame:
    return probs.groupBy(*keys).agg(*queue_moments(p, quality))


def weighted_stats(df: DataFrame, keys: Sequence[str], x: str, w: str, q: float) -> DataFrame:
    """Weighted mean, std and quantile (first value whose cumulative weight reaches the share q)."""
    keys = list(keys)
    ok = df.filter(sc.clean_number(x).isNotNull() & sc.clean_number(w).isNotNull() & (F.col(w) >= 0))
    hist = ok.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.sum(w).alias("w"))
    X = F.col("x")
    cum = running(hist, keys, ["x"], {"cum": total("w")}, slice_col=(F.signum(X) * F.floor(F.log2(1 + F.abs(X)) * 32)).cast("long"))
    m = hist.groupBy(*keys).agg(F.sum("w").alias("sw"), F.sum(X * F.col("w")).alias("sxw"), F.sum(X * X * F.col("w")).alias("sxxw"),
                                F.max("x").alias("top")).filter("sw > 0")
    mean = F.col("sxw") / F.col("sw")
    j = cum.join(m, keys).groupBy(*keys).agg(
        F.first(mean).alias("w_mean"), F.first(F.sqrt(F.greatest(F.lit(0.0), F.col("sxxw") / F.col("sw") - mean * mean))).alias("w_std"),
        F.coalesce(F.min(F.when(F.col("cum") / F.col("sw") >= q - 1e-12, X)), F.max("top")).alias("w_quantile"))
    return j


def event_type_counts(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Event types with counts; not in the mapping = unrecognised, mapped to nothing = ignored."""
    c = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    m = mapping.withColumn("__in", F.lit(True))
    return c.join(m, "event_type", "left").select("event_type", "n", F.when(F.col("__in").isNull(), "unrecognized").when(
        F.col("target").isNull(), "ignored").otherwise("mapped").alias("status"))
