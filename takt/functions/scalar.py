"""Column expressions shared by every operator (no Python runs per row)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """num / den, NULL (not an error) on a zero denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def rate(num, den) -> Column:
    """num / den, 0 on a zero denominator."""
    return F.coalesce(ratio(num, den), F.lit(0.0))


def station_index(station_id) -> Column:
    """'S07' -> 6; NULL when the id does not follow the pattern."""
    return F.regexp_extract(col(station_id), r"^S(\d+)", 1).try_cast("int") - 1


def line_fraction(index, n_stations) -> Column:
    return col(index) / F.greatest(F.lit(1), col(n_stations) - 1)


def clean_number(c) -> Column:
    """Unparsable text, NaN and infinities become NULL."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def clean_text(c) -> Column:
    return F.nullif(F.upper(F.trim(col(c))), F.lit(""))


def truthy(c) -> Column:
    return F.coalesce(F.lower(F.trim(col(c))).isin("true", "1", "yes", "y"), F.lit(False))


def headroom(occ, cap) -> Column:
    return col(cap) - col(occ)


def utilization(occ, cap) -> Column:
    return ratio(occ, cap)


def at_capacity(occ, cap) -> Column:
    return col(occ) >= col(cap)


def state_confidence(queue, ts, last_ts, decay_ms: int = 600_000) -> Column:
    """1 when reported on this event, 0 when never reported, else decays with the silence."""
    return (F.when(col(queue).isNotNull(), 1.0).when(col(last_ts).isNull(), 0.0)
            .otherwise(F.exp(-(col(ts) - col(last_ts)).cast("double") / decay_ms)))


def progress_std(queue, last_ts, queue_std, steps) -> Column:
    return (F.when(col(queue).isNotNull(), 0.0).when(col(last_ts).isNull(), F.lit(None))
            .otherwise(col(queue_std) * F.sqrt(col(steps))))


def eta_std(room, slope, slope_se, occ_std) -> Column:
    """Error propagation of room / slope; known only for a rising queue with both errors known."""
    room, slope, slope_se, occ_std = map(col, (room, slope, slope_se, occ_std))
    by_slope = F.pow(ratio(room, slope * slope), 2) * slope_se * slope_se
    by_state = F.pow(ratio(F.lit(1.0), slope), 2) * occ_std * occ_std
    return F.when(slope > 0, F.sqrt(by_slope + by_state))


def eta_std_dark(room, slope, slope_se, occ_std, limit_ms: int = 3_600_000) -> Column:
    """Hidden-station form: silent beyond an hour, and either known term is enough."""
    room, slope, slope_se, occ_std = map(col, (room, slope, slope_se, occ_std))
    by_slope = F.pow(ratio(room, slope * slope), 2) * slope_se * slope_se
    by_state = F.pow(ratio(F.lit(1.0), slope), 2) * occ_std * occ_std
    both = F.when(by_slope.isNotNull() | by_state.isNotNull(),
                  F.sqrt(F.coalesce(by_slope, F.lit(0.0)) + F.coalesce(by_state, F.lit(0.0))))
    return F.when((slope > 0) & (room >= 0) & (ratio(room, slope) <= limit_ms), both)


def risk_percent(p) -> Column:
    return 100.0 * col(p)


def zone_of_route(route) -> Column:
    r = F.upper(col(route))
    return (F.when(r.startswith("DARK"), "DARK").when(r == "LIGHT", "LIGHT").otherwise("UNKNOWN"))


def crossed(score, threshold) -> Column:
    return col(score) >= col(threshold)


def early_warning(score, threshold, index, final_index) -> Column:
    """A crossing is actionable only before the final inspection station."""
    return crossed(score, threshold) & (col(index) < col(final_index))


def clip_probability(p, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(col(p), F.lit(eps)), F.lit(1.0 - eps))


def logit(p, eps: float = 1e-6) -> Column:
    q = clip_probability(p, eps)
    return F.ln(q / (1 - q))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-col(x)))


def stage_band(index) -> Column:
    i = col(index)
    return F.when(i <= 17, "early").when(i <= 23, "mid").otherwise("late")


def load_band(load) -> Column:
    n = col(load).cast("int")
    return (F.when(n <= 2, "load_0_2").when(n >= 11, "load_11_plus")
            .otherwise(F.concat(F.lit("load_"), n.cast("string"))))


def scenario_name(run_id) -> Column:
    """Third '_' part of the run id (with everything after it), else the id itself."""
    return F.coalesce(F.get(F.split(col(run_id), "_", 3), F.lit(2)), col(run_id))


def fingerprint(text, length: int = 16) -> Column:
    return F.substring(F.sha2(col(text), 256), 1, length)


def stable_seed(*parts) -> Column:
    """Positive 60-bit seed from text parts; the same text always gives the same seed."""
    joined = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 15), 16, 10).cast("long")


def sim_clock(ms) -> Column:
    """h:mm:ss from one hour on, mm:ss.t below."""
    t = col(ms).cast("long")
    sec = F.floor(t / 1000)
    long_form = F.format_string("%d:%02d:%02d", F.floor(sec / 3600), F.floor(sec / 60) % 60, sec % 60)
    short_form = F.format_string("%02d:%02d.%d", F.floor(sec / 60), sec % 60, F.floor(t / 100) % 10)
    return F.when(t >= 3_600_000, long_form).otherwise(short_form)


def duration_text(ms) -> Column:
    """'0s' for nothing, '12.3s' below a minute, then '4m 5s'."""
    x = col(ms)
    sec = F.floor(x / 1000).cast("long")
    return (F.when(x.isNull() | (x == 0), "0s")
            .when(x < 60000, F.format_string("%.1fs", x / 1000.0))
            .otherwise(F.format_string("%dm %ds", F.floor(sec / 60), sec % 60)))


def humanise(name) -> Column:
    s = F.lower(F.trim(F.replace(col(name), F.lit("_"), F.lit(" "))))
    out = F.concat(F.upper(F.substring(s, 1, 1)), F.substr(s, F.lit(2)))
    return F.when(out == "", col(name)).otherwise(out)


# Features that name the station itself and give no action.
IDENTITY_FEATURES = ["station_id", "station_index", "prediction_station_index"]


def driver_names(drivers, k: int) -> Column:
    """First k readable names of the drivers that do not lower the risk, else of all drivers."""
    usable = F.filter(col(drivers), lambda d: d["feature"].isNotNull()
                      & (d["feature"] != "") & ~d["feature"].isin(IDENTITY_FEATURES))
    raising = F.filter(usable, lambda d: F.coalesce(d["direction"], F.lit("")) != "decreases_risk")
    chosen = F.when(F.size(raising) > 0, raising).otherwise(usable)
    return F.transform(F.slice(chosen, 1, k), lambda d: humanise(d["feature"]))


def defect_driver_names(drivers, k: int) -> Column:
    names = F.transform(col(drivers), lambda d: F.coalesce(F.nullif(d["label"], F.lit("")),
                                                           F.nullif(d["feature"], F.lit(""))))
    return F.slice(F.filter(names, lambda n: n.isNotNull()), 1, k)


def percent_half_even(total, count) -> Column:
    """100 * total / count rounded half to even, 0 for an empty group."""
    return F.coalesce(F.bround(100.0 * ratio(total, count), 0), F.lit(0.0)).cast("long")


def whole_percent(confidence) -> Column:
    return F.coalesce(F.bround(col(confidence) * 100.0, 0), F.lit(0.0)).cast("long")


def dark_route(route) -> Column:
    return F.coalesce(F.upper(col(route)).startswith("DARK"), F.lit(False))


def low_confidence(c, limit: float = 0.75) -> Column:
    return F.coalesce(col(c) < limit, F.lit(False))


def wilson(k, n, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of k/n; NULL at n = 0."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = ratio(k, n)
    den = 1 + z * z * ratio(F.lit(1.0), n)
    mid = (p + ratio(F.lit(z * z / 2), n)) / den
    half = z * F.sqrt(ratio(p * (1 - p), n) + ratio(F.lit(z * z / 4), n * n)) / den
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
