"""Contract rules. Each returns violation rows (rule, run_id, key, detail); empty means pass."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takt.contracts import QUALITY_FEATURES
from takt.functions import scalar as sc
from takt.operators import replay
from takt.operators.slices import previous

RULE_COLUMNS = ["rule", "run_id", "key", "detail"]


def _rows(df: DataFrame, rule: str | Column, key: str | Column, detail: Column) -> DataFrame:
    return df.select((F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), F.col("run_id").cast("string").alias("run_id"),
                     sc.col(key).cast("string").alias("key"), detail.cast("string").alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _checks(df: DataFrame, key: str | Column, rules: dict[str, Column], detail: Column) -> DataFrame:
    """One pass over the rows: every broken rule of a row becomes one violation row."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return _rows(df.withColumn("__rule", F.explode(broken)), F.col("__rule"), key, detail)


def sequence_gaps(bus: DataFrame, width: int = 1 << 16) -> DataFrame:
    """Sequence must run 1..n without holes and the clock never steps back along it."""
    p = previous(bus.select("run_id", "sequence", "timestamp_ms"), ["run_id"], ["sequence", "timestamp_ms"],
                 {"prev_seq": "sequence", "prev_ts": "timestamp_ms"}, width)
    return _checks(p, "sequence", {
        "sequence_gap": F.col("sequence") != F.coalesce(F.col("prev_seq"), F.lit(0)) + 1,
        "time_backward": F.col("timestamp_ms") < F.col("prev_ts")},
        F.concat_ws("|", F.coalesce(F.col("prev_seq"), F.lit(0)), F.col("sequence")))


def unknown_keys(facts: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Keys of facts without a dimension row, one row per key with its count."""
    bad = facts.filter(F.col(key).isNotNull()).groupBy("run_id", key).agg(F.count(F.lit(1)).alias("n")).join(
        dim.select("run_id", key).distinct(), ["run_id", key], "left_anti")
    return _rows(bad, f"unknown_{key}", key, F.col("n"))


def duplicate_keys(dim: DataFrame, key: str) -> DataFrame:
    bad = dim.groupBy("run_id", key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _rows(bad, f"duplicate_{key}", key, F.col("n"))


def prediction_contract(preds: DataFrame, stations: DataFrame, units: DataFrame, bus: DataFrame, kind: str) -> DataFrame:
    """Output contract of one stream: keys known, time inside the bus window, probability and flags consistent."""
    win = bus.groupBy("run_id").agg(F.min("timestamp_ms").alias("w0"), F.max("timestamp_ms").alias("w1"))
    j = (preds.join(win, "run_id", "left")
         .join(stations.select("run_id", "station_id", F.lit(True).alias("st_ok")), ["run_id", "station_id"], "left")
         .join(units.select("run_id", "unit_id", F.lit(True).alias("un_ok")), ["run_id", "unit_id"], "left"))
    p, ts = F.col("probability"), F.col("timestamp_ms")
    rules = {
        "unknown_run": F.col("w0").isNull(), "unknown_station": F.col("st_ok").isNull(),
        "unknown_unit": F.col("unit_id").isNotNull() & F.col("un_ok").isNull(),
        "time_outside_run": (ts < F.col("w0")) | (ts > F.col("w1")),
        "bad_probability": p.isNull() | F.isnan(p) | (p < 0) | (p > 1),
        "risk_mismatch": F.abs(F.col("risk_percent") - 100.0 * p) > 1e-8,
    }
    hit = p >= F.col("threshold")
    if kind == "bottleneck":
        err = F.col("additivity_error")
        rules["warning_mismatch"] = F.col("warning") != hit
        rules["missing_explanation"] = F.coalesce(F.size("drivers") <= 0, F.lit(True)) | err.isNull()
        rules["bad_additivity"] = F.isnan(err) | (err > 1e-5)
    else:
        rules["crossed_mismatch"] = F.col("threshold_crossed") != hit
        rules["warning_mismatch"] = F.col("warning") != (F.col("threshold_crossed") & (F.col("station_id") != F.col("final_station")))
    return _checks(j, "emission", rules, F.concat_ws("|", "station_id", "unit_id"))


def label_rules(features: DataFrame, horizon_ms: int = 1_800_000) -> DataFrame:
    """Labelled rows are eligible, not full and have their whole horizon; labels are 0 or 1."""
    last = features.groupBy("run_id", "station_id").agg(F.max("prediction_time").alias("last_ts"))
    j = features.join(last, ["run_id", "station_id"])
    y = F.col("y_bottleneck")
    return _checks(j, "prediction_event_sequence", {
        "label_not_eligible": y.isNotNull() & (F.col("target_eligibility_status") != "eligible"),
        "label_already_full": y.isNotNull() & F.col("currently_at_capacity"),
        "label_incomplete_horizon": y.isNotNull() & (F.col("last_ts") < F.col("prediction_time") + horizon_ms),
        "missing_label": y.isNull() & (F.col("target_eligibility_status") == "eligible"),
        "bad_label": y.isNotNull() & ~y.isin(0, 1)}, F.col("station_id"))


def unit_label_rules(features: DataFrame) -> DataFrame:
    """One label per unit."""
    bad = features.filter("y_defect IS NOT NULL").groupBy("run_id", "unit_id").agg(
        F.min("y_defect").alias("lo"), F.max("y_defect").alias("hi")).filter("lo <> hi")
    return _rows(bad, "inconsistent_unit_label", "unit_id", F.concat_ws("|", "lo", "hi"))


def hidden_event_leak(bus: DataFrame, flags: DataFrame) -> DataFrame:
    """Public rows a hidden zone must not emit."""
    j = bus.join(flags, ["run_id", "station_id"], "left")
    dark, kind = F.coalesce("is_dark", F.lit(False)), F.upper("record_type")
    boundary = F.coalesce(F.col("event_type").isin("DARK_ZONE_ENTERED", "DARK_ZONE_EXITED"), F.lit(False))
    return _checks(j, "sequence", {
        "hidden_station_event": dark & (kind == "STATION") & ~boundary,
        "hidden_sensor": dark & (kind == "SENSOR") & ~F.col("sensor_visible"),
        "hidden_manual": dark & (kind == "MANUAL") & ~F.col("manual_visible"),
        "hidden_checkpoint": dark & (kind == "EVIDENCE") & ~F.col("checkpoint_visible"),
        "inspection_on_bus": kind == "INSPECTION"}, F.col("station_id"))


def topology_match(expected: DataFrame, stations: DataFrame) -> DataFrame:
    """Station order, static columns and hidden set equal the expected line, position by position."""
    numeric, text = ["base_cycle_time_ms", "cycle_time_std_ms", "buffer_capacity"], ["archetype", "sensor_coverage"]
    cols = ["station_id", *numeric, *text, "is_dark"]
    a = expected.select("run_id", F.col("station_index").alias("pos"), *[F.col(c).alias(f"e_{c}") for c in cols], F.lit(1).alias("in_e"))
    z = stations.select("run_id", F.col("station_index").alias("pos"), *[F.col(c).alias(f"s_{c}") for c in cols], F.lit(1).alias("in_s"))
    j = a.join(z, ["run_id", "pos"], "full_outer")
    rules = {"station_order": F.col("in_e").isNull() | F.col("in_s").isNull() | ~F.col("e_station_id").eqNullSafe(F.col("s_station_id")),
             "dark_set": ~F.col("e_is_dark").eqNullSafe(F.col("s_is_dark"))}
    same = F.col("e_station_id").eqNullSafe(F.col("s_station_id"))
    for c in numeric:
        rules[f"differs_{c}"] = same & ~F.col(f"e_{c}").cast("double").eqNullSafe(F.col(f"s_{c}").cast("double"))
    for c in text:
        rules[f"differs_{c}"] = same & ~sc.clean_text(f"e_{c}").eqNullSafe(sc.clean_text(f"s_{c}"))
    return _checks(j, "pos", rules, F.coalesce("s_station_id", "e_station_id"))


def append_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Attributes of known units never change; known units never vanish."""
    cols = [c for c in ("vehicle_model", "supplier_batch") if c in old.columns]
    n = new.select("run_id", "unit_id", *[F.col(c).alias(f"n_{c}") for c in cols], F.lit(1).alias("in_new"))
    j = old.join(n, ["run_id", "unit_id"], "left")
    rules = {"unit_vanished": F.col("in_new").isNull()}
    for c in cols:
        rules[f"changed_{c}"] = F.col("in_new").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"n_{c}"))
    return _checks(j, "unit_id", rules, F.concat_ws("|", *cols))


def assignment_floor(readings: DataFrame, assigned: DataFrame, floor: float = 0.05, warn: float = 0.5) -> DataFrame:
    """Share of readings that found their unit: an error below the floor, a warning below half."""
    a = readings.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).join(
        assigned.groupBy("run_id").agg(F.count(F.lit(1)).alias("m")), "run_id", "left")
    rate = F.coalesce("m", F.lit(0)) / F.col("n")
    level = F.when(rate < floor, "assignment_broken").when(rate < warn, "assignment_low")
    return _rows(a.withColumn("__l", level).filter("__l IS NOT NULL"), F.col("__l"), F.lit("sensor"),
                 F.concat_ws("/", F.coalesce("m", F.lit(0)), "n"))


def unit_order(features: DataFrame, width: int = 600_000) -> DataFrame:
    """Along time a unit's station index never falls."""
    f = features.select("run_id", "unit_id", "prediction_time", "prediction_event_sequence", "prediction_station_index")
    p = previous(f, ["run_id", "unit_id"], ["prediction_time", "prediction_event_sequence"],
                 {"prev_index": "prediction_station_index"}, width)
    bad = p.filter(F.col("prediction_station_index") < F.col("prev_index"))
    return _rows(bad, "unit_moved_upstream", "unit_id", F.concat_ws("|", "prediction_event_sequence", "prev_index", "prediction_station_index"))


# Enumerations of the line contract.
ARCHETYPES = ["AUTOMATED", "MANUAL", "INSPECTION"]
COVERAGES = ["HIGH", "PARTIAL", "NONE"]
CHECKPOINT_TYPES = ["RFID", "POWER_DRAW"]


def factory_rules(stations: DataFrame, zones: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Line, zone and checkpoint definitions."""
    line = stations.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.min("station_index").alias("lo"),
                                          F.max("station_index").alias("hi"), F.count_distinct("station_index").alias("d"))
    whole = _checks(line, F.lit("line"), {
        "too_few_stations": F.col("n") < 3, "ids_not_contiguous": (F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1),
        "duplicate_station": F.col("d") < F.col("n")}, F.col("n"))
    j = stations.join(line.select("run_id", "hi"), "run_id")
    rules = {
        "empty_name": F.coalesce(F.trim("name"), F.lit("")) == "",
        "bad_archetype": ~F.coalesce(F.col("archetype"), F.lit("")).isin(ARCHETYPES),
        "bad_cycle_time": F.coalesce("base_cycle_time_ms", F.lit(0)) <= 0,
        "bad_cycle_std": F.coalesce("cycle_time_std_ms", F.lit(-1)) < 0,
        "bad_capacity": F.coalesce("buffer_capacity", F.lit(-1)) < 0,
        "bad_coverage": ~F.coalesce(F.col("sensor_coverage"), F.lit("")).isin(COVERAGES)}
    if {"source", "sink"} <= set(stations.columns):
        first, last = F.col("station_index") == 0, F.col("station_index") == F.col("hi")
        rules["source_flag"] = F.coalesce("source", F.lit(False)) != first
        rules["sink_flag"] = F.coalesce("sink", F.lit(False)) != last
    each = _checks(j, "station_id", rules, F.col("station_index"))
    cp = checkpoints.join(stations.select("run_id", "station_id", F.lit(1).alias("known")), ["run_id", "station_id"], "left")
    dup = checkpoints.groupBy("run_id", "checkpoint_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    points = _checks(cp, "checkpoint_id", {
        "checkpoint_station": F.col("known").isNull(),
        "checkpoint_type": ~F.coalesce(F.col("checkpoint_type"), F.lit("")).isin(CHECKPOINT_TYPES),
        "checkpoint_progress": ~F.coalesce((F.col("nominal_progress_fraction") > 0) & (F.col("nominal_progress_fraction") < 1), F.lit(False)),
        "checkpoint_reliability": ~F.coalesce(F.col("read_reliability").between(0, 1), F.lit(False)),
        "checkpoint_false_positive": ~F.coalesce(F.col("false_positive_rate").between(0, 1), F.lit(True))}, F.col("station_id"))
    pos = stations.select("run_id", "station_id", F.col("station_index").alias("p"), "archetype")
    z = (zones.join(pos.select("run_id", F.col("station_id").alias("start_station_id"), F.col("p").alias("s0")), ["run_id", "start_station_id"], "left")
         .join(pos.select("run_id", F.col("station_id").alias("end_station_id"), F.col("p").alias("s1")), ["run_id", "end_station_id"], "left")
         .join(line.select("run_id", "n"), "run_id", "left"))
    prev = previous(z.filter("s0 IS NOT NULL AND s1 IS NOT NULL"), ["run_id"], ["s0", "dark_zone_id"], {"prev_end": "s1"}, 1 << 16)
    ranges = _checks(prev, "dark_zone_id", {
        "zone_too_short": F.col("s0") >= F.col("s1"), "zone_at_source": F.col("s0") == 0,
        "zone_at_line_end": F.col("s1") + 1 >= F.col("n"), "zone_adjacent": F.col("s0") <= F.col("prev_end") + 1},
        F.concat_ws("..", "start_station_id", "end_station_id"))
    lost = _rows(z.filter("s0 IS NULL OR s1 IS NULL"), "zone_station_unknown", "dark_zone_id", F.concat_ws("..", "start_station_id", "end_station_id"))
    inside = (z.filter("s0 <= s1").select("run_id", "dark_zone_id", F.explode(F.sequence("s0", "s1")).alias("p"))
              .join(pos.filter("archetype = 'INSPECTION'"), ["run_id", "p"]))
    return _union([whole, each, points, _rows(dup, "duplicate_checkpoint", "checkpoint_id", F.col("n")), ranges, lost,
                   _rows(inside, "inspection_in_zone", "dark_zone_id", F.col("station_id"))])


def causal_replay(features: DataFrame, events: DataFrame, stations: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Flow features, capacity state and label against a replay from raw rows; rows that only one side has are ``replay_missing``."""
    again = replay.flow_again(events, stations)
    return _replayed(features, again, replay.FLOW_COLUMNS, F.coalesce("station_id", "again_station_id"), tol)


def causal_replay_quality(features: DataFrame, arrivals: DataFrame, assigned: DataFrame, events: DataFrame, manual: DataFrame, units: DataFrame, stations: DataFrame,
                          tol: float = 1e-9) -> DataFrame:
    """Unit features against a replay from the raw rows of the unit."""
    again = replay.quality_again(arrivals, assigned, events, manual, units, stations)
    return _replayed(features, again, QUALITY_FEATURES, F.col("unit_id"), tol)


def _replayed(features: DataFrame, again: DataFrame, columns: list[str], detail: Column, tol: float) -> DataFrame:
    keys = ["run_id", "prediction_event_sequence"]
    built = features.withColumn("__built", F.lit(True))
    j = built.join(again.withColumn("__again", F.lit(True)), keys, "full_outer")
    both = F.col("__built").isNotNull() & F.col("__again").isNotNull()
    rules = {name: both & rule for name, rule in replay.differing(columns, dict(features.dtypes), tol).items()}
    return _checks(j, "prediction_event_sequence", {"replay_missing": ~both, **rules}, detail)
