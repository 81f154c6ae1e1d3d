"""Hand-computed fixtures: ties, NULLs, boundaries, pairing, policies, calibration, occupancy."""
import itertools
import json
import math
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from takt.contracts import frozen_projection
from takt.functions import scalar as sc
from takt.functions.gamma import digamma, trigamma
from takt.operators import aggregate as ag
from takt.operators import calibrate as ca
from takt.operators import evaluate as ev
from takt.operators import joins as jn
from takt.operators import occupancy as oc
from takt.operators import rollup as ru
from takt.operators import slices as sl
from takt.operators import validate as va
from takt.operators import windows as wn
from takt.plans import station_flow as sf
from takt.plans import unit_quality as uq
from takt.sources import runs as rs
from takt.sources.bundles import read_run_bundles
from takt.sources import sinks as sk

EV = "run_id string, station_id string, unit_id string, timestamp_ms long, event_sequence long, event_type string, queue_length_after double, cycle_time_ms double"
ST = ("run_id string, station_id string, station_index int, name string, archetype string, base_cycle_time_ms long, cycle_time_std_ms long, "
      "buffer_capacity int, sensor_coverage string, is_dark boolean")


def events(spark, rows):
    """rows: (t, seq, queue) or (t, seq, queue, type) at one station."""
    full = [("r", "S02", "U1", r[0], r[1], r[3] if len(r) > 3 else "STATE_CHANGED", r[2], None) for r in rows]
    return spark.createDataFrame(full, EV)


def stations(spark, n=4, cap=5):
    return spark.createDataFrame([("r", f"S{i + 1:02d}", i, f"n{i}", "INSPECTION" if i == n - 1 else "AUTOMATED", 1000 * (1 + i % 2), 100, cap, "HIGH", False)
                                  for i in range(n)], ST)


def by_seq(df, *cols):
    return {r["seq"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_f1_ties_and_window_edge(spark):
    e = events(spark, [(0, 0, 9.0), (1, 1, 7.0), (600_001, 2, 1.0), (600_001, 3, 3.0), (600_001, 4, 5.0)])
    got = by_seq(sf.window_stats(e), "queue_mean", "queue_max")
    assert got[2] == (4.0, 7.0)          # t=1 is inside (edge inclusive), t=0 is not, later ties are not
    assert got[3] == (pytest.approx(11 / 3), 7.0)
    assert got[4] == (4.0, 7.0)


def test_f2_never_reported(spark):
    f = sf.flow_features(events(spark, [(10, 0, None), (20, 1, None)]), stations(spark)).collect()
    assert {(r.current_occupancy, r.state_confidence, r.progress_std) for r in f} == {(0.0, 0.0, None)}


def test_f3_slope_needs_distinct_times(spark):
    two = by_seq(sf.window_stats(events(spark, [(0, 0, 1.0), (10, 1, 2.0), (10, 2, 2.0)])), "slope", "slope_se")
    assert two[0] == (None, None) and two[2][0] == pytest.approx(0.1) and two[2][1] is None
    three = by_seq(sf.window_stats(events(spark, [(0, 0, 1.0), (10, 1, 2.0), (20, 2, 2.0)])), "slope", "slope_se")
    assert three[2][0] == pytest.approx(0.05) and three[2][1] == pytest.approx(math.sqrt((1 / 6) / 200))
    flat = sf.flow_features(events(spark, [(0, 0, 2.0), (10, 1, 2.0), (20, 2, 2.0)]), stations(spark)).filter("prediction_time = 20").first()
    assert flat.queue_slope_10m == 0.0 and flat.eta_std is None


def test_f4_labels(spark):
    e = events(spark, [(0, 0, 1.0), (0, 1, 5.0), (100, 2, 5.0), (200, 3, 2.0), (1_800_100, 4, 1.0), (3_700_000, 5, 0.0)])
    f = {r.prediction_event_sequence: (r.y_bottleneck, r.target_eligibility_status) for r in sf.flow_features(e, stations(spark)).collect()}
    assert f[0] == (1, "eligible") and f[1] == (None, "already_full") and f[3] == (0, "eligible") and f[5] == (None, "censored")
    same_ts = events(spark, [(0, 0, 1.0), (0, 1, 5.0), (0, 2, 1.0), (2_000_000, 3, 1.0)])
    assert sf.flow_features(same_ts, stations(spark)).filter("prediction_event_sequence = 0").first().y_bottleneck == 0


@pytest.mark.parametrize("width", [60_000, 200_000, 600_000])
def test_windows_do_not_depend_on_slices(spark, width):
    rnd = random.Random(width)
    rows = sorted({(rnd.randrange(0, 3_000) * 1000, i) for i in range(300)})
    e = events(spark, [(t, i, rnd.choice([None, float(rnd.randrange(6))]), rnd.choice(["UNIT_ARRIVED", "PROCESSING_COMPLETED", "STATE_CHANGED"])) for t, i in rows])
    key = lambda r: r.seq
    a = sorted(sf.window_stats(e, slice_ms=width).collect(), key=key)
    hist = [(r.timestamp_ms, r.event_sequence, r.queue_length_after, r.event_type) for r in sorted(e.collect(), key=lambda r: (r.timestamp_ms, r.event_sequence))]
    for got in a:
        i = next(k for k, h in enumerate(hist) if h[1] == got.seq)
        t = hist[i][0]
        win = [h for h in hist[:i + 1] if h[0] >= t - 600_000]
        q = [h[2] for h in win if h[2] is not None]
        prev = [h for h in hist if t - 1_200_000 <= h[0] < t - 600_000]
        fut = [h[2] for h in hist if t < h[0] <= t + 1_800_000 and h[2] is not None]
        assert got.queue_mean == (pytest.approx(sum(q) / len(q)) if q else None)
        assert got.arrivals == sum(h[3] == "UNIT_ARRIVED" for h in win) and got.prev_services == sum(h[3] == "PROCESSING_COMPLETED" for h in prev)
        assert got.future_max == (max(fut) if fut else None)


def fifo(spark, seq):
    rows = [("r", "S01", "U1", t, i, "PROCESSING_STARTED" if k == "S" else "PROCESSING_COMPLETED", None, None) for i, (k, t) in enumerate(seq)]
    iv, diag = jn.pair_fifo(spark.createDataFrame(rows, EV), width=10)
    d = diag.first()
    return sorted((r.processing_start, r.processing_end) for r in iv.collect()), (d.unmatched_starts, d.unmatched_completions, d.invalid_intervals)


def test_f5_fifo(spark):
    assert fifo(spark, [("S", 1), ("S", 2), ("C", 3), ("C", 4)]) == ([(1, 3), (2, 4)], (0, 0, 0))
    assert fifo(spark, [("C", 1), ("S", 2), ("C", 3)]) == ([(2, 3)], (0, 1, 0))
    assert fifo(spark, [("S", 5), ("C", 5), ("S", 6)]) == ([], (1, 0, 1))


def test_fifo_against_queue(spark):
    rnd = random.Random(3)
    for _ in range(3):
        seq = [(rnd.choice("SC"), t) for t in sorted(rnd.randrange(60) for _ in range(30))]
        queue, want = [], []
        for k, t in seq:
            if k == "S":
                queue.append(t)
            elif queue:
                s = queue.pop(0)
                if s < t:
                    want.append((s, t))
        assert fifo(spark, seq)[0] == sorted(want)


def test_f6_as_of_assignment(spark):
    iv = spark.createDataFrame([("r", "S01", "A", 10, 20, 1), ("r", "S01", "B", 15, 30, 2)],
                               "run_id string, station_id string, unit_id string, processing_start long, processing_end long, start_event_sequence long")
    rd = spark.createDataFrame([("r", "S01", t) for t in (9, 10, 14, 15, 20, 30, 31)], "run_id string, station_id string, timestamp_ms long")
    got = {r.timestamp_ms: r.assigned_unit_id for r in jn.assign_by_interval(rd, iv, width=7).collect()}
    assert got == {10: "A", 14: "A", 15: "B", 20: "B", 30: "B"}


def quality_case(spark, fail="PASS"):
    e = spark.createDataFrame([
        ("r", "S01", "U1", 100, 0, "PROCESSING_STARTED", None, None, 0), ("r", "S01", "U1", 500, 1, "PROCESSING_COMPLETED", None, 400.0, 0),
        ("r", "S02", "U1", 500, 2, "UNIT_ARRIVED", 2.0, None, 1), ("r", "S02", "U1", 501, 3, "UNIT_ARRIVED", 3.0, None, 1),
        ("r", "S03", "U1", 700_000, 4, "UNIT_ARRIVED", 1.0, None, 2)], EV + ", station_index int")
    se = spark.createDataFrame([("r", "S01", 0, 100, 10, "TORQUE", 4.0), ("r", "S01", 0, 300, 11, "TORQUE", 8.0), ("r", "S01", 0, 501, 12, "TORQUE", 99.0)],
                               "run_id string, station_id string, station_index int, timestamp_ms long, event_sequence long, sensor_type string, value double")
    ma = spark.createDataFrame([("r", "S01", 0, "U1", 450, 20, "FAIL")], "run_id string, station_id string, station_index int, unit_id string, timestamp_ms long, event_sequence long, result string")
    un = spark.createDataFrame([("r", "U1", "M", "B")], "run_id string, unit_id string, vehicle_model string, supplier_batch string")
    ins = spark.createDataFrame([("r", "S04", 3, "U1", 900_000, 30, fail)], ma.schema)
    return uq.quality_features(e, se, ma, un, stations(spark), ins)


def test_f7_availability_and_recent(spark):
    f = {r.prediction_event_sequence: r for r in quality_case(spark).collect()}
    assert f[2].torque_mean_history is None          # the interval ends at 500, not before
    assert (f[3].torque_mean_history, f[3].torque_max_recent, f[3].torque_std_history) == (6.0, 8.0, pytest.approx(math.sqrt(8)))
    assert f[4].torque_mean_history == 6.0 and f[4].torque_max_recent is None and f[4].current_missing_recent == 1.0
    assert f[3].manual_fail_count_cum == 1.0 and f[3].stations_since_last_manual_fail == 1.0 and f[4].queue_history_mean == 2.5


def test_f16_labels_do_not_leak(spark):
    a, z = ([tuple(r)[:-1] for r in quality_case(spark, res).orderBy("prediction_event_sequence").collect()] for res in ("PASS", "FAIL"))
    assert a == z
    assert {r.y_defect for r in quality_case(spark, "FAIL").collect()} == {1}


def series(spark, flags, p=None):
    return spark.createDataFrame([("r", "S01", 100 * i, i, bool(w), p[i] if p else 0.5) for i, w in enumerate(flags)],
                                 "run_id string, station_id string, timestamp_ms long, emission long, warning boolean, probability double")


def test_f8_islands(spark):
    d = series(spark, [1, 1, 0, 1])
    got = sorted((r.start_ms, r.end_ms, r.point_count, r.open_ended) for r in wn.warning_periods(d, "station_id", width=2).collect())
    assert got == [(0, 100, 2, False), (300, 300, 1, True)]
    t = wn.warning_totals(d, "station_id", width=2).first()
    assert (t.threshold_crossings, t.time_above_ms) == (2, 100)


def test_f9_trend(spark):
    assert wn.trend(series(spark, [0] * 3, [0.1] * 3), "station_id").first().trend == "UNKNOWN"
    assert wn.trend(series(spark, [0] * 4, [0.1, 0.1, 0.4, 0.4]), "station_id").first().trend_delta == pytest.approx(0.3)
    fifty = wn.trend(series(spark, [0] * 50, [0.9] * 10 + [0.5] * 20 + [0.2] * 20), "station_id").first()
    assert fifty.trend == "FALLING" and fifty.trend_delta == pytest.approx(-0.3)


def test_f10_policies(spark):
    s = spark.createDataFrame([("r", "u", i, x) for i, x in enumerate([.1, .9, .2])], "run_id string, unit_id string, seq long, score double")
    rows = sorted(wn.alert_policies(s).collect(), key=lambda r: r.seq)
    assert [r.two_of_three for r in rows] == [None, .1, .2] and [r.two_consecutive for r in rows] == [None, .1, .2]
    assert [r.ema_03 for r in rows] == pytest.approx([.1, .34, .298])


def test_long_series_blocks(spark):
    n = 1000
    s = spark.createDataFrame([("r", "u", i, (i * 37 % 101) / 101) for i in range(n)], "run_id string, unit_id string, seq long, score double")
    e, want = None, []
    for i in range(n):
        x = (i * 37 % 101) / 101
        e = x if e is None else .3 * x + .7 * e
        want.append(e)
    assert [r.ema_03 for r in sorted(wn.alert_policies(s, width=64).collect(), key=lambda r: r.seq)] == pytest.approx(want, abs=1e-12)


def test_f11_threshold(spark):
    rows = [("r", f"p{i}", 1, 0.9, 0, 5, i) for i in range(2)] + [("r", f"n{i}", 0, 0.95 if i == 0 else 0.1, 0, 5, 10 + i) for i in range(40)]
    d = spark.createDataFrame(rows, "run_id string, unit_id string, y int, score double, station_index int, final_index int, seq long")
    t = ev.unit_threshold(d, cap=0.05).first()
    assert (t.threshold, t.unit_recall, t.false_warning_rate) == (0.9, 1.0, 0.025)
    none = ev.unit_threshold(d, cap=0.0).first()
    assert none.threshold > 0.95 and none.unit_recall == 0.0


def test_f12_final_station(spark):
    r = spark.range(1).select(sc.crossed(F.lit(0.9), F.lit(0.5)).alias("c"), sc.early_warning(F.lit(0.9), F.lit(0.5), F.lit(10), F.lit(10)).alias("w")).first()
    assert r.c and not r.w


def test_f13_zone_ranges(spark):
    st = stations(spark, 6)
    z = spark.createDataFrame([("r", "A", "S02", "S03"), ("r", "B", "S05", "S05"), ("r", "C", "S04", "S02"), ("r", "D", "S01", "S99")],
                              "run_id string, dark_zone_id string, start_station_id string, end_station_id string")
    members, bad = jn.expand_ranges(z, st)
    assert sorted((r.dark_zone_id, r.station_id) for r in members.collect()) == [("A", "S02"), ("A", "S03"), ("B", "S05")]
    assert {(r.rule, r.key) for r in bad.collect()} == {("reversed_zone_range", "C"), ("unknown_zone_station", "D")}
    c = ca.detect_corridors(st.withColumn("is_dark", F.col("station_index").isin(0, 1, 5))).collect()
    assert {(r.zone_id, r.kind, r.upstream_station, r.downstream_station) for r in c} == {("DZ_S01_S02", "corridor", None, "S03"), ("DZ_S06", "single", "S05", None)}


def test_f14_boundary_split_adds_up(spark):
    a = spark.createDataFrame([("r", "Z", "U1", 1000, 1), ("r", "Z", "U9", 900, 0)], "run_id string, zone_id string, unit_id string, timestamp_ms long, event_sequence long")
    z = spark.createDataFrame([("r", "Z", "U1", 2001, 2)], a.schema)
    m = spark.createDataFrame([("r", "Z", s, i, w) for i, (s, w) in enumerate([("A", 1000), ("B", 2000), ("C", 1000)])],
                              "run_id string, zone_id string, station_id string, pos int, base_cycle_time_ms long")
    u = spark.createDataFrame([("r", "U1", "M")], "run_id string, unit_id string, vehicle_model string")
    rows = sorted(ca.boundary_allocation(a, z, u, m).collect(), key=lambda r: r.station_id)
    parts = [r.station_exit_ms - r.station_entry_ms for r in rows]
    assert [r.corridor_load for r in rows] == [1, 1, 1]  # U9 never left
    assert sum(parts) == 1001 and parts[1] == pytest.approx(500.5) and rows[-1].station_exit_ms == 2001.0


def test_f15_queue_moments(spark):
    p = [.2, .7, .05, .9]
    q = {}
    for pick in itertools.product([0, 1], repeat=4):
        w = math.prod(x if k else 1 - x for x, k in zip(p, pick))
        n = max(sum(pick) - 1, 0)
        q[n] = q.get(n, 0) + w
    mean = sum(n * w for n, w in q.items())
    std = math.sqrt(sum(w * (n - mean) ** 2 for n, w in q.items()))
    r = ag.poisson_binomial_queue(spark.createDataFrame([(1, x, .8) for x in p], "k int, p double, quality double"), ["k"]).first()
    assert (r.queue_mean, r.queue_std) == (pytest.approx(mean, abs=1e-12), pytest.approx(std, abs=1e-12)) and r.confidence == pytest.approx(math.exp(-std) * .8)


def test_f17_bus_faults(spark):
    bus = spark.createDataFrame([("r", 1, 10), ("r", 2, 20), ("r", 4, 30), ("r", 5, 25)], "run_id string, sequence long, timestamp_ms long")
    assert sorted((r.rule, r.key) for r in va.sequence_gaps(bus, width=2).collect()) == [("sequence_gap", "4"), ("time_backward", "5")]


def test_monotone_skips_do_not_raise_the_mark(spark):
    rows = [("r", "u", i, i, s, c) for i, (s, c) in enumerate([(3, .1), (5, .2), (4, .9), (4, .9), (2, .9), (6, .9)])]
    d = spark.createDataFrame(rows, "run_id string, unit_id string, timestamp_ms long, seq long, station_index int, state_confidence double")
    got = [r.verdict for r in sorted(wn.monotone_filter(d, .6, width=2).collect(), key=lambda r: r.seq)]
    assert got == ["accepted", "low_confidence", "accepted", "refresh", "backward", "accepted"]


def test_exact_quantiles_and_trim(spark):
    rnd = random.Random(1)
    xs = [rnd.gauss(50, 5) for _ in range(99)] + [1e6]
    d = spark.createDataFrame([("k", x) for x in xs], "k string, x double")
    s = sorted(xs)
    q = sl.exact_quantiles(d, ["k"], "x", {"m": .5, "q9": .9}).first()
    assert q.m == pytest.approx((s[49] + s[50]) / 2) and q.q9 == pytest.approx(s[89] + .1 * (s[90] - s[89]))
    assert ag.robust_trim(d, ["k"], "x").filter("x = 1e6").count() == 0


def test_gamma_fit_recovers_parameters(spark):
    r = spark.range(1).select(digamma(F.lit(2.5)).alias("d"), trigamma(F.lit(2.5)).alias("t")).first()
    assert r.d == pytest.approx(0.7031566406452432, abs=1e-9) and r.t == pytest.approx(0.4903577561002348, abs=1e-7)
    rnd = random.Random(5)
    d = spark.createDataFrame([("S01", "M", rnd.gammavariate(4.0, 2.0)) for _ in range(4000)], "station_id string, variant string, dwell_s double")
    f = ca.fit_dwell(d, trim=False).first()
    assert f["shape"] == pytest.approx(4.0, rel=.1) and f["shape"] * f["scale"] == pytest.approx(8.0, rel=.05)
    same = spark.createDataFrame([("S01", "M", 3.0)] * 40, d.schema)
    assert ca.fit_dwell(same).count() == 0           # no spread, no fit


def passages(spark):
    return spark.createDataFrame([("r", "Z", "U1", 0, 100_000, ["A", "B"], [400.0, 400.0], [0.1, 0.1]), ("r", "Z", "U2", 10_000, 110_000, ["A", "B"], [400.0, 400.0], [0.1, 0.1])],
                                 "run_id string, zone_id string, unit_id string, entry_ts long, exit_ts long, stations array<string>, shapes array<double>, scales array<double>")


def test_occupancy_is_seeded_and_places_units(spark):
    h = oc.draw_hypotheses(passages(spark), 100)
    assert sorted(map(str, h.collect())) == sorted(map(str, oc.draw_hypotheses(passages(spark).repartition(3), 100).collect()))
    q = spark.createDataFrame([("q1", "r", "Z", "U1", 0, 20_000), ("q2", "r", "Z", "U1", 0, 60_000)], "query_id string, run_id string, zone_id string, unit_id string, entry_ts long, t_ms long")
    est = {r.query_id: r for r in oc.station_posterior(passages(spark), q, 100)[1].collect()}
    assert est["q1"].most_likely_station == "A" and est["q2"].most_likely_station == "B" and est["q1"].progress_mean == pytest.approx(.5, abs=.03)
    c = oc.expected_crossings(h, spark.createDataFrame([("r", "Z", "B", 1_000_000)], "run_id string, zone_id string, station_id string, t_ms long")).first()
    assert (c.arrivals10, c.arrivals_prev, c.services_prev) == (pytest.approx(0), pytest.approx(2), pytest.approx(2))


def test_evidence_shares(spark):
    e = spark.createDataFrame([("r", "Z", 1, 5_000, "A", None, .12), ("r", "Z", 2, 55_000, "B", None, .12)],
                              "run_id string, zone_id string, evidence_id long, ts_ms long, station_id string, progress double, std double")
    p = passages(spark)
    q = oc.active_queries(p, e.select("run_id", "zone_id", "ts_ms").withColumnRenamed("ts_ms", "t_ms"))
    rows = oc.evidence_association(oc.station_posterior(p, q, 200)[0], e).collect()
    first = [r for r in rows if r.evidence_id == 1]
    assert [(r.unit_id, r.share) for r in first] == [("U1", 1.0)]
    second = {r.unit_id: r.share for r in rows if r.evidence_id == 2}
    assert sum(second.values()) == pytest.approx(1.0) and set(second) == {"U1", "U2"}
    reached = spark.createDataFrame([("r", "U1", 9)], "run_id string, unit_id string, reached_index int")
    a = spark.createDataFrame([("r", 7, "U1", .6, 2), ("r", 7, "U2", .4, 2)], "run_id string, evidence_id long, unit_id string, share double, station_index int")
    assert oc.attribute_readings(a, reached).first().unit_id == "U2"


def test_units_still_inside_count(spark):
    p = spark.createDataFrame([("r", "Z", "U1", 0, None), ("r", "Z", "U2", 100_000, 150_000), ("r", "Z", "U3", 200_000, 300_000)],
                              "run_id string, zone_id string, unit_id string, entry_ts long, exit_ts long")
    assert {r.unit_id: r.load for r in wn.corridor_load(p).collect()} == {"U1": 0, "U2": 1, "U3": 1}
    ticks = {u: [r.tick_ms for r in oc.interval_ticks(p).collect() if r.unit_id == u] for u in ("U1", "U2", "U3")}
    assert ticks == {"U1": [60_000, 120_000, 180_000, 240_000, 300_000], "U2": [], "U3": [260_000]}


def test_policies_keep_rows_without_a_score(spark):
    s = spark.createDataFrame([("r", "u", i, x) for i, x in enumerate([.1, .9, None, .2])], "run_id string, unit_id string, seq long, score double")
    rows = sorted(wn.alert_policies(s).collect(), key=lambda r: r.seq)
    assert [r.two_consecutive for r in rows] == [None, .1, None, None] and [r.two_of_three for r in rows] == [None, .1, .1, .2]
    assert [r.ema_03 for r in rows] == pytest.approx([.1, .34, .34, (.49 * .34 + .3 * .2) / .79])


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_exponential_means_over_blocks(spark, block):
    import random
    draw = random.Random(2)
    scores = [draw.choice([None, draw.random() * 1e6]) if i % 3 else draw.random() for i in range(500)]
    df = spark.createDataFrame([("r", "u", i + 1, x) for i, x in enumerate(scores)], "run_id string, unit_id string, rn long, score double")
    got = [r.ema_05 for r in sorted(wn.exponential_means(df, ["run_id", "unit_id"], "score", block).collect(), key=lambda r: r.rn)]
    mean, old, want = None, 1.0, []
    for x in scores:
        old *= .5
        if x is not None:
            mean, old = (x if mean is None else (old * mean + .5 * x) / (old + .5)), 1.0
        want.append(mean)
    assert got == pytest.approx(want, rel=1e-9)


def test_gates(spark):
    e = spark.createDataFrame([("RFID", .5, .5, .1, 10., 20.), ("RFID", .99, .5, .1, 10., 20.), ("ANDON", 1.0, .5, .1, 1., 100.)],
                              "checkpoint_type string, progress double, progress_mean double, progress_std double, elapsed_s double, mean_duration_s double")
    ok, bad = oc.evidence_gates(e)
    assert ok.count() == 1 and sorted(r.reason for r in bad.collect()) == ["andon_implausible", "rfid_beyond_gate"]


def test_missing_run_parts_and_bundles(spark, tmp_path):
    good, poor = tmp_path / "run_a", tmp_path / "run_b"
    for d in (good, poor):
        d.mkdir()
    for name in rs.REQUIRED_FILES:
        (good / name).write_text(json.dumps({"run_id": "run_a", "schema_version": "1"}) if name.endswith("json") else "unit_id,created_at_ms,vehicle_model,supplier_batch\nU1,5,M,B\n")
    (poor / "units.csv").write_text("unit_id\n")
    got = {r.run_id: (len(r.missing), r.complete) for r in rs.discover_runs(spark, str(tmp_path)).collect()}
    assert got == {"run_a": (0, True), "run_b": (6, False)}
    assert rs.read_run_table(spark, str(tmp_path), "units").filter("run_id = 'run_a'").first().created_at_ms == 5
    with zipfile.ZipFile(tmp_path / "run_z.zip", "w") as z:
        z.writestr("run_z/units.csv", "unit_id,created_at_ms,vehicle_model,supplier_batch\nU9,7,M,\n")
    r = read_run_bundles(spark, str(tmp_path / "*.zip"), "units").first()
    assert (r.run_id, r.unit_id, r.created_at_ms, r.supplier_batch) == ("run_z", "U9", 7, None)
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:  # several runs, a bad number, a missing column, no folder
        z.writestr("run_p/units.csv", "unit_id,created_at_ms,vehicle_model\nU1,x,M\n" + "U2,8,M\n" * 50_000)
        z.writestr("units.csv", "unit_id,created_at_ms,vehicle_model,supplier_batch\n")
        z.writestr("run_q/units.csv", "run_id,unit_id,created_at_ms\nrun_other,U3,9.0\n")
    two = read_run_bundles(spark, str(tmp_path / "two.zip"), "units")
    assert two.rdd.getNumPartitions() == 3 and two.count() == 50_002
    assert sorted(map(tuple, two.filter("unit_id <> 'U2'").collect())) == [("run_other", "U3", 9, None, None), ("run_p", "U1", None, "M", None)]
    with pytest.raises(Exception, match="stations.csv is missing"):
        read_run_bundles(spark, str(tmp_path / "two.zip"), "stations").count()
    assert rs.read_prediction_stream(spark, str(tmp_path / "none"), "defect").count() == 0


def test_feature_sink_refuses_to_overwrite(spark, tmp_path):
    d = spark.createDataFrame([("r", 1)], "run_id string, x int")
    sk.write_features(d, str(tmp_path / "f"))
    with pytest.raises(Exception):
        sk.write_features(d, str(tmp_path / "f"))
    with pytest.raises(ValueError):
        frozen_projection(d, ["run_id", "y"])


def test_scope_falls_back_to_newest(spark):
    r = spark.createDataFrame([("a", 1), ("b", 2)], "run_id string, production_day int")
    pick = lambda c, s=None: sorted(x.run_id for x in ru.scope_filter(r, c, s).collect())
    assert pick("All Runs") == ["a", "b"] and pick("Production Day 1") == ["a"] and pick("Production Day x") == ["b"] and pick("Current Run", "a") == ["a"] and pick("Current Run", "zz") == ["b"]


def test_calibration_quality_takes_the_nearest_own_model_once_per_request(spark):
    models = spark.createDataFrame([
        ("S04", "A", 40, 2.0, 5.0, "local", "3", 0), ("S04", "A", 10, 3.0, 6.0, "local", "7", 2), ("S04", "__ALL__", 80, 9.0, 9.0, "local", "5", 0),
        ("S05", "__ALL__", 200, 4.0, 1.0, "band", None, None), ("S05", "A", 16, 5.0, 2.0, "all", "all", None)],
        "station_id string, variant string, n int, shape double, scale double, level string, load_key string, radius int")
    bands = spark.range(1).select(sc.load_band(F.lit(5)).alias("b")).first()["b"]
    models = models.withColumn("load_key", F.coalesce("load_key", F.lit(bands)))
    requests = spark.createDataFrame([(1, "S04", "A", 5, True), (2, "S04", "B", 9, True), (3, "S05", "A", 5, False), (4, "S06", "A", 5, False), (5, "S06", "B", 5, False), (6, "S07", "A", 1, False)],
                                     "request_id int, station_id string, variant string, load int, is_first boolean")
    fallback = spark.createDataFrame([("S06", "A", 1.0, 1.5), ("S06", "__ALL__", 7.0, 7.5)], "station_id string, variant string, shape double, scale double")
    got = {r.request_id: (r.level, r.load_key, r.shape, r.scale, round(r.quality, 6)) for r in ca.calibration_quality(requests, models, fallback).collect()}
    assert got == {1: ("local", "3", 2.0, 5.0, round(0.97 * 0.55, 6)), 2: ("local", "5", 9.0, 9.0, 0.92), 3: ("band", bands, 4.0, 1.0, 0.88),
                   4: ("processing_dwell", None, 1.0, 1.5, 0.42), 5: ("processing_dwell", None, 7.0, 7.5, 0.42), 6: ("processing_dwell", None, None, None, 0.42)}


def test_observations_change_beliefs_round_by_round(spark):
    """What is seen weighs the draws of the units inside, and the second observation meets the changed weights."""
    p = passages(spark).withColumn("shapes", F.array(F.lit(4.0), F.lit(4.0))).withColumn("scales", F.array(F.lit(10.0), F.lit(10.0)))
    times = spark.createDataFrame([("r", "Z", 45_000), ("r", "Z", 300_000)], "run_id string, zone_id string, t_ms long")
    seen = spark.createDataFrame([("r", "Z", 1, 42_000, "B"), ("r", "Z", 2, 41_000, "A"), ("r", "Z", 3, 39_000, "A")],
                                 "run_id string, zone_id string, evidence_id long, ts_ms long, station_id string")
    k, floor = 60, 0.05
    draws = {}
    for h in oc.draw_hypotheses(p, k).collect():
        draws.setdefault((h.unit_id, h.entry_ts), []).append(list(h.cum_t))

    def station(cum, elapsed):
        return ["A", "B"][min(sum(c <= elapsed for c in cum), 1)]

    def alive(cum, elapsed):
        return 1e-6 if cum[-1] < elapsed else 1.0

    weight = {u: [1.0] * k for u in draws}
    for ts, at in ((41_000, "A"), (42_000, "B")):  # the last two, in order
        fits = {u: [1.0 if station(c, (ts - u[1]) / 1000) == at else floor for c in draws[u]] for u in draws}
        base = {u: [w * alive(c, (ts - u[1]) / 1000) for w, c in zip(weight[u], draws[u])] for u in draws}
        score = {u: sum(w * x for w, x in zip(base[u], fits[u])) / sum(base[u]) for u in draws}
        for u in draws:
            share = score[u] / sum(score.values())
            weight[u] = [w * (1 - share + share * x / score[u]) for w, x in zip(weight[u], fits[u])]
    want = {}
    for u in draws:
        w = [x * alive(c, (45_000 - u[1]) / 1000) for x, c in zip(weight[u], draws[u])]
        for x, c in zip(w, draws[u]):
            key = (u[0], station(c, (45_000 - u[1]) / 1000))
            want[key] = want.get(key, 0) + x / sum(w)
    got = {(r.unit_id, r.station_id): r.p for r in oc.evidence_feedback(p, times, seen, 2, k=k)[0].collect()}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()}
    plain = {(r.unit_id, r.station_id): r.p for r in oc.evidence_feedback(p, times, seen, 0, k=k)[0].collect()}
    assert plain.keys() == got.keys() and plain != got


def test_equal_passages_and_queries_draw_once_and_count_all(spark):
    p = passages(spark)
    q = oc.active_queries(p, spark.createDataFrame([("r", "Z", 45_000)], "run_id string, zone_id string, t_ms long")).drop("quality")
    thrice = lambda df: df.unionByName(df).unionByName(df)
    once, many = oc._asked_particles(p, q, 10, 0), oc._asked_particles(thrice(p), thrice(q), 10, 0)
    assert many.count() == once.count() and {r.copies for r in many.collect()} == {9}
    a = {r.query_id: r for r in oc.station_posterior(p, q, 50)[1].collect()}
    for r in oc.station_posterior(thrice(p), thrice(q), 50)[1].collect():
        assert abs(r.confidence - a[r.query_id].confidence) < 1e-9 and abs(r.effective_samples - 9 * a[r.query_id].effective_samples) < 1e-6


def test_draws_of_few_rows_are_spread_over_tasks(spark):
    p = passages(spark).coalesce(1)
    assert oc.draw_hypotheses(p, 5).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merged_draws_weigh_like_all_of_them(spark):
    p = passages(spark)
    thrice = p.unionByName(p).unionByName(p)
    q = oc.active_queries(thrice, spark.createDataFrame([("r", "Z", 45_000)], "run_id string, zone_id string, t_ms long"))
    for of in (lambda h: oc.single_station_progress(h, q), lambda h: oc.checkpoint_weight(h, p.select(
            *oc.PASSAGE, F.lit(40_000).cast("long").alias("ts_ms"), F.lit("A").alias("station_id"), F.lit(0.5).alias("progress"), F.lit("RFID").alias("checkpoint_type")), q)):
        whole, less = (sorted(of(h).collect(), key=str) for h in (oc.draw_hypotheses(thrice, 20), oc.draw_hypotheses(oc.merged(thrice), 20)))
        assert len(whole) == len(less) > 0
        assert all(abs(x - y) < 1e-9 if isinstance(x, float) else x == y for r, s in zip(whole, less) for x, y in zip(r, s))


def test_local_models_look_at_near_levels_only(spark):
    """A far load makes thousands of targets, each with the smallest ring that holds enough rows."""
    n = {0: 7, 2: 9, 3: 30, 4_000: 5, 9_000: 40}
    counts = spark.createDataFrame([("S04", "A", True, load, 10.0 + i, 1) for load, k in n.items() for i in range(k)],
                                   "station_id string, variant string, is_first boolean, corridor_load int, x double, n long")
    got = {int(r.load_key): (r.radius, r.n) for r in ca.local_load_models(counts).filter("variant = 'A'").collect()}
    assert set(got) == set(range(9_001))
    for t in (0, 1, 2, 3, 500, 2_001, 4_000, 6_501, 9_000):
        radius = min(r for r in {abs(x - t) for x in n} if sum(k for x, k in n.items() if abs(x - t) <= r) >= 20)
        assert got[t] == (radius, sum(k for x, k in n.items() if abs(x - t) <= radius))


def test_corridor_load_of_residence_counts_pairs_without_making_them(spark):
    from itertools import product
    entries = [("r", "U1", 0), ("r", "U1", 5), ("r", "U1", 5), ("r", "U2", 3), ("r", "U2", 20), ("r", "U3", 9), ("s", "U1", 1)]
    exits = [("r", "U1", 7), ("r", "U1", 12), ("r", "U2", 4), ("r", "U2", 15), ("r", "U3", 9), ("s", "U1", 6), ("s", "U1", 6)]
    got = {(r.run_id, r.unit_id): r.corridor_load for r in ca._last_load(spark.createDataFrame(entries, "run_id string, unit_id string, entry_ts long"),
                                                                          spark.createDataFrame(exits, "run_id string, unit_id string, exit_ts long"), 4).collect()}
    pairs = [(a[0], a[1], a[2], z[2]) for a, z in product(entries, exits) if a[:2] == z[:2] and z[2] > a[2]]
    want = {}
    for run, unit, t0, t1 in sorted(pairs, key=lambda p: p[2:]):
        want[run, unit] = sum(p[0] == run and p[2] < t0 for p in pairs) - sum(p[0] == run and p[3] < t0 for p in pairs)
    assert got == want


@pytest.mark.parametrize("name", ["causal_replay", "causal_replay_quality"])
def test_replay_folds_pairs_without_sorting_or_collecting_them(spark, name):
    from takt.catalog import collect
    plan = collect()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan =="):]
    pairs = [line for line in plan.splitlines() if "stddev_samp" in line]
    assert pairs and all("SortAggregate" not in line and "collect_set" not in line and "max_by" not in line for line in pairs)


def explained(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def dealt_to(plan: str) -> list[int]:
    """The numbers of tasks that a plan's repartitions name, largest first."""
    return sorted((int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)), reverse=True)


def test_r3_f15_f16_slices_are_dealt_to_tasks_that_grow_with_the_rows(spark, monkeypatch, capsys):
    want = sorted(map(tuple, quality_case(spark).collect()), key=str)
    assert set(dealt_to(explained(quality_case(spark), capsys))) == {4}  # few rows: as many tasks as the session has
    monkeypatch.setattr(sl, "ROWS_A_TASK", 2)
    got = quality_case(spark)
    # 5 events, 4 questions (two upstream stations of one arrival, one of two), 3 steps of 3 readings, 1 check
    assert set(dealt_to(explained(got, capsys))) == {10}
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_r3_f15_line_scope_is_dealt_too(spark, monkeypatch, capsys):
    e = spark.createDataFrame([("r", "S02", f"U{i % 3}", 1000 * i, i, "UNIT_ARRIVED", float(i % 5), None, 1) for i in range(30)], EV + ", station_index int")
    se = spark.createDataFrame([("r", "S01", 0, 1000 * i + 7, 100 + i, ("TORQUE", "CURRENT")[i % 2], float(i * i % 11)) for i in range(30)],
                               "run_id string, station_id string, station_index int, timestamp_ms long, event_sequence long, sensor_type string, value double")
    ma = spark.createDataFrame([("r", "S01", 0, "U1", 450, 200, "FAIL")], "run_id string, station_id string, station_index int, unit_id string, timestamp_ms long, event_sequence long, result string")
    un = spark.createDataFrame([("r", f"U{i}", "M", "B") for i in range(3)], "run_id string, unit_id string, vehicle_model string, supplier_batch string")
    made = lambda: uq.quality_features_line(e, se, ma, un, stations(spark), ma, recent_ms=5000)
    plain = {r.prediction_event_sequence: r for r in made().collect()}
    monkeypatch.setattr(sl, "ROWS_A_TASK", 10)
    assert set(dealt_to(explained(made(), capsys))) == {16}
    assert {r.prediction_event_sequence: r for r in made().collect()} == plain
    for i, r in plain.items():
        recent = [k * k % 11 for k in range(0, 30, 2) if 1000 * k + 7 < 1000 * i <= 1000 * k + 7 + 5000]
        assert r.torque_max_recent == (max(recent) if recent else None)


def test_r3_f21_flow_windows_are_dealt_to_tasks_that_grow_with_the_rows(spark, monkeypatch, capsys):
    e = spark.createDataFrame([("r", f"S0{1 + i % 3}", f"U{i % 4}", 20_000 * i, i, ("UNIT_ARRIVED", "PROCESSING_COMPLETED")[i % 2], float(i % 5), 10.0 * i) for i in range(60)], EV)
    want = sorted(map(tuple, sf.window_stats(e).collect()), key=str)
    monkeypatch.setattr(sl, "ROWS_A_TASK", 10)
    assert set(dealt_to(explained(sf.window_stats(e), capsys))) == {6, 24}  # events, and four copies of them
    assert sorted(map(tuple, sf.window_stats(e).collect()), key=str) == want


def near(a, b) -> bool:
    return a == b if a is None or b is None or isinstance(a, str) else abs(a - b) <= 1e-9 * max(1, abs(b))


def test_r4_f5_replay_reads_windows_at_their_edges(spark):
    """Every row against all rows of its station; clocks tie, rows come twice, nothing is paired in the plan."""
    from random import Random
    from statistics import mean, stdev
    from takt.operators import replay
    r = Random(4)
    kinds = ["UNIT_ARRIVED", "PROCESSING_STARTED", "PROCESSING_COMPLETED"]
    rows = [("r", r.choice(["S01", "S02"]), "U1", 100 * r.randrange(400), i, r.choice(kinds), r.choice([None, 0.0, 3.0, 7.5]), r.choice([None, 10.25, 400.0])) for i in range(150)]
    rows += rows[::7]
    events = spark.createDataFrame(rows, EV)
    e = events.select("run_id", "station_id", F.col("timestamp_ms").alias("ts"), F.col("event_sequence").alias("seq"), F.col("queue_length_after").alias("q"),
                      F.col("cycle_time_ms").alias("c"), "event_type", F.lit(True).alias("leads"))
    plan = replay.flow_again(events, stations(spark))._jdf.queryExecution().toString()
    assert "bucket" not in plan and "Generate explode(sequence" not in plan
    got = {(x.station_id, x.t, x.s): x for x in replay._windows(e, 5000, 15_000, 3).collect()}
    assert set(got) == {(x[1], x[3], x[4]) for x in rows}
    for (station, t, s), x in got.items():
        twice = sum(y[4] == s for y in rows)
        near_by = [y for y in rows if y[1] == station for _ in range(twice)]
        now = [y for y in near_by if t - 5000 <= y[3] and (y[3], y[4]) <= (t, s)]
        before = [y for y in near_by if t - 10_000 <= y[3] < t - 5000]
        ahead = [y[6] for y in near_by if t < y[3] <= t + 15_000 and y[6] is not None]
        q, c = [[y[k] for y in now if y[k] is not None] for k in (6, 7)]
        seen = [(y[3] - t, y[6]) for y in now if y[6] is not None]
        want = {"q_mean": mean(q) if q else None, "q_std": stdev(q) if len(q) > 1 else None, "q_max": max(q, default=None), "c_mean": mean(c) if c else None,
                "c_std": stdev(c) if len(c) > 1 else None, "n": len(q), "ahead": max(ahead, default=None), "arrived": sum(y[5] == kinds[0] for y in now), "times": len(now),
                "served_before": sum(y[5] == kinds[2] for y in before), "q_before": mean(b) if (b := [y[6] for y in before if y[6] is not None]) else None}
        if seen:
            want |= {"x": sum(a for a, _ in seen), "xx": sum(a * a for a, _ in seen), "xy": sum(a * b for a, b in seen), "yy": sum(b * b for _, b in seen)}
        assert all(near(x[k], v) for k, v in want.items()), (x, want)


def test_r4_f3_replay_asks_the_stations_upstream(spark):
    """Every arrival against all rows of its unit: readings known late, some after they are no longer recent, arrivals that come twice."""
    from random import Random
    from statistics import mean, stdev
    from takt.operators import replay
    r = Random(3)
    signals = ["TORQUE", "VIBRATION", "TEMPERATURE", "CURRENT"]
    readings = []
    for i in range(200):
        ts = r.randrange(1_500_000)
        readings.append(("r", r.choice(["U1", "U2"]), r.randrange(4), r.choice(signals), float(r.randrange(50)), ts, ts + r.choice([0, 5, 40_000, 590_000, 700_000]), i))
    arrivals = [("r", r.choice(["U1", "U2", "U3"]), r.randrange(2_300_000), 1000 + i, r.randrange(5)) for i in range(60)] + [("r", "U1", readings[0][6] + k, 2000 + k, 4) for k in range(2)]
    arrivals += arrivals[::9]
    checks = [("r", u, st, 1_000 * i, 500 + i, res) for i, (u, st, res) in enumerate([("U1", 1, "PASS"), ("U1", 2, "fail "), ("U1", 0, "PASS"), ("U2", 3, "FAIL"), ("U2", 0, None)])]
    assigned = spark.createDataFrame(readings, "run_id string, unit_id string, station_index int, sensor_type string, value double, timestamp_ms long, processing_end long, event_sequence long")
    asked = spark.createDataFrame(arrivals, "run_id string, unit_id string, t long, s long, at int")
    manual = spark.createDataFrame(checks, "run_id string, unit_id string, station_index int, timestamp_ms long, event_sequence long, result string")
    none = spark.createDataFrame([], EV + ", station_index int")
    units = spark.createDataFrame([("r", u, "M", "B") for u in ("U1", "U2", "U3")], "run_id string, unit_id string, vehicle_model string, supplier_batch string")
    again = replay.quality_again(asked, assigned, none, manual, units, stations(spark))
    got = {x.prediction_event_sequence: x for x in again.collect()}
    assert len(got) == len(set(arrivals))
    assert "stddev_samp(CASE WHEN" not in again._jdf.queryExecution().toString()  # what pairs of an arrival and a row were chosen by
    for run, unit, t, s, at in set(arrivals):
        twice, x = arrivals.count((run, unit, t, s, at)), got[s]
        past = [y for y in readings if y[1] == unit and y[2] < at and max(y[5], y[6]) < t]
        of = lambda name, rows: [y[4] for y in rows if y[3] == name] * twice
        fresh = [y for y in past if y[5] >= t - 600_000]
        done = [y for y in checks if y[1] == unit and y[2] < at and y[3] < t and y[5] is not None]
        torque = of("TORQUE", past)
        want = {"torque_std_history": stdev(torque) if len(torque) > 1 else None, "manual_check_count_cum": twice * len(done),
                "manual_fail_count_cum": twice * sum(y[5].strip().upper() == "FAIL" for y in done), "last_manual_fail": float(done[-1][5].strip().upper() == "FAIL") if done else None,
                "current_missing_recent": float(not of("CURRENT", fresh))}
        failed = [at - y[2] for y in done if y[5].strip().upper() == "FAIL"]
        want["stations_since_last_manual_fail"] = failed[-1] if failed else None
        for name in signals:
            p, h, f = name.lower(), of(name, past), of(name, fresh)
            want |= {f"{p}_mean_history": mean(h) if h else None, f"{p}_max_history": max(h, default=None), f"{p}_mean_recent": mean(f) if f else None, f"{p}_max_recent": max(f, default=None)}
        assert all(near(x[f"again_{k}"], v) for k, v in want.items() if f"again_{k}" in x.asDict()), (unit, t, at, x, want)


def test_r4_f2_f4_chances_are_looked_up_in_sorted_draws(spark):
    """Queries of one passage and time each have the same chances without meeting a draw; passages and queries that come twice give one row."""
    p = passages(spark)
    twice = p.unionByName(p)
    times = spark.createDataFrame([("r", "Z", t) for t in range(0, 400_000, 7_000)], "run_id string, zone_id string, t_ms long")
    q = oc.active_queries(twice, times)
    got = oc.station_posterior(twice, q, 37, apart=True)[0]
    plan = got._jdf.queryExecution().toString()
    assert "particle" not in plan[plan.index("== Physical Plan =="):]
    rows = lambda df: {(r.query_id, r.station_id): r.p for r in df.collect()}
    found, want = rows(got), rows(oc.station_posterior(twice, q, 37)[0])
    assert got.count() == len(found) and set(found) == set(want) and len({s for _, s in found}) > 1
    assert all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_r4_f6_f7_residence_pairs_are_counted_and_not_listed(spark, monkeypatch):
    """Blocks of clocks that meet give the counts of all pairs, and so the same models, however small blocks and hands are."""
    monkeypatch.setattr(ca, "BLOCK_MS", 700)
    monkeypatch.setattr(ca, "AT_ONCE", 50)
    r = random.Random(6)
    rows = []
    for i in range(900):
        station, kind = r.choice([("S03", "PROCESSING_COMPLETED"), *[(s, k) for s in ("S04", "S05", "S06") for k in ("UNIT_ARRIVED", "PROCESSING_COMPLETED")]])
        rows.append(("r", station, f"U{r.randrange(4)}", r.randrange(9_000) - 2_000, i, kind, None, None))
    e = spark.createDataFrame(rows + rows[::11], EV)
    units = spark.createDataFrame([("r", f"U{i}", "MODEL_A" if i else None, "B") for i in range(4)], "run_id string, unit_id string, vehicle_model string, supplier_batch string")
    corridor = spark.createDataFrame([("r", s, s == "S04", s == "S06", "S03") for s in ("S04", "S05", "S06")],
                                     "run_id string, station_id string, is_first boolean, is_last boolean, upstream_station string")
    listed, counted = (ca.corridor_residence(e, units, corridor, c) for c in (False, True))
    assert "exit_ts > entry_ts" not in counted._jdf.queryExecution().toString() and "dwell_s" not in counted.columns
    want = {tuple(x) for x in listed.groupBy("station_id", "variant", "is_first", sc.load_band("corridor_load"), "dwell_s").count().collect()}
    got = counted.filter("x IS NOT NULL").groupBy("station_id", "variant", "is_first", "band", "x").agg(F.sum("n")).collect()
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 100
    models = [sorted(map(str, ca.fit_residence_by_load(x).select("station_id", "variant", "n", F.round("mean", 6), F.round("shape", 6), "level", "load_key", "radius").collect())) for x in (listed, counted)]
    assert models[0] == models[1] and any("local" in m for m in models[0])


def test_r4_f6_only_slices_of_asked_ranks_are_sorted(spark):
    r = random.Random(7)
    rows = [(k, r.choice([-1, 1]) * r.expovariate(0.01)) for k in ("a", "b", "c") for _ in range({"a": 1, "b": 2, "c": 501}[k])]
    df = spark.createDataFrame([*rows, (None, 1.0), ("c", None)], "k string, x double")
    got = {x.k: x for x in sl.exact_quantiles(df, ["k"], "x", {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, x in got.items():
        v = sorted(y for n, y in rows if n == k)
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p100", 1.0)):
            at = q * (len(v) - 1)
            assert abs(x[name] - (v[int(at)] + (at - int(at)) * (v[math.ceil(at)] - v[int(at)]))) < 1e-9
