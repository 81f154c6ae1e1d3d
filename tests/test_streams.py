"""Streaming operators against their batch twins, with stop and resume between chunks."""
import math
import pickle
import random

import pytest
from pyspark.sql import functions as F

from takt.catalog.streams import Replay, heartbeat
from takt.contracts import FLOW_FEATURES, QUALITY_FEATURES
from takt.plans import station_flow as sf
from takt.plans import unit_quality as uq
from takt.streaming import operators as so
from takt.streaming import timed

BUS = ("run_id string, station_id string, station_index int, unit_id string, timestamp_ms long, event_sequence long, record_type string, event_type string, "
       "queue_length_after double, cycle_time_ms double, sensor_type string, value double, result string")


def line(spark, units=5, n=4):
    """A well-formed line: one unit at a time per station, readings inside the processing interval."""
    rnd, free, rows = random.Random(11), [0] * n, []
    for u in range(units):
        t = u * 40_000
        for s in range(n):
            t = max(t + 1000, free[s])
            base = ("r", f"S{s + 1:02d}", s, f"U{u}")
            rows.append((*base, t, "STATION", "UNIT_ARRIVED", float(rnd.randrange(5)), None, None, None, None))
            start, end = t + 100, t + 100 + rnd.randrange(20_000, 200_000)
            rows.append((*base, start, "STATION", "PROCESSING_STARTED", None, None, None, None, None))
            for k in range(3):
                rows.append(("r", f"S{s + 1:02d}", s, None, start + (k + 1) * 5000, "SENSOR", None, None, None, rnd.choice(["TORQUE", "CURRENT"]), float(rnd.randrange(100)), None))
            rows.append((*base, end, "MANUAL", None, None, None, None, None, rnd.choice(["PASS", "FAIL"])))
            rows.append((*base, end + 1, "STATION", "PROCESSING_COMPLETED", None, float(end + 1 - start), None, None, None))
            free[s] = t = end + 2
    rows.sort(key=lambda r: r[4])
    return spark.createDataFrame([(*r[:5], i, *r[5:]) for i, r in enumerate(rows)], BUS)


def test_unit_features_stream_equals_batch(spark):
    bus = line(spark)
    e, m = bus.filter("record_type = 'STATION'"), bus.filter("record_type = 'MANUAL'")
    st = spark.createDataFrame([("r", f"S{i + 1:02d}", i, "INSPECTION" if i == 3 else "AUTOMATED") for i in range(4)], "run_id string, station_id string, station_index int, archetype string")
    un = bus.filter("unit_id IS NOT NULL").select("run_id", "unit_id").distinct().withColumn("vehicle_model", F.lit("M")).withColumn("supplier_batch", F.lit("B"))
    batch = {r.prediction_event_sequence: r for r in uq.quality_features(e, bus.filter("record_type = 'SENSOR'"), m, un, st, m).collect()}
    fed = late(bus)
    first = Replay(spark, fed, "arrival", then=heartbeat(fed, 2 * timed.DAY_MS))
    elements = first.files(timed.station_readings_stream(first.stream))
    elements = elements.withColumn("position", F.unix_millis("event_time"))
    second = Replay(spark, elements, "position", 2, then=heartbeat(elements, 2 * timed.DAY_MS))
    rows = second.files(so.defect_features_stream(second.stream, un, st)).collect()
    assert len(rows) == len(batch) > 0
    assert any(r.torque_mean_history is not None for r in rows)
    for r in rows:
        b = batch[r.prediction_event_sequence]
        for c in QUALITY_FEATURES:
            assert r[c] == (pytest.approx(b[c], abs=1e-9) if isinstance(b[c], float) else b[c]), (c, r)
    assert first.state("numRowsTotal")[-1] == second.state("numRowsTotal")[-1] == 0


def late(df, ms=200_000):
    """On the common clock; every fifth row arrives late, but within the watermark's delay."""
    timed_rows = df.withColumn("event_time", F.timestamp_millis(F.col("timestamp_ms") + timed.DAY_MS))
    return timed_rows.withColumn("arrival", F.unix_millis("event_time") + F.when(F.col("event_sequence") % 5 == 0, ms).otherwise(0))


def test_flow_features_and_labels_stream_equal_batch_and_leave_no_state(spark):
    bus = line(spark, units=60)
    e = bus.filter("record_type = 'STATION'").select("run_id", "station_id", "timestamp_ms", "event_sequence", "event_type", "queue_length_after", "cycle_time_ms")
    st = spark.createDataFrame([("r", f"S{i + 1:02d}", "AUTOMATED", 30_000, 3_000, 4) for i in range(4)],
                               "run_id string, station_id string, archetype string, base_cycle_time_ms long, cycle_time_std_ms long, buffer_capacity int")
    fed = late(e)
    r = Replay(spark, fed, "arrival", then=heartbeat(fed, 2 * timed.DAY_MS))
    rows = r.files(so.bottleneck_features_stream(r.stream, st, slack_ms=0))
    got = {x.prediction_event_sequence: x for x in so.labelled_flow_features(rows).collect()}
    want = {x.prediction_event_sequence: x for x in sf.flow_features(e, st).collect()}
    assert got.keys() == want.keys() and {x.target_eligibility_status for x in want.values()} == {"eligible", "already_full", "censored"}
    assert {x.y_bottleneck for x in want.values()} == {0, 1, None}
    for k, w in want.items():
        for c in [*FLOW_FEATURES, "target_eligibility_status", "y_bottleneck", "currently_at_capacity"]:
            assert got[k][c] == (pytest.approx(w[c], rel=1e-6, abs=1e-6) if isinstance(w[c], float) else w[c]), (c, k)
    assert rows.filter("kind = 'label'").count() == len(want)  # what has no label by the end is censored by a row of its own
    assert max(r.state("numRowsTotal")) > 0 and r.state("numRowsTotal")[-1] == 0


def test_silent_unit_ticks_until_it_leaves_or_is_given_up(spark):
    rows = [("r", "a", 0, "ENTER", 1), ("r", "b", 30_000, "ENTER", 2), ("r", "b", 400_000, "EXIT", 3), ("r", "c", 900_000, "ENTER", 4), ("r", "d", 950_000, "EXIT", 6)]
    early = [("r", "c", 850_000, "ENTER", 5)]  # comes after its later twin, within the delay
    df = late(spark.createDataFrame(rows + early, "run_id string, unit_id string, timestamp_ms long, kind string, event_sequence long"), 0)
    df = df.withColumn("arrival", F.when(F.col("event_sequence") == 5, F.lit(2)).otherwise(F.lit(1)))
    r = Replay(spark, df, "arrival", cuts=[1], then=heartbeat(df, 3_000_000))
    got = {}
    for x in r.files(timed.interval_ticks_stream(r.stream, idle_ms=600_000, delay="5 minutes")).collect():
        got.setdefault((x.unit_id, x.entry_ts), []).append(x.tick_ms)
    assert {k: sorted(v) for k, v in got.items()} == {
        ("a", 0): list(range(60_000, 600_001, 60_000)), ("b", 30_000): list(range(90_000, 400_001, 60_000)), ("c", 850_000): list(range(910_000, 1_500_001, 60_000))}
    assert r.state("numRowsTotal")[-1] == 0
    ticks_by_silence = [p for p in r.progress if p["stateOperators"] and p["numInputRows"] == 0]
    assert ticks_by_silence  # timers fired in batches without a row


def test_ticks_come_as_the_watermark_moves(spark):
    """One unit inside; rows of another one move the time, and each batch brings the ticks that are due by then."""
    rows = [("r", "in", 0, "ENTER", 1)] + [("r", f"x{i}", i * 200_000, "EXIT", 10 + i) for i in range(1, 5)]
    df = late(spark.createDataFrame(rows, "run_id string, unit_id string, timestamp_ms long, kind string, event_sequence long"), 0)
    r = Replay(spark, df, "event_sequence", cuts=[11, 12, 13])
    out, seen = timed.interval_ticks_stream(r.stream, delay="0 seconds"), []
    r.drain(lambda: (so.run_to_end(out, f"{r.root}/out", f"{r.root}/checkpoint"), seen.append(spark.read.schema(out.schema).parquet(f"{r.root}/out").count())))
    assert seen == [3, 6, 9, 13]  # times 200, 400, 600 and 800 s


def test_state_of_finished_runs_is_removed(spark):
    preds = spark.createDataFrame([(run, f"U{u}", 1000 * s, s, 10 * s + u, 0.9) for run in ("run_1", "run_2") for u in range(3) for s in range(4)],
                                  "run_id string, unit_id string, timestamp_ms long, station_index int, seq long, state_confidence double")
    r = Replay(spark, preds, "seq", 2)
    marks = f"{r.root}/marks"
    known = preds.select("run_id", "unit_id")

    def finish(run):
        return lambda: spark.createDataFrame([(f'{{"run_id": "{run}", "schema_version": "1"}}',)], "value string").coalesce(1).write.text(f"{marks}/{run}")

    r.chunks += [finish("run_1"), finish("run_2")]
    out = r.files(so.dark_transitions_stream(r.stream, so.end_rows(so.finished_runs(spark, f"{marks}/*/*"), known)))
    assert out.count() == preds.count()
    left = r.state("numRowsTotal")
    assert max(left) == 6 and 3 in left and left[-1] == 0


def test_streams_ask_for_the_state_store_they_need(spark):
    set_to = spark.conf.get(timed.PROVIDER, None)
    try:
        spark.conf.set(timed.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        with pytest.raises(ValueError, match="RocksDB"):
            timed.check_provider(spark)
    finally:
        spark.conf.set(timed.PROVIDER, set_to or timed.ROCKSDB)


def test_replayed_batch_is_written_once(spark, tmp_path):
    d = spark.createDataFrame([(1, 5, "a"), (1, 7, "c"), (1, 6, "b"), (2, 1, None)], "k int, seq int, v string")
    write = so.idempotent_sink(str(tmp_path), ["k"], "seq")
    write(d, 0)
    write(d, 0)
    write(d.filter("seq = 6"), 1)
    assert sorted(map(tuple, so.read_idempotent(spark, str(tmp_path), ["k"], "seq").collect())) == [(1, 7, "c"), (2, 1, None)]


class Held:
    """A state variable in memory, of any of the three kinds."""

    def __init__(self):
        self.map, self.list = {}, []

    def exists(self):
        return bool(self.list)

    def get(self):
        return self.list if self.many else self.list[0]

    def update(self, v):
        self.list = [v]

    def appendValue(self, v):
        self.list.append(v)

    def iterator(self):
        return iter(list(self.map.items()))

    def updateValue(self, k, v):
        self.map[k] = v

    def removeKey(self, k):
        del self.map[k]


class Handle:
    def __init__(self):
        self.timers = []

    def _of(self, many):
        held = Held()
        held.many = many
        return held

    def getListState(self, *_):
        return self._of(True)

    def getValueState(self, *_):
        return self._of(False)

    def getMapState(self, *_):
        return self._of(False)

    def registerTimer(self, at):
        self.timers.append(at)


def made(processor):
    processor.init(Handle())
    return processor, lambda **c: processor.row([c.get(n) for n in processor.names])


def test_r3_f18_open_starts_are_not_searched_for_every_completion():
    looks = [0]

    class Unit(str):
        __hash__ = str.__hash__

        def __eq__(self, other):
            looks[0] += 1
            return str.__eq__(self, other)

    n = 600
    station, row = made(timed.StationReadings())
    rows = [row(timestamp_ms=i, event_sequence=i, station_index=0, unit_id=Unit("U%d" % (i % 3)), event_type="PROCESSING_STARTED", record_type="STATION") for i in range(n)]
    rows += [row(timestamp_ms=n + i // 2, event_sequence=n + i, station_index=0, unit_id=None, record_type="SENSOR", sensor_type="TORQUE", value=float(i)) for i in range(4)]
    rows += [row(timestamp_ms=2 * n + i, event_sequence=2 * n + i, station_index=0, unit_id=Unit("U%d" % (i % 3)), event_type="PROCESSING_COMPLETED", record_type="STATION") for i in range(n)]
    half = n + 4 + n // 2
    out = [*station.step(("r", "S01"), rows[:half])]
    assert len(station.groups.map) == n // 2  # each open start is kept for the next batch
    out += station.step(("r", "S01"), rows[half:])
    assert not station.groups.map and station.closed.get() == (n - 1, 3 * n - 1, "U2")
    # the readings belong to the start before them and come when it has ended
    assert [(o[1], o[4], o[6], o[8]) for o in out] == [("U2", "sensor", float(i), 3 * n - 1) for i in range(4)]
    assert looks[0] < 40 * n  # about n * n / 2 when every completion looks through the open ones


def test_r3_f18_starts_of_one_instant_and_unit_end_first_in_first_out():
    station, row = made(timed.StationReadings())
    at = lambda t, seq, **c: row(event_ms=t, timestamp_ms=t, event_sequence=seq, station_index=0, record_type="STATION", **c)
    rows = [at(0, 0, unit_id="a", event_type="PROCESSING_STARTED"), at(0, 0, unit_id="a", event_type="PROCESSING_STARTED"), at(0, 1, unit_id="b", event_type="PROCESSING_STARTED"),
            row(event_ms=5, timestamp_ms=5, event_sequence=2, station_index=0, record_type="SENSOR", sensor_type="CURRENT", value=1.0)]
    assert [*station.step(("r", "S01"), rows)] == []
    assert sorted(station.groups.map[0,][0]) == [("a", 0), ("a", 0), ("b", 1)]
    assert [*station.step(("r", "S01"), [at(10, 3, unit_id="a", event_type="PROCESSING_COMPLETED"), at(11, 4, unit_id="b", event_type="PROCESSING_COMPLETED")])] == []
    out = [*station.step(("r", "S01"), [at(12, 5, unit_id="a", event_type="PROCESSING_COMPLETED")])]
    assert [(o[1], o[5], o[6], o[7], o[8]) for o in out] == [("a", "CURRENT", 1.0, 5, 12)] and not station.groups.map


def test_r3_f18_arrivals_do_not_go_through_the_readings_of_ten_minutes():
    looks = [0]

    class Value(float):
        pass

    for name in ("__add__", "__radd__", "__mul__", "__neg__", "__abs__", "__lt__", "__gt__", "__sub__", "__rsub__"):
        def counted(self, *other, of=getattr(float, name)):
            looks[0] += 1
            return of(self, *other)
        setattr(Value, name, counted)

    n = 500
    unit, row = made(timed.UnitHistory())
    rows, rnd = [], random.Random(3)
    for i in range(n):
        rows.append(row(event_ms=i, what="sensor", src=i % 3, signal="TORQUE", value=Value(rnd.randrange(1000) / 7), ts=i - rnd.randrange(300), avail=i, seq=i, rank=1))
        rows.append(row(event_ms=i, what="arrival", src=2, ts=i, avail=i, seq=n + i, station_id="S03", rank=0))
    out = [*unit.step(("r", "u"), sorted(rows, key=unit.place))]
    assert len(out) == n and looks[0] < 60 * n  # about n * n / 3 additions and as many comparisons when each arrival goes through them


def test_r3_f18_recent_figures_equal_brute_force_over_batches_and_odd_values():
    rnd, t = random.Random(5), 0
    unit, row = made(timed.UnitHistory(recent_ms=400_000))
    at = {c: i for i, c in enumerate(["run", "unit", "station", "t", "seq", "index", *unit.state_columns])}
    seen, count = [], 0
    for _ in range(6):
        batch = []
        for _ in range(80):
            t += rnd.randrange(30_000)
            if rnd.random() < 0.5:
                value = rnd.choice([0.1, 1e16, -3.7, float(rnd.randrange(50)), *([math.inf] if rnd.random() < 0.1 else [])])
                batch.append(row(event_ms=t, what="sensor", src=rnd.randrange(4), signal=rnd.choice(["TORQUE", "CURRENT"]), value=value, ts=t - rnd.randrange(900_000), avail=t, seq=t, rank=1))
            else:
                batch.append(row(event_ms=t, what="arrival", src=rnd.randrange(5), ts=t, avail=t, seq=t, station_id="S", rank=0))
        got = {o[4]: o for o in unit.step(("r", "u"), batch)}
        for r in batch:
            if r.what == "sensor":
                seen.append(r)
                continue
            for p, signal in (("torque", "TORQUE"), ("current", "CURRENT")):
                mine = [x.value for x in seen if x.signal == signal and x.src < r.src and x.ts >= r.ts - 400_000]
                o = got[r.seq]
                assert o[at[f"{p}_rn"]] == len(mine) and o[at[f"{p}_rmx"]] == max(mine, default=None)
                assert o[at[f"{p}_rs"]] == pytest.approx(math.fsum(mine), rel=1e-12)
                count += bool(mine)
    assert count > 50 and len(unit.recent.map) < 20  # minutes that no arrival reaches are gone


def test_r3_f18_a_frame_waits_as_one_entry_and_keeps_null_apart_from_nan():
    import pandas as pd
    station, _ = made(timed.StationReadings())
    n = 1000
    big = 2**53 + 1
    pdf = pd.DataFrame({"event_ms": range(n), "timestamp_ms": range(n), "event_sequence": [big + i for i in range(n)], "station_index": 0, "unit_id": None, "record_type": "SENSOR",
                        "event_type": None, "queue_length_after": 0.0, "cycle_time_ms": math.nan, "sensor_type": "TORQUE", "value": 1.5, "result": None, "blank": 1 << 7})
    pdf.loc[0, "blank"] = 1 << 7 | 1 << 2
    assert [*station.handleInputRows(("r", "S01"), iter([pdf]), None)] == []
    assert len(station.waiting.list) == 1 and station.handle.timers == [0]
    waiting = [station.row(r) for r in pickle.loads(station.waiting.list[0][0])]
    assert len(waiting) == n and waiting[0].event_sequence is None and waiting[1].event_sequence == big + 1
    assert waiting[5].queue_length_after is None and math.isnan(waiting[5].cycle_time_ms) and waiting[5].unit_id is None
    assert [*station.handleInputRows((None, None), iter([pdf]), None)] == [] and len(station.waiting.list) == 1
    out = [("r", "u", i, 0, "queue", None, v, big + i, i, None, None) for i, v in enumerate([1.0, None, math.nan])]
    frame, = station._frames(out)
    assert frame["odd"].tolist() == [0, 0, 1 << 6] and frame["ts"].tolist() == [big, big + 1, big + 2] and frame["seq"].tolist() == [None] * 3


def test_r3_f18_frames_of_a_stream_keep_null_nan_and_long_numbers(spark):
    big = 2**53 + 1
    rows = [("r", "S01", 0, "U", 1000, big, "STATION", "UNIT_ARRIVED", math.nan, None, None, None, None), ("r", "S01", 0, "U", 2000, big + 1, "STATION", "UNIT_ARRIVED", None, None, None, None, None),
            ("r", "S01", 0, "U", 3000, None, "MANUAL", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, BUS).withColumn("event_time", F.timestamp_millis(F.col("timestamp_ms") + timed.DAY_MS)).withColumn("arrival", F.col("timestamp_ms"))
    r = Replay(spark, df, "arrival", 1, then=heartbeat(df, 2 * timed.DAY_MS))
    got = {(x.what, x.ts): x for x in r.files(timed.station_readings_stream(r.stream)).collect()}
    assert got.keys() == {("queue", 1000), ("arrival", 1000), ("arrival", 2000), ("manual", 3000)}
    assert math.isnan(got["queue", 1000].value) and got["arrival", 1000].value is None
    assert got["arrival", 2000].seq == big + 1 and got["manual", 3000].seq is None and got["manual", 3000].value == 0.0
    assert got["arrival", 2000].event_time.timestamp() * 1000 == timed.DAY_MS + 2000
