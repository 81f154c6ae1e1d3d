"""Stateful operators on event time.

Rows of a key wait in a list until the watermark has passed them; a timer then hands them on in event order, so
what came late within the watermark's delay changes nothing. Timers also do what no row starts: ticks of a silent unit, and
the end of a key that has been silent for ``idle_ms``, whose state is cleared.

The clock is ``event_time``, common to all runs; ``timestamp_ms`` counts inside a run. A row without a run is a
heartbeat: it moves the watermark and nothing else.
"""
from __future__ import annotations

import math
import pickle
from collections import Counter, namedtuple
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce
from heapq import heapify, heappop, heappush
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from takt.contracts import BOUNDARY_EVENTS, HORIZON_MS, RECENT_MS, SIGNALS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DAY_MS = 86_400_000
MINUTE_MS = 60_000
FRAME_ROWS = 10_000


def check_provider(spark) -> None:
    """These operators need the RocksDB state store; the session is the caller's, so it is not changed here."""
    if "RocksDB" not in (spark.conf.get(PROVIDER, "") or ""):
        raise ValueError(f"set {PROVIDER} to {ROCKSDB} before starting a stateful stream")


def _columns(fields: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ", 1)) for f in fields.split(", ")]


class Timed(StatefulProcessor):
    """Buffers rows (``fields``, the first is event_ms) and calls, in event time:

    ``step(key, rows)`` with rows in ``order`` that the watermark has passed, ``passed(key, limit)`` when time has come up to
    limit without further rows, ``next_time()`` for the time it wants to be woken at, and ``close_key(key)`` when the key
    has been silent for ``idle_ms``.

    Rows cross to Python and back as frames, and those of one frame wait as one entry of the list. A frame can't tell
    NULL from NaN, so NULLs come, and NaN goes, as bits of a column beside the values (see ``timed``).
    """

    fields: str
    order: Sequence[str]
    output: str

    def __init__(self, idle_ms: int = DAY_MS):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [c for c, _ in _columns(self.fields)]
        self.row = namedtuple("Waiting", self.names)._make
        self.place = itemgetter(*[self.names.index(c) for c in self.order])
        self.waiting = handle.getListState("waiting", "rows binary")
        self.clock = handle.getValueState("clock", "timer long, last long")
        self.states = [self.waiting, self.clock, *self.prepare(handle)]

    def prepare(self, handle: StatefulProcessorHandle) -> list:
        """Make the operator's own state; return it, to be cleared at the end of the key."""
        return []

    def step(self, key: tuple, rows: list[tuple]) -> Iterable[tuple]:
        raise TypeError("an operator defines its step")

    def passed(self, key: tuple, limit: int) -> Iterable[tuple]:
        return ()

    def next_time(self) -> int | None:
        return None

    def close_key(self, key: tuple) -> Iterable[tuple]:
        return ()

    def _wake(self, at: int, last: int | None, timer: int | None) -> None:
        if timer is not None and timer != at:
            self.handle.deleteTimer(timer)
        if timer != at:
            self.handle.registerTimer(at)
        self.clock.update((at, last))

    def _tuples(self, pdf) -> list[tuple]:
        blank, columns = pdf["blank"].tolist(), []
        for i, (c, kind) in enumerate(_columns(self.fields)):
            values = pdf[c].tolist()
            if kind == "string":
                values = [v if isinstance(v, str) else None for v in values]
            elif any(m >> i & 1 for m in blank):
                values = [None if m >> i & 1 else v for v, m in zip(values, blank)]
            columns.append(values)
        return list(zip(*columns))

    def _frames(self, out: list[tuple]) -> Iterator:
        import pandas as pd
        kinds = _columns(self.output)
        for at in range(0, len(out), FRAME_ROWS):
            columns = list(zip(*out[at:at + FRAME_ROWS]))
            odd = [0] * len(columns[0])
            for i, (_, kind) in enumerate(kinds):
                if kind == "double" and any(v != v for v in columns[i]):
                    odd = [m | 1 << i if v != v else m for m, v in zip(odd, columns[i])]
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for (c, _), v in zip([*kinds, ("odd", "long")], [*columns, odd])})

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        if key[0] is not None:
            firsts = []
            for pdf in rows:
                new = self._tuples(pdf)
                self.waiting.appendValue((pickle.dumps(new),))
                firsts.append(min(r[0] for r in new))
            timer, last = self.clock.get() if self.clock.exists() else (None, None)
            if timer is None or min(firsts) < timer:
                self._wake(min(firsts), last, timer)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        now = timerValues.getCurrentWatermarkInMs()
        timer, last = self.clock.get() if self.clock.exists() else (None, None)
        held = [self.row(r) for part in (self.waiting.get() if self.waiting.exists() else ()) for r in pickle.loads(bytes(part[0]))]
        held.sort(key=self.place)
        ready, later = [r for r in held if r[0] < now], [r for r in held if r[0] >= now]
        out: list[tuple] = []
        start = 0
        for i, r in enumerate(ready):  # a silence of idle_ms ends a key even if rows before and after it came at once
            before = ready[i - 1][0] if i else last
            if before is not None and r[0] - before > self.idle_ms:
                out += self._run(key, ready[start:i], before)
                out += self._end(key, before)
                start = i
        if ready:
            last = ready[-1][0]
            out += self._run(key, ready[start:], last)
            if later:
                self.waiting.put([(pickle.dumps([tuple(r) for r in later]),)])
            else:
                self.waiting.clear()
        if last is not None and last + self.idle_ms < now:
            out += self._end(key, last)
            last = None
        elif last is not None:
            out += self.passed(key, now - 1)
        wanted = [t for t in (later[0][0] if later else None, self.next_time() if last is not None else None, None if last is None else last + self.idle_ms) if t is not None]
        if wanted:
            self._wake(max(min(wanted), now + 1), last, None)  # the one that fired is removed after this; a timer of this instant would be too
        else:
            for s in self.states:
                s.clear()
        return self._frames(out)

    def _run(self, key: tuple, rows: list[tuple], last: int) -> list[tuple]:
        return list(self.step(key, rows)) if rows else []

    def _end(self, key: tuple, last: int) -> list[tuple]:
        out = [*self.passed(key, last + self.idle_ms), *self.close_key(key)]
        for s in self.states[2:]:
            s.clear()
        return out

    def close(self) -> None:
        pass


def timed(stream: DataFrame, keys: Sequence[str], processor: Timed, delay: str) -> DataFrame:
    """Run a timed operator: ``stream`` has ``event_time`` and the operator's fields."""
    check_provider(stream.sparkSession)
    fields, made = _columns(processor.fields), _columns(processor.output)
    rows = stream.withWatermark("event_time", delay).withColumn("event_ms", F.unix_millis("event_time"))
    plain = [(i, c, kind) for i, (c, kind) in enumerate(fields) if kind != "string"]
    blank = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c, _ in plain])
    whole = [F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c) for _, c, kind in plain]
    out = rows.select("event_time", *keys, *[c for c, kind in fields if kind == "string" and c not in keys], *whole, blank.alias("blank")).groupBy(*keys).transformWithStateInPandas(
        processor, outputStructType=processor.output + ", odd long", outputMode="Append", timeMode="EventTime")
    nan = F.lit(float("nan"))
    return out.select(*[F.when(F.col("odd").bitwiseAND(F.lit(1 << i).cast("long")) != 0, nan).otherwise(F.col(c)).alias(c) if kind == "double" else F.col(c) for i, (c, kind) in enumerate(made)])


class IntervalTicks(Timed):
    """A tick every ``step_ms`` while a unit is inside, also when no row of it comes; exits and silence end them."""

    fields = "event_ms long, timestamp_ms long, kind string"
    order = ["event_ms", "kind"]  # at one instant the entry counts before the exit
    output = "run_id string, unit_id string, entry_ts long, tick_ms long"

    def __init__(self, step_ms: int = MINUTE_MS, idle_ms: int = HORIZON_MS):
        super().__init__(idle_ms)
        self.step_ms = step_ms

    def prepare(self, handle):
        self.stay = handle.getValueState("stay", "entry long, next long, offset long")
        return [self.stay]

    def _ticks(self, key, limit: int) -> Iterator[tuple]:
        """Ticks up to a time of the run's clock."""
        if self.stay.exists():
            entry, due, offset = self.stay.get()
            if due <= limit:
                yield from ((key[0], key[1], entry, t) for t in range(due, limit + 1, self.step_ms))
                self.stay.update((entry, due + ((limit - due) // self.step_ms + 1) * self.step_ms, offset))

    def step(self, key, rows):
        for r in rows:
            yield from self._ticks(key, r.timestamp_ms)
            if r.kind == "ENTER" and not self.stay.exists():
                self.stay.update((r.timestamp_ms, r.timestamp_ms + self.step_ms, r.event_ms - r.timestamp_ms))
            elif r.kind == "EXIT":
                self.stay.clear()

    def passed(self, key, limit):
        return self._ticks(key, limit - self.stay.get()[2]) if self.stay.exists() else ()

    def next_time(self):
        if self.stay.exists():
            _, due, offset = self.stay.get()
            return due + offset
        return None


def interval_ticks_stream(edges: DataFrame, step_ms: int = MINUTE_MS, idle_ms: int = HORIZON_MS, delay: str = "10 minutes") -> DataFrame:
    """``edges``: run_id, unit_id, event_time, timestamp_ms, kind (ENTER or EXIT). A unit that is silent for idle_ms ticks no more."""
    return timed(edges, ["run_id", "unit_id"], IntervalTicks(step_ms, idle_ms), delay)


def _three(v: np.ndarray) -> tuple:
    v = v[~np.isnan(v)]
    n = len(v)
    return (float(v.mean()) if n else None, float(v.std(ddof=1)) if n > 1 else None, float(v.max()) if n else None)


def _slope(t: np.ndarray, q: np.ndarray) -> tuple:
    ok = ~np.isnan(q)
    t, q = t[ok].astype(float), q[ok]
    n, times = len(t), len(np.unique(t))
    if n < 2 or times < 2:
        return None, None
    x = t - t.mean()
    sxx, sxy = (x * x).sum(), (x * (q - q.mean())).sum()
    if times < 3 or n < 3:
        return float(sxy / sxx), None
    rest = max(0.0, ((q - q.mean()) ** 2).sum() - sxy * sxy / sxx)
    return float(sxy / sxx), float(np.sqrt(rest / (n - 2) / sxx))


class FlowRows(Timed):
    """Window statistics of every station event as it comes, and its label once the horizon has passed.

    The list of a station's last events is appended to; it is rewritten without its old part only once that is
    ``slack_ms`` long.
    """

    fields = "event_ms long, timestamp_ms long, event_sequence long, queue_length_after double, cycle_time_ms double, event_type string"
    order = ["timestamp_ms", "event_sequence"]
    output = ("kind string, run_id string, station_id string, ts long, seq long, q double, occupancy double, carry_ts long, carry_steps long, "
              "queue_mean double, queue_std double, queue_max double, cycle_mean double, cycle_std double, cycle_max double, arrivals double, services double, "
              "prev_queue_mean double, prev_arrivals double, prev_services double, slope double, slope_se double, seen boolean, future_max double")

    def __init__(self, recent_ms: int = RECENT_MS, horizon_ms: int = HORIZON_MS, slack_ms: int = RECENT_MS, idle_ms: int = DAY_MS):
        super().__init__(idle_ms)
        self.recent_ms, self.horizon_ms, self.slack_ms = recent_ms, horizon_ms, slack_ms
        self.blank = (None,) * (len(self.output.split(", ")) - 7)

    def prepare(self, handle):
        self.window = handle.getListState("window", "ts long, seq long, q double, c double, event_type string")
        self.carry = handle.getValueState("carry", "q double, ts long, steps long, labelled long, oldest long")
        return [self.window, self.carry]

    def _label(self, key, row: tuple, seen: bool, top: float | None) -> tuple:
        return ("label", *key, row[0], row[1], *self.blank, seen, top)

    def step(self, key, rows):
        old = [tuple(r) for r in self.window.get()] if self.window.exists() else []
        new = [tuple(r[1:]) for r in rows]
        kept = old + new
        t = np.array([r[0] for r in kept], np.int64)
        q, c = (np.array([np.nan if r[i] is None else r[i] for r in kept]) for i in (2, 3))
        arrivals, services = (np.cumsum([0] + [r[4] == kind for r in kept]) for kind in ("UNIT_ARRIVED", "PROCESSING_COMPLETED"))
        carry_q, carry_ts, steps, labelled, oldest = self.carry.get() if self.carry.exists() else (None, None, 0, None, t[0])
        for i in range(len(old), len(kept)):
            lo, lo2, hi = np.searchsorted(t, t[i] - self.recent_ms), np.searchsorted(t, t[i] - 2 * self.recent_ms), i + 1
            if np.isnan(q[i]):
                steps += 1
            else:
                carry_q, carry_ts, steps = float(q[i]), int(t[i]), 0
            yield ("features", *key, int(t[i]), int(kept[i][1]), kept[i][2], 0.0 if carry_q is None else carry_q, carry_ts, None if carry_ts is None else steps,
                   *_three(q[lo:hi]), *_three(c[lo:hi]), float(arrivals[hi] - arrivals[lo]), float(services[hi] - services[lo]), _three(q[lo2:lo])[0],
                   float(arrivals[lo] - arrivals[lo2]), float(services[lo] - services[lo2]), *_slope(t[lo:hi], q[lo:hi]), None, None)
        due = int(t[-1]) - self.horizon_ms
        for i in range(0 if labelled is None else int(np.searchsorted(t, labelled, "right")), int(np.searchsorted(t, due, "right"))):
            ahead = q[np.searchsorted(t, t[i], "right"):np.searchsorted(t, t[i] + self.horizon_ms, "right")]
            yield self._label(key, kept[i], True, _three(ahead)[2])
        labelled = due if labelled is None else max(due, labelled)
        keep = int(t[-1]) - max(self.horizon_ms, 2 * self.recent_ms)
        if t[0] < keep - self.slack_ms:
            self.window.put([r for r in kept if r[0] >= keep])
        else:
            self.window.appendList(new)
        self.carry.update((carry_q, carry_ts, steps, labelled, int(t[0])))

    def close_key(self, key):
        """What the horizon hasn't passed when the station ends is censored."""
        if self.window.exists():
            labelled = self.carry.get()[3]
            for r in self.window.get():
                if r[0] > labelled:
                    yield self._label(key, r, False, None)


def flow_rows_stream(events: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """(kind, window statistics): 'features' rows as events come, 'label' rows with what followed, later."""
    rows = events.filter(F.col("run_id").isNull() | ~F.col("event_type").isin(BOUNDARY_EVENTS) | F.col("event_time").isNull())
    return timed(rows, ["run_id", "station_id"], FlowRows(**settings), delay)


class StationReadings(Timed):
    """Station side of the unit features: what units leave behind there, as observations that become available at ``avail``.

    A reading belongs to the interval that started last before it and is available when that ends. Starts of one instant are a
    group: its readings go to the interval that ends last. State holds open groups and the last one that closed. A completion takes
    its unit's first open start from a heap, a reading the last open group from another, however many are open.
    """

    fields = ("event_ms long, timestamp_ms long, event_sequence long, station_index int, unit_id string, record_type string, event_type string, "
              "queue_length_after double, cycle_time_ms double, sensor_type string, value double, result string")
    order = ["timestamp_ms", "event_sequence"]
    output = ("run_id string, unit_id string, event_ms long, src int, what string, signal string, value double, ts long, avail long, seq long, station_id string")

    def prepare(self, handle):
        self.groups = handle.getMapState("groups", "start long", (
            "members array<struct<unit:string,seq:bigint>>, best_end long, best_seq long, best_unit string, readings array<struct<ts:bigint,seq:bigint,signal:string,value:double>>"))
        self.closed = handle.getValueState("closed", "start long, end long, unit string")
        return [self.groups, self.closed]

    def step(self, key, rows):
        groups = {k[0]: [Counter(tuple(m) for m in v[0]), v[1], v[2], v[3], [tuple(r) for r in v[4]]] for k, v in self.groups.iterator()}
        started: dict[str | None, list] = {}
        for start, g in groups.items():
            for unit, seq in g[0].elements():
                started.setdefault(unit, []).append((start, seq))
        newest = [-start for start in groups]
        for heap in (*started.values(), newest):
            heapify(heap)
        closed = tuple(self.closed.get()) if self.closed.exists() else (None, None, None)
        before, closed_before, changed = set(groups), closed, set()

        def out(r, unit, what, signal, value, ts, seq, station=None):
            return (key[0], unit, r.event_ms, r.station_index, what, signal, value, ts, r.timestamp_ms, seq, station)

        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end].timestamp_ms == rows[at].timestamp_ms:
                end += 1
            instant, at = rows[at:end], end
            for r in instant:
                t = r.timestamp_ms
                if r.record_type == "MANUAL":
                    if r.unit_id is not None:
                        yield out(r, r.unit_id, "manual", None, 1.0 if (r.result or "").strip().upper() == "FAIL" else 0.0, t, r.event_sequence)
                elif r.event_type == "PROCESSING_STARTED":
                    if t not in groups:
                        groups[t] = [Counter(), None, None, None, []]
                        heappush(newest, -t)
                    groups[t][0][r.unit_id, r.event_sequence] += 1
                    heappush(started.setdefault(r.unit_id, []), (t, r.event_sequence))
                    changed.add(t)
                elif r.event_type == "PROCESSING_COMPLETED":
                    if r.cycle_time_ms is not None and r.unit_id is not None:
                        yield out(r, r.unit_id, "cycle", None, r.cycle_time_ms, t, r.event_sequence)
                    if not started.get(r.unit_id):
                        continue
                    start, seq = heappop(started[r.unit_id])
                    g = groups[start]
                    g[0][r.unit_id, seq] -= 1
                    if not g[0][r.unit_id, seq]:
                        del g[0][r.unit_id, seq]
                    changed.add(start)
                    if t > start and (g[1] is None or (t, seq) > (g[1], g[2])):
                        g[1:4] = [t, seq, r.unit_id]
                    if not g[0]:
                        del groups[start]
                        if g[1] is not None:
                            yield from (out(r, g[3], "sensor", signal, value, ts, at_seq) for ts, at_seq, signal, value in g[4])
                            if closed[0] is None or start > closed[0]:
                                closed = (start, g[1], g[3])
                elif r.event_type == "UNIT_ARRIVED" and r.unit_id is not None:
                    if r.queue_length_after is not None:
                        yield out(r, r.unit_id, "queue", None, r.queue_length_after, t, r.event_sequence)
                    yield out(r, r.unit_id, "arrival", None, None, t, r.event_sequence, key[1])
            for r in instant:
                if r.record_type == "SENSOR" and r.value is not None and r.sensor_type in SIGNALS:
                    while newest and -newest[0] not in groups:
                        heappop(newest)
                    last = -newest[0] if newest else None
                    if last is not None and (closed[0] is None or last > closed[0]):
                        groups[last][4].append((r.timestamp_ms, r.event_sequence, r.sensor_type, r.value))
                        changed.add(last)
                    elif closed[0] is not None and r.timestamp_ms <= closed[1]:
                        yield out(r, closed[2], "sensor", r.sensor_type, r.value, r.timestamp_ms, r.event_sequence)
        for start in changed:
            if start in groups:
                self.groups.updateValue((start,), (list(groups[start][0].elements()), *groups[start][1:]))
            elif start in before:
                self.groups.removeKey((start,))
        if closed != closed_before:
            self.closed.update(closed)


def station_readings_stream(bus: DataFrame, delay: str = "10 minutes", idle_ms: int = DAY_MS) -> DataFrame:
    rows = timed(bus, ["run_id", "station_id"], StationReadings(idle_ms), delay)
    return rows.select(*[F.timestamp_millis(c).alias("event_time") if c == "event_ms" else F.col(c) for c in rows.columns])


KINDS = [*SIGNALS, "queue", "cycle", "manual"]


class Recent:
    """Count, sum and maximum of the readings made at ``edge`` or later, as readings come in any order and the edge moves on.

    The sum is kept as exact partial sums, so what leaves takes away just what it brought.
    """

    def __init__(self):
        self.edge, self.by_time, self.by_value = -math.inf, [], []
        self.partials: list[float] = []
        self.odd = Counter()  # infinities and NaN, by name

    def _sum(self, x: float) -> None:
        kept = []
        for y in self.partials:
            if abs(x) < abs(y):
                x, y = y, x
            hi = x + y
            lo = y - (hi - x)
            if lo:
                kept.append(lo)
            x = hi
        self.partials = [*kept, x] if x else kept

    def add(self, ts: int, value: float) -> None:
        if ts >= self.edge:
            heappush(self.by_time, (ts, value))
            if not math.isnan(value):  # it has no place in an order
                heappush(self.by_value, (-value, ts))
            if math.isfinite(value):
                self._sum(value)
            else:
                self.odd[str(value)] += 1

    def since(self, edge: int) -> tuple[int, float, float | None]:
        self.edge = max(edge, self.edge)
        while self.by_time and self.by_time[0][0] < edge:
            value = heappop(self.by_time)[1]
            if math.isfinite(value):
                self._sum(-value)
            else:
                self.odd[str(value)] -= 1
        while self.by_value and self.by_value[0][1] < edge:
            heappop(self.by_value)
        odd = [float(x) for x, n in self.odd.items() if n > 0]
        top = -self.by_value[0][0] if self.by_value else math.nan if odd else None
        return len(self.by_time), math.fsum(self.partials) + sum(odd), top


class UnitHistory(Timed):
    """Unit side: at each arrival the moments of what became available before it at stations before its own.

    State is a map of sufficient statistics by station and kind, and a map of the last minutes' readings by minute; an arrival
    reads the first and the running figures of the second by station and signal, however long the unit's history is and however many
    readings ten minutes hold.
    """

    fields = "event_ms long, what string, src int, signal string, value double, ts long, avail long, seq long, station_id string"
    order = ["event_ms", "rank", "seq"]
    state_columns = [f"{s.lower()}_{m}" for s in SIGNALS for m in ("n", "s", "mx", "rn", "rs", "rmx")] + ["torque_ss"] + [
        f"{k}_{m}" for k in ("queue", "cycle") for m in ("n", "s", "ss", "mx")] + ["checks", "fails"]
    output = ("run_id string, unit_id string, prediction_station string, prediction_time long, prediction_event_sequence long, prediction_station_index int, "
              + ", ".join(f"{c} double" for c in state_columns) + ", last_check double, last_fail int")

    def __init__(self, recent_ms: int = RECENT_MS, idle_ms: int = DAY_MS):
        super().__init__(idle_ms)
        self.recent_ms = recent_ms
        self.fields = self.fields + ", rank int"

    def prepare(self, handle):
        self.stats = handle.getMapState("stats", "src int, kind string", "n double, s double, ss double, mx double, ts long, seq long, value double, fail_ts long, fail_seq long")
        self.recent = handle.getMapState("recent", "minute long", "rows array<struct<ts:bigint,src:int,signal:string,value:double>>")
        return [self.stats, self.recent]

    def step(self, key, rows):
        stats = {tuple(k): list(v) for k, v in self.stats.iterator()}
        minutes = {k[0]: [tuple(r) for r in v[0]] for k, v in self.recent.iterator()}
        recent: dict[tuple[int, str], Recent] = {}
        for held in minutes.values():
            for ts, src, signal, value in held:
                recent.setdefault((src, signal), Recent()).add(ts, value)
        changed, filled, kept = set(), set(), set(minutes)

        for r in rows:
            if r.what == "arrival":
                yield self._answer(key, r, stats, recent)
                continue
            kind = r.signal if r.what == "sensor" else r.what
            at = (r.src, kind)
            held = stats.setdefault(at, [0.0, 0.0, 0.0, None, None, None, None, None, None])
            held[0] += 1
            held[1] += r.value
            held[2] += r.value * r.value
            held[3] = r.value if held[3] is None else max(held[3], r.value)
            if kind == "manual":
                if held[4] is None or (r.ts, r.seq) > (held[4], held[5]):
                    held[4:7] = [r.ts, r.seq, r.value]
                if r.value == 1.0 and (held[7] is None or (r.ts, r.seq) > (held[7], held[8])):
                    held[7:9] = [r.ts, r.seq]
            changed.add(at)
            if r.what == "sensor" and r.ts >= r.avail - self.recent_ms:
                minutes.setdefault(r.ts // MINUTE_MS, []).append((r.ts, r.src, r.signal, r.value))
                recent.setdefault((r.src, r.signal), Recent()).add(r.ts, r.value)
                filled.add(r.ts // MINUTE_MS)
        for at in changed:
            self.stats.updateValue(at, tuple(stats[at]))
        past = (rows[-1].avail - self.recent_ms) // MINUTE_MS  # no later arrival looks further back
        for m in filled:
            if m >= past:
                self.recent.updateValue((m,), (minutes[m],))
        for m in kept:
            if m < past:
                self.recent.removeKey((m,))

    def _answer(self, key, r: tuple, stats: dict, recent: dict) -> tuple:
        t, own = r.ts, r.src
        got: dict[str, float | None] = {c: 0.0 if c.rsplit("_", 1)[-1] in ("n", "s", "ss", "rn", "rs", "checks", "fails") else None for c in self.state_columns}
        check = fail = None

        def more(name: str, value: float | None) -> None:
            got[name] = value if got[name] is None else got[name] if value is None else max(got[name], value)

        for (src, kind), (n, s, ss, mx, ts, seq, value, fail_ts, fail_seq) in stats.items():
            if src >= own:
                continue
            if kind == "manual":
                got["checks"] += n
                got["fails"] += s
                check = max(check, (ts, seq, value)) if check else (ts, seq, value)
                if fail_ts is not None:
                    fail = max(fail, (fail_ts, fail_seq, src)) if fail else (fail_ts, fail_seq, src)
                continue
            p = kind.lower()
            got[f"{p}_n"] += n
            got[f"{p}_s"] += s
            if f"{p}_ss" in got:
                got[f"{p}_ss"] += ss
            more(f"{p}_mx", mx)
        for (src, signal), window in recent.items():
            if src < own:
                n, s, mx = window.since(t - self.recent_ms)
                p = signal.lower()
                got[f"{p}_rn"] += n
                got[f"{p}_rs"] += s
                more(f"{p}_rmx", mx)
        return (key[0], key[1], r.station_id, t, r.seq, own, *[got[c] for c in self.state_columns], check[2] if check else None, fail[2] if fail else None)


def unit_history_stream(elements: DataFrame, delay: str = "10 minutes", **settings) -> DataFrame:
    """One row an arrival. Reads what the station side wrote, by the time at which it became available."""
    ranked = elements.withColumn("rank", F.when(F.col("what") == "arrival", 0).otherwise(1))  # an arrival doesn't see its own instant
    rows = timed(ranked, ["run_id", "unit_id"], UnitHistory(**settings), delay)
    last = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias(name))).alias(c) for c, name in (("last_check", "fail"), ("last_fail", "src"))}
    return rows.select(*[last.get(c, F.col(c)) for c in rows.columns])
