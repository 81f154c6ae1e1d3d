"""Pure per-key steps of the stateful operators: (key, state, sorted new rows) -> (state, output rows).

State is a small dict of plain values, bounded by a time span or a count. Rows arrive as a pandas frame
of one key and one micro-batch, already in event order.
"""
from __future__ import annotations

import numpy as np
import pandas as pd

RECENT, KEEP = 600_000, 1_200_000


def quarantine(key, state, pdf):
    """Mark rows older than what the key has already seen."""
    last = state.get("last")
    late = []
    for t, s in zip(pdf["timestamp_ms"], pdf["event_sequence"]):
        now = (int(t), int(s))
        late.append(last is not None and now < last)
        last = now if last is None or now > last else last
    out = pdf.copy()
    out["late"] = late
    return {"last": last}, out


def _three(v):
    v = v[~np.isnan(v)]
    n = len(v)
    return (v.mean() if n else np.nan, v.std(ddof=1) if n > 1 else np.nan, v.max() if n else np.nan)


def _slope(t, q):
    ok = ~np.isnan(q)
    t, q = t[ok].astype(float), q[ok]
    n, d = len(t), len(np.unique(t))
    if n < 2 or d < 2:
        return np.nan, np.nan
    x = t - t.mean()
    sxx, sxy = (x * x).sum(), (x * (q - q.mean())).sum()
    slope = sxy / sxx
    if d < 3 or n < 3:
        return slope, np.nan
    rest = max(0.0, ((q - q.mean()) ** 2).sum() - sxy * sxy / sxx)
    return slope, np.sqrt(rest / (n - 2) / sxx)


def flow_step(key, state, pdf):
    """Window statistics per station event from the last 20 minutes of the station."""
    hist = state.get("rows", [])
    n_old = len(hist)
    hist = hist + list(zip(pdf["timestamp_ms"].astype("int64"), pdf["event_sequence"].astype("int64"),
                           pdf["queue_length_after"].astype(float), pdf["cycle_time_ms"].astype(float), pdf["event_type"]))
    t = np.array([r[0] for r in hist], dtype="int64")
    q, c = np.array([r[2] for r in hist]), np.array([r[3] for r in hist])
    arr, srv = np.array([r[4] == "UNIT_ARRIVED" for r in hist]), np.array([r[4] == "PROCESSING_COMPLETED" for r in hist])
    last_q, last_ts, silent = state.get("q", 0.0), state.get("ts"), state.get("silent", 0)
    out = []
    for i in range(n_old, len(hist)):
        lo, lo2, hi = np.searchsorted(t, t[i] - RECENT), np.searchsorted(t, t[i] - KEEP), i + 1
        if not np.isnan(q[i]):
            last_q, last_ts, silent = float(q[i]), int(t[i]), 0
        else:
            silent += 1
        qs, cs, pq = _three(q[lo:hi]), _three(c[lo:hi]), _three(q[lo2:lo])
        slope, se = _slope(t[lo:hi], q[lo:hi])
        out.append((key[0], key[1], int(t[i]), int(hist[i][1]), q[i], last_q, last_ts, silent, *qs, *cs, float(arr[lo:hi].sum()),
                    float(srv[lo:hi].sum()), pq[0], float(arr[lo2:lo].sum()), float(srv[lo2:lo].sum()), slope, se))
    first = np.searchsorted(t, t[-1] - KEEP) if len(t) else 0
    state = {"rows": hist[first:], "q": last_q, "ts": last_ts, "silent": silent}
    return state, pd.DataFrame(out, columns=FLOW_OUT)


FLOW_OUT = ["run_id", "station_id", "ts", "seq", "q", "occupancy", "carry_ts", "carry_steps", "queue_mean", "queue_std", "queue_max", "cycle_mean",
            "cycle_std", "cycle_max", "arrivals", "services", "prev_queue_mean", "prev_arrivals", "prev_services", "slope", "slope_se"]
FLOW_SCHEMA = ("run_id string, station_id string, ts long, seq long, q double, occupancy double, carry_ts long, carry_steps long, "
               + ", ".join(f"{c} double" for c in FLOW_OUT[8:]))


def monotone_step(key, state, pdf, min_confidence=0.6):
    """Accept inferred stations only downstream; the first one at any confidence."""
    reach, out = state.get("reach"), []
    for r in pdf.itertuples(index=False):
        i = int(r.station_index)
        ok = reach is None or r.state_confidence >= min_confidence
        verdict = ("accepted" if reach is None else "refresh" if i == reach else "backward" if i < reach else "accepted" if ok else "low_confidence")
        if verdict == "accepted":
            reach = i
        out.append((r.run_id, r.unit_id, int(r.seq), verdict))
    return {"reach": reach}, pd.DataFrame(out, columns=["run_id", "unit_id", "seq", "verdict"])


def policy_step(key, state, pdf):
    """The six alert-policy scores from the last two scores and three running means."""
    last, ema, out = state.get("last", []), state.get("ema"), []
    for r in pdf.itertuples(index=False):
        x = float(r.score)
        ema = [x] * 3 if ema is None else [a * x + (1 - a) * e for a, e in zip((0.3, 0.5, 0.7), ema)]
        three = sorted(last[-2:] + [x], reverse=True)
        out.append((r.run_id, r.unit_id, int(r.seq), x, *ema, min(x, last[-1]) if last else None, three[1] if len(three) > 1 else None))
        last = (last + [x])[-2:]
    return {"last": last, "ema": ema}, pd.DataFrame(out, columns=["run_id", "unit_id", "seq", "raw", "ema_03", "ema_05", "ema_07", "two_consecutive", "two_of_three"])


def session_step(key, state, pdf):
    """Warning periods; a running one is emitted open and again closed once a record clears it."""
    cur, out = state.get("cur"), []
    for r in pdf.itertuples(index=False):
        t = int(r.timestamp_ms)
        if r.warning:
            cur = [t, t, 1] if cur is None else [cur[0], t, cur[2] + 1]
        elif cur is not None:
            out.append((key[0], key[1], *cur, False))
            cur = None
    if cur is not None:
        out.append((key[0], key[1], *cur, True))
    return {"cur": cur}, pd.DataFrame(out, columns=["run_id", "series_key", "start_ms", "end_ms", "point_count", "open_ended"])
