"""Run registered queries in Spark and DuckDB on the same files and compare the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""
from __future__ import annotations

import argparse
import decimal
import glob
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (v + 0.0)
    return str(v)


def _key(row):
    return tuple((x is None, str(type(x)), round(x, 3) if isinstance(x, float) else x) for x in row)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    """Return a message, empty when equal."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return "", len(rows)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    types = dict(zip(names, [str(x[1]) for x in cur.description]))
    if sorted(names) != cols:
        return f"columns differ: {sorted(set(names) ^ set(cols))}", len(rows)
    order = [names.index(c) for c in cols]
    other = [tuple(_norm(r[i]) for i in order) for r in cur.fetchall()]
    if len(rows) != len(other):
        return f"row counts {len(rows)} spark vs {len(other)} duckdb", len(rows)
    rows.sort(key=_key)
    other.sort(key=_key)
    exact = True
    for x, y in zip(rows, other):
        for c, p, q in zip(cols, x, y):
            if p == q:
                continue
            exact = False
            if isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(p)):
                continue
            return f"first difference in {c}: spark {p!r} duckdb {q!r}\n   {x}\n   {y}", len(rows)
    wide = [f"{c}:{t}" for c, t in types.items() if "HUGEINT" in t or "DECIMAL" in t]
    note = (f"(wide types {wide}) " if wide else "") + ("" if exact else "(equal within 1e-9 only)")
    return ("" if not note else "NOTE " + note), len(rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from takt.session import local_session
    import importlib
    if a.module:
        m = importlib.import_module(f"takt.catalog.{a.module}")
        q, o = m.QUERIES, m.ORACLE
    else:
        from takt.catalog import collect
        q, o = collect()
    spark, con = local_session(), duck(a.sf)
    bad = 0
    for name in a.names or q:
        t = time.time()
        try:
            msg, n = compare(spark, con, a.sf, q[name], o.get(name))
        except Exception as e:  # report and go on with the next query
            msg, n = "ERROR " + (traceback.format_exc()[-300:] if not str(e) else str(e)[:700]), -1
        ok = not msg or msg.startswith("NOTE")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={n:6d} {time.time() - t:5.1f}s "
              f"{'' if name in o else '(rows only)'} {msg}", flush=True)
    print("failed:", bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
