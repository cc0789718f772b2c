"""Side-by-side comparison of a registered query with its DuckDB statement."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    if hasattr(v, "asDict"):
        return norm(list(v))
    if isinstance(v, dict):
        return [norm(x) for x in v.values()]
    return v


def kind(v):
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, decimal.Decimal):
        return "decimal"
    return type(v).__name__


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    data = [[norm(r[i]) for i in order] for r in rows]
    types = []
    for i in order:
        types.append(next((kind(r[i]) for r in rows if r[i] is not None), None))
    data.sort(key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])
    return cols, types, data


def compare(spark, con, sf, q):
    t0 = time.time()
    df = q.run(spark, sf)
    got = table_of(df.columns, df.collect())
    spent = time.time() - t0
    if q.sql is None:
        return f"rows-only n={len(got[2])}", spent, len(got[2]) > 0
    res = con.execute(q.sql)
    want = table_of([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", spent, False
    types = [(c, a, b) for c, a, b in zip(got[0], got[1], want[1]) if a and b and a != b]
    if types:
        return f"TYPES {types}", spent, False
    if got[2] != want[2]:
        extra = [r for r in got[2] if r not in want[2]][:3] if len(got[2]) < 5000 else got[2][:2]
        lack = [r for r in want[2] if r not in got[2]][:3] if len(got[2]) < 5000 else want[2][:2]
        if len(got[2]) >= 5000:
            pairs = [(a, b) for a, b in zip(got[2], want[2]) if a != b][:3]
            extra, lack = [p[0] for p in pairs], [p[1] for p in pairs]
        return f"VALUES n={len(got[2])}/{len(want[2])}\n   spark {extra}\n   duck  {lack}", spent, False
    return f"ok n={len(got[2])}", spent, True


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from cuesheet.plans.registry import all_queries
    from cuesheet.session import local_session

    args = sys.argv[1:]
    sf = "/root/testdata/sf" + (args.pop(0) if args and args[0][0] == "0" else "0.01")
    spark, con = local_session(), connect(sf)
    bad = []
    for name, q in all_queries().items():
        if args and not any(a in name for a in args):
            continue
        try:
            msg, spent, ok = compare(spark, con, sf, q)
        except Exception as e:  # noqa: BLE001
            msg, spent, ok = f"ERROR {type(e).__name__} {str(e)[:1500]}", 0.0, False
        print(f"{name:32s} {spent:6.2f}s {msg}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:" if bad else "ALL OK", bad or "")
