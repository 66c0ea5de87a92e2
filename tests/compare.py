"""Run a registered query and its SQL on the same tables and compare row by row."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "isoformat"):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def _key(row):
    return tuple((x is None, round(x, 3) if isinstance(x, float) else 0 if x is None else x, "") if not isinstance(x, str) else (x is None, 0, x) for x in row)


def compare(spark, con, name, query, sql, sf_dir, tol=1.01e-6):
    t0 = time.time()
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(_norm(v) for v in row) for row in df.select(*[f"`{c}`" for c in cols]).collect()]
    t1 = time.time()
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = dict(zip(names, [str(d[1]) for d in res.description]))
    if sorted(names) != cols:
        return False, f"columns {cols} vs {sorted(names)}", t1 - t0, len(got)
    idx = [names.index(c) for c in cols]
    want = [tuple(_norm(row[i]) for i in idx) for row in res.fetchall()]
    t2 = time.time()
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}", t1 - t0, len(got)
    got.sort(key=_key), want.sort(key=_key)
    exact = 0
    for g, w in zip(got, want):
        if g == w and all(type(a) is type(b) for a, b in zip(g, w)):
            exact += 1
            continue
        for c, a, b in zip(cols, g, w):
            close = isinstance(a, (int, float)) and isinstance(b, (int, float)) and abs(a - b) <= tol * max(1.0, abs(a))
            if not (a == b or close):
                return False, f"{c}: {a!r} vs {b!r} in\n   {dict(zip(cols, g))}\n   {dict(zip(cols, w))}", t1 - t0, len(got)
    note = "" if exact == len(got) else f" only {exact}/{len(got)} exact"
    decs = [c for c in names if "DECIMAL" in types[c].upper() or "HUGEINT" in types[c].upper()]
    if decs:
        note += f" DECIMAL/HUGEINT {decs}"
    return True, f"{note} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s", t1 - t0, len(got)
