"""Runs registered queries beside their SQL and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb

from railbird.plans import registry


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    fn, text = registry.queries()[name], registry.oracle_sql().get(name)
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if text is None:
        return True, f"rows={len(got)} no sql {took:.1f}s"
    cur = con.execute(text)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        sa, sb = set(a), set(b)
        return False, (f"rows {len(a)} vs {len(b)}; cols {sorted(names)}; only spark {list(sa - sb)[:2]}; "
                       f"only sql {list(sb - sa)[:2]}")
    return True, f"rows={len(a)} {took:.1f}s"
