"""Compare a registered query with its SQL twin on the same tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0) if v != int(v) or abs(v) > 1e15 else str(int(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message, seconds)."""
    t = time.time()
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"rows={len(left)} (no SQL twin)", took
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    right = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", took
    if left != right:
        a, b = set(left), set(right)
        only_l, only_r = sorted(a - b)[:3], sorted(b - a)[:3]
        return False, (
            f"rows {len(left)} vs {len(right)}; {len(a - b)} / {len(b - a)} differ\n"
            f"   cols  {sorted(cols)}\n   spark {only_l}\n   sql   {only_r}"
        ), took
    types = dict(zip(cols, [str(d[1]) for d in cur.description], strict=True))
    odd = {c: (t, types[c]) for c, t in df.dtypes if not _same_kind(t, types[c])}
    return True, f"rows={len(left)}" + (f" types {odd}" if odd else ""), took


def _same_kind(spark_type: str, duck_type: str) -> bool:
    t, d = spark_type.lower(), duck_type.lower()
    if "int" in t:
        return "int" in d and "huge" not in d or d == "number"
    if t == "double":
        return d in ("double", "float", "number")
    if "decimal" in d or "huge" in d:
        return False
    return True
