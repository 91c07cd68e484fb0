"""Spark rows against DuckDB rows of the same tables, without order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    con.execute("SET threads=2")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    return names, r.fetchall()


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v) if not isinstance(v, bool) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


def same(df, sf_dir: str, sql: str) -> str:
    """'' if both have the same columns and rows, else what differs."""
    names, want = duck(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    got = df.collect()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {odd}"
