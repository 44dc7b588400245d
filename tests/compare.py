"""Spark's rows against DuckDB's for the same query, as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "is_finite"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names, want = rows_of([c[0] for c in got.description], got.fetchall())
    own, have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if own != names:
        return f"columns {own} and {names}"
    if have != want:
        return f"{sum(have.values())} and {sum(want.values())} rows; only Spark: {list((have - want).items())[:3]}; only SQL: {list((want - have).items())[:3]}"
    return ""
