"""Comparison of a query's rows with DuckDB's rows for the same question."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, bool) or v is None:
        return v
    return float(v) if isinstance(v, int) else v


def difference(df, con, sql: str) -> str:
    """Empty if column names and rows agree."""
    rel = con.sql(sql)
    ours, theirs = sorted(df.columns), sorted(rel.columns)
    if ours != theirs:
        return f"columns {ours} against {theirs}"
    a = Counter(tuple(plain(r[c]) for c in ours) for r in df.collect())
    at = [rel.columns.index(c) for c in theirs]
    b = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if a == b:
        return ""
    return f"{sum((a - b).values())} of {sum(a.values())} rows differ from {sum(b.values())}: {list((a - b).items())[:2]} against {list((b - a).items())[:2]}"
