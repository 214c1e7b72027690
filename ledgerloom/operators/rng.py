"""Random streams that depend on names alone: equal for any order, chunking or partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A number in (0, 1) for the key's parts joined by '|': 48 bits of their MD5, at the middle of the step."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def uniform_sql(*key: str) -> str:
    """The same in DuckDB's SQL; parts are SQL expressions."""
    return f"((CAST('0x' || substr(md5({" || '|' || ".join(f'CAST({k} AS VARCHAR)' for k in key)}), 1, 12) AS BIGINT)) + 0.5) / {float(1 << 48)!r}"


def normal(*key: Column | str | int) -> Column:
    """A standard normal number, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(*key, "a"))) * F.cos(2 * math.pi * uniform(*key, "b"))


def normal_sql(*key: str) -> str:
    return f"(sqrt(-2 * ln({uniform_sql(*key, "'a'")})) * cos({2 * math.pi!r} * {uniform_sql(*key, "'b'")}))"
