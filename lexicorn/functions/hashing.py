"""Deterministic, partition-independent randomness.

``u(seed, key) = int(first 8 hex digits of md5("seed:key"), 16) / 2**32`` in [0, 1).
The same value is computed by DuckDB as ``('0x' || substr(md5(..), 1, 8))::BIGINT / 2**32``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_uniform(seed: int | str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed))] + [F.col(k) if isinstance(k, str) else k for k in keys]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(TWO_32)


def sql_hash_uniform(seed: int | str, *key_sql: str) -> str:
    """DuckDB twin of :func:`hash_uniform` (keys are SQL expressions)."""
    inner = " || ':' || ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(('0x' || substr(md5({inner}), 1, 8))::BIGINT / {TWO_32!r})"
