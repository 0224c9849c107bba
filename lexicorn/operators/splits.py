"""Seeded train / validation / test splits without any global sort.

``hash_split`` assigns each row by ``u(seed, row_id)`` against the thresholds
``t`` and ``t + (1 - t) * v / (v + e)``. ``exact_split`` reproduces exact split
sizes (test = ceil(share * n), train = rest, twice) by ranking on ``(u, row_id)``
using two small driver-side histograms of the 32-bit hash instead of a global
window; only rows sharing the boundary hash value are ranked by a window.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicorn.functions.hashing import hash_uniform
from lexicorn.session import write_once


def check_ratios(train: float, val: float, test: float) -> None:
    for r in (train, val, test):
        if not 0.0 < r < 1.0:
            raise ValueError("every split ratio must lie in (0, 1)")


def thresholds(train: float, val: float, test: float) -> tuple[float, float]:
    check_ratios(train, val, test)
    t1 = float(train)
    t2 = t1 + (1.0 - t1) * (val / (val + test))
    return t1, t2


def hash_split(df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1,
               seed: int = 42, id_col: str = "row_id", out_col: str = "split") -> DataFrame:
    t1, t2 = thresholds(train, val, test)
    u = hash_uniform(seed, id_col)
    return df.withColumn(out_col, F.when(u < F.lit(t1), "train")
                         .when(u < F.lit(t2), "validation").otherwise("test"))


def _first_n(df: DataFrame, key_col: str, id_col: str, n_first: int) -> DataFrame:
    """Mark the ``n_first`` rows smallest by (key_col (32-bit int), id_col) with _first=true."""
    if n_first <= 0:
        return df.withColumn("_first", F.lit(False))
    hi = (F.col(key_col) / F.lit(65536)).cast("bigint")
    # level 1: histogram of the high 16 bits (<= 65536 rows reach the driver)
    h1 = sorted((r[0], r[1]) for r in df.groupBy(hi.alias("b")).count().collect())
    acc, b_star, before = 0, None, 0
    for b, c in h1:
        if acc + c >= n_first:
            b_star, before = b, acc
            break
        acc += c
    if b_star is None:
        return df.withColumn("_first", F.lit(True))
    lo = F.col(key_col) % F.lit(65536)
    h2 = sorted((r[0], r[1]) for r in df.filter(hi == F.lit(b_star))
                .groupBy(lo.alias("b")).count().collect())
    acc2, v_star, before2 = before, None, before
    for b, c in h2:
        if acc2 + c >= n_first:
            v_star, before2 = b_star * 65536 + b, acc2
            break
        acc2 += c
    need = n_first - before2  # rows to take among those with key == v_star, by id
    # only rows that share the boundary hash value are ranked; nothing is joined, so rows
    # with equal ids stay what they are
    rank = F.row_number().over(Window.partitionBy(key_col).orderBy(id_col, F.xxhash64(*df.columns)))
    at = F.col(key_col)
    return (df.filter(at != v_star).withColumn("_first", at < v_star)
            .unionByName(df.filter(at == v_star).withColumn("_first", rank <= need)))


def exact_split(df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1,
                seed: int = 42, id_col: str = "row_id", out_col: str = "split") -> DataFrame:
    """Exact sizes: rest = ceil((1-train)*n); test = ceil((1-val_rel)*rest); by hash order."""
    check_ratios(train, val, test)
    k1 = (hash_uniform(seed, id_col) * F.lit(4294967296.0)).cast("bigint")
    k2 = (hash_uniform(f"{seed}:2", id_col) * F.lit(4294967296.0)).cast("bigint")
    staged = write_once(df.withColumn("_k1", k1).withColumn("_k2", k2))
    n = staged.count()
    n_rest = math.ceil((1.0 - train) * n)
    n_train = n - n_rest
    val_rel = val / (val + test)
    n_test = math.ceil((1.0 - val_rel) * n_rest)
    n_val = n_rest - n_test
    first = _first_n(staged, "_k1", id_col, n_train)
    first = first.withColumn("_is_train", F.col("_first")).drop("_first")
    rest = first.filter(~F.col("_is_train"))
    rest = _first_n(rest, "_k2", id_col, n_val)
    rest = rest.withColumn(out_col, F.when(F.col("_first"), "validation").otherwise("test"))
    trainers = first.filter(F.col("_is_train")).withColumn(out_col, F.lit("train"))
    cols = df.columns + [out_col]
    return trainers.select(*cols).unionByName(rest.select(*cols))


def holdout(df: DataFrame, share: float = 0.10, seed: int = 42, id_col: str = "row_id",
            out_col: str = "holdout") -> DataFrame:
    """Second hold-out (a tenth by default) with its own salt."""
    u = hash_uniform(f"{seed}:holdout", id_col)
    return df.withColumn(out_col, u < F.lit(float(share)))
