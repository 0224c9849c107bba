"""ROUGE-L over token arrays: LCS length, precision / recall / F1, means.

The LCS is bit-parallel: an Arrow-batched pandas UDF by default; the ``lcs_length_native``
variant folds 62-bit words with their carries in the JVM.
Callers score *distinct* (reference, hypothesis) pairs and join the scores back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.functions.tokens import rouge_tokens


def _lcs_dp(a, b) -> int:
    """Plain O(n*m) dynamic programme (reference implementation for tests)."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    prev = [0] * (len(b) + 1)
    for x in a:
        cur = [0]
        for j, y in enumerate(b, start=1):
            cur.append(prev[j - 1] + 1 if x == y else max(prev[j], cur[j - 1]))
        prev = cur
    return prev[-1]


def _lcs(a, b) -> int:
    """Bit-parallel LCS length (Hyyro 2004): one big-int update per token of ``b``."""
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | (1 << i)
    n = len(a)
    full = (1 << n) - 1
    v = full
    for y in b:
        u = v & masks.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return n - bin(v).count("1")


@F.pandas_udf(T.IntegerType())
def lcs_length(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([_lcs(a, b) for a, b in zip(ref, hyp)], dtype="int32")


#: bits of a word of the JVM variant: a sum of two words and a carry must fit a long
WORD = 62


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as the one element of an array."""
    return F.transform(F.array(value), body)[0]


def lcs_length_native(ref: Column | str, hyp: Column | str) -> Column:
    """Bit-parallel LCS length as Column expressions. Tokens of one side only are dropped, the
    others become their place among the common ones; the state is an array of 62-bit words."""
    r = F.col(ref) if isinstance(ref, str) else ref
    h = F.col(hyp) if isinstance(hyp, str) else hyp
    full = F.lit((1 << WORD) - 1).cast("bigint")

    def places(tokens: Column, common: Column) -> Column:
        return F.filter(F.transform(tokens, lambda x: F.array_position(common, x)), lambda x: x > 0)

    def masks(s: Column) -> Column:
        """Per common token its bits in each word of the reference."""
        def word(k, w):
            bits = F.transform(F.slice(s["r"], w * WORD + 1, F.lit(WORD)), lambda x, i: F.when(
                x == k, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
            return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(x))
        return F.transform(F.sequence(F.lit(1).cast("bigint"), s["n"]),
                           lambda k: F.transform(F.sequence(F.lit(0), s["last"]), lambda w: word(k, w)))

    def step(v: Column, m: Column, last: Column) -> Column:
        def word(acc, w):
            x, u = F.get(v, w), F.get(v, w).bitwiseAND(F.get(m, w))
            total = x + u + acc["carry"]
            return F.struct(F.shiftright(total, WORD).alias("carry"),
                            F.concat(acc["out"], F.array(total.bitwiseAND(full).bitwiseOR(x - u))).alias("out"))
        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), last), start, word, lambda acc: acc["out"])

    def zeros(v: Column) -> Column:
        return F.aggregate(v, F.lit(0), lambda acc, x: acc + (F.lit(WORD) - F.bit_count(x)).cast("int"))

    def length(s: Column) -> Column:
        return _bound(masks(s), lambda ms: F.aggregate(
            s["h"], F.array_repeat(full, s["last"] + 1),
            lambda v, k: step(v, F.get(ms, (k - 1).cast("int")), s["last"]), zeros))

    def sides(common: Column) -> Column:
        return F.struct(places(r, common).alias("r"), places(h, common).alias("h"),
                        F.size(common).cast("bigint").alias("n"))

    def counted(s: Column) -> Column:
        return F.struct(s["r"].alias("r"), s["h"].alias("h"), s["n"].alias("n"),
                        F.floor((F.size(s["r"]) - 1) / F.lit(WORD)).cast("int").alias("last"))

    some = _bound(F.array_intersect(r, h), lambda common: F.when(F.size(common) == 0, F.lit(0)).otherwise(
        _bound(sides(common), lambda s: F.when(F.size(s["r"]) == 0, F.lit(0)).otherwise(
            _bound(counted(s), length)))))
    return F.when((F.size(r) == 0) | (F.size(h) == 0), F.lit(0)).otherwise(some)


def f1_from_lcs(lcs: Column, n_ref: Column, n_hyp: Column) -> Column:
    p = lcs.cast("double") / n_hyp
    r = lcs.cast("double") / n_ref
    f = F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.when((n_ref == 0) | (n_hyp == 0), F.lit(0.0)).otherwise(f)


def rouge_l(df: DataFrame, ref_col: str, hyp_col: str, out_col: str = "rouge_l",
            stem: bool = True, native: bool = False) -> DataFrame:
    """Add ROUGE-L F1 between two text columns, row by row: tokens, stems and LCS are
    computed where the row is, so there is no shuffle and no join."""
    from lexicorn.operators.stem import stem_tokens
    d = df.withColumn("_rt", rouge_tokens(ref_col)).withColumn("_ht", rouge_tokens(hyp_col))
    if stem:
        d = stem_tokens(d, "_rt", "_ht")
    lcs = lcs_length_native("_rt", "_ht") if native else lcs_length("_rt", "_ht")
    return d.withColumn(out_col, f1_from_lcs(lcs, F.size("_rt"), F.size("_ht"))).drop("_rt", "_ht")


def rouge_mean(df: DataFrame, col: str = "rouge_l", out_col: str = "rouge_l") -> DataFrame:
    return df.agg(F.coalesce(F.avg(col), F.lit(0.0)).alias(out_col))
