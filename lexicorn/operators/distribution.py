"""Operators over a next-token distribution table ``(ctx, token, p)``, one window per context.

Cumulative sums are compared after rounding to 12 places: sums of equal terms in another
order differ in their last bits, and a bound that is met exactly must not hang on that."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexicorn.functions.hashing import hash_uniform

PLACES = 12


def apply_temperature(df: DataFrame, temperature: float, ctx: str = "ctx", p: str = "p") -> DataFrame:
    """``softmax(log p / T)``: divide by the context maximum first so small T cannot underflow."""
    w = Window.partitionBy(ctx)
    t = max(float(temperature), 1e-8)
    q = F.pow(F.col(p) / F.max(p).over(w), F.lit(1.0 / t))
    out = df.withColumn("_q", q)
    return out.withColumn(p, F.col("_q") / F.sum("_q").over(w)).drop("_q")


def top_p_filter(df: DataFrame, top_p: float, ctx: str = "ctx", token: str = "token",
                 p: str = "p") -> DataFrame:
    """Keep tokens (p desc, token asc) while the cumulative sum <= top_p; always the first."""
    w = Window.partitionBy(ctx).orderBy(F.col(p).desc(), F.col(token))
    cum = F.round(F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)), PLACES)
    return (df.withColumn("_cum", cum).withColumn("_rn", F.row_number().over(w))
              .filter((F.col("_cum") <= F.lit(float(top_p))) | (F.col("_rn") == 1))
              .drop("_cum", "_rn"))


def renormalise(df: DataFrame, ctx: str = "ctx", p: str = "p") -> DataFrame:
    return df.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(ctx)))


def draw(df: DataFrame, seed: int, ctx: str = "ctx", token: str = "token", p: str = "p",
         key: str | None = None) -> DataFrame:
    """Inverse CDF per context on a hashed uniform: first token (p desc, token asc) whose
    cumulative exceeds u; the last token when rounding leaves u above the total."""
    key = key or ctx
    w = Window.partitionBy(ctx).orderBy(F.col(p).desc(), F.col(token))
    cum = F.round(F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, 0)), PLACES)
    total = F.round(F.sum(p).over(Window.partitionBy(ctx)), PLACES)
    staged = (df.withColumn("_u", hash_uniform(seed, F.col(key).cast("string")))
              .withColumn("_cum", cum).withColumn("_rn", F.row_number().over(w))
              .withColumn("_tot", total))
    hit = (F.col("_cum") > F.col("_u")) | (F.col("_cum") >= F.col("_tot"))
    picked = staged.filter(hit).groupBy(ctx).agg(F.min(F.struct("_rn", token)).alias("_b"))
    return picked.select(ctx, F.col("_b")[token].alias(token))
