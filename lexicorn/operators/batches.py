"""Deterministic order, ranks and padded batches without a single-partition window.

``dense_rank_by`` is a distributed zip-with-index: range-partition on the sort key, sort
inside partitions and write the rows once together with their partition and place; the
counts per partition, taken from what was written, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicorn.functions.hashing import hash_uniform
from lexicorn.functions.tokens import IGNORE_LABEL, PAD_ID
from lexicorn.session import write_once


def dense_rank_by(df: DataFrame, order_cols: list[str], out_col: str = "rank",
                  num_partitions: int | None = None) -> DataFrame:
    """0-based global rank in ``order_cols`` order (keys must be unique together).

    The range bounds are sampled, and a second job would sample others, so partition and
    place are fixed by writing them; counts and ranks both read the written rows."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    place = F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)
    placed = write_once(ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_place", place))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition
    offsets = (placed.groupBy("_pid").agg(F.count("*").alias("_n"))
               .select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    return (placed.join(F.broadcast(offsets), on="_pid", how="left")
            .withColumn(out_col, (F.col("_off") + F.col("_place")).cast("bigint"))
            .drop("_pid", "_place", "_off"))


def epoch_key(seed: int, epoch: int | Column, id_col: str = "row_id") -> Column:
    """Shuffled epoch order: rows sort by this key (ties by id)."""
    return hash_uniform(seed, F.lit(epoch) if isinstance(epoch, int) else epoch, id_col)


def assign_batches(ranked: DataFrame, batch_size: int, rank_col: str = "rank",
                   out_col: str = "batch_id") -> DataFrame:
    return ranked.withColumn(out_col, F.floor(F.col(rank_col) / F.lit(int(batch_size))).cast("bigint"))


def pad_collate(df: DataFrame, ids_col: str = "ids", batch_col: str = "batch_id") -> DataFrame:
    """Pad ids and mask with 0 to the batch maximum; labels = ids shifted left, last -100."""
    m = F.max(F.size(ids_col)).over(Window.partitionBy(batch_col))
    pad = F.array_repeat(F.lit(PAD_ID), (F.col("_m") - F.size(ids_col)).cast("int"))
    out = (df.withColumn("_m", m)
           .withColumn("input_ids", F.concat(F.col(ids_col), pad))
           .withColumn("attention_mask",
                       F.concat(F.array_repeat(F.lit(1), F.size(ids_col)), pad)))
    labels = F.when(F.col("_m") > 0, F.concat(
        F.slice("input_ids", 2, F.greatest(F.col("_m") - 1, F.lit(0)).cast("int")),
        F.array(F.lit(IGNORE_LABEL)))).otherwise(F.array().cast("array<int>"))
    return out.withColumn("labels", labels).drop("_m")
