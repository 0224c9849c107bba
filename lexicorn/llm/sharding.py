"""Operator 1: two-pass external shuffle into shards (DataFrame functions only).

Pass 1 scatters every row by seeded hashes: the key chooses the shard by highest random
weight (so one more shard takes rows only into itself), a hash of the row's place in the
input chooses a memory-sized bucket inside the shard. The scattered table is written to
the shared folder. Pass 2 gathers each bucket as one array, shuffles it with the seeded
Fisher-Yates of ``shuffle`` and emits it at the bucket's offset inside the shard.

The number of buckets of a shard follows the bytes and rows that pass 1 put there, so a
hot key (whose rows must share a shard) only means more buckets, never a larger one. A
single row larger than ``bucket_bytes`` makes a bucket of its own size.

Defined cases: null key = one more key value; null text = no bytes; repeated rows are
kept and get slots of their own; an empty table gives an empty result; input columns
named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicorn.llm.common import materialize, without

ROW_OVERHEAD = 16
OUTPUT = ["size", "shard", "slot", "grown_shard", "bucket"]


def _weight(seed: int, shard: Column | int, key: str) -> Column:
    shard = F.lit(shard) if isinstance(shard, int) else shard
    return F.xxhash64(F.lit(seed), shard.cast("int"), F.col(key))


def shard_of(key: str, n_shards: int, seed: int) -> Column:
    """Struct (weight, shard) of the heaviest shard for the key."""
    return F.array_max(F.transform(
        F.sequence(F.lit(0), F.lit(n_shards - 1)),
        lambda s: F.struct(_weight(seed, s, key).alias("weight"), s.alias("shard"))))


def scatter(df: DataFrame, n_shards: int, key: str, text: str, seed: int) -> DataFrame:
    """Pass 1: (row STRUCT, size, shard, grown_shard, salt), written to the shared folder.

    The salt hashes the row's place, not its content, so equal rows scatter as well; it is
    written before anything depends on it, so a recomputed task cannot change it."""
    kept = without(df, OUTPUT)
    best = F.col("_best")
    scattered = (
        kept.select(F.struct(*[kept[c] for c in kept.columns]).alias("row"),
                    (F.coalesce(F.octet_length(kept[text]), F.lit(0)) + ROW_OVERHEAD)
                    .cast("long").alias("size"),
                    kept[key].alias("_key"),
                    F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()).alias("salt"))
        .withColumn("_best", shard_of("_key", n_shards, seed))
        .withColumn("shard", best["shard"])
        .withColumn("grown_shard", F.when(
            F.struct(_weight(seed, n_shards, "_key").alias("weight"), F.lit(n_shards).alias("shard"))
            > best, F.lit(n_shards)).otherwise(best["shard"]))
        .drop("_best", "_key"))
    return materialize(scattered, "scatter")


def shard_documents(df: DataFrame, n_shards: int = 40, key: str = "doc_id", text: str = "text",
                    seed: int = 17, bucket_bytes: int = 4 << 20,
                    bucket_rows: int = 20_000) -> DataFrame:
    """All rows of ``df`` with ``size, shard, slot, grown_shard, bucket``; ``slot`` counts
    from 0 without gaps inside each shard, in shuffled order."""
    scattered = scatter(df, n_shards, key, text, seed)
    totals = {r["shard"]: max(1, -(-r["b"] // bucket_bytes), -(-r["n"] // bucket_rows))
              for r in scattered.groupBy("shard").agg(F.sum("size").alias("b"),
                                                      F.count("*").alias("n")).collect()}
    buckets = F.array(*[F.lit(totals.get(s, 1)) for s in range(n_shards)])
    placed = scattered.withColumn(
        "bucket", F.pmod("salt", F.element_at(buckets, F.col("shard") + 1)).cast("long"))

    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "bucket").agg(F.count("*").alias("_n"))
               .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .drop("_n"))

    def by_salt(a: Column, b: Column) -> Column:
        return F.when(a["salt"] < b["salt"], -1).when(a["salt"] > b["salt"], 1).otherwise(0)

    gathered = (placed.groupBy("shard", "bucket")
                .agg(F.collect_list(F.struct("salt", "size", "grown_shard", "row")).alias("items"))
                .withColumn("items", F.array_sort("items", by_salt)))
    # the local sort fixes the order in which buckets draw from the partition's generator
    mixed = (gathered.join(offsets, ["shard", "bucket"])
             .sortWithinPartitions("shard", "bucket")
             .select("shard", "bucket", "_offset", F.shuffle("items", F.lit(seed)).alias("items")))
    rows = mixed.select("shard", "bucket", "_offset", F.posexplode("items").alias("_pos", "_item"))
    return rows.select("_item.row.*", F.col("_item.size").alias("size"), "shard",
                       (F.col("_offset") + F.col("_pos")).cast("long").alias("slot"),
                       F.col("_item.grown_shard").alias("grown_shard"), "bucket")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; a bucket's rows stay together in their shuffled order."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
