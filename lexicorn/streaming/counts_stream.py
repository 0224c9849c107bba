"""N-gram counts of a stream of landing files, kept as tables that grow by micro-batch.

Layout of a counts folder: ``batch=<id>`` holds the counts of one micro-batch, ``base=<id>`` the
sum of all batches up to that one, ``_committed/batch=<id>`` and ``_committed/base=<id>`` are
empty files made when the table of that name is whole, and ``_checkpoint`` is the stream's own.

Each row is counted once. The stream's offset log fixes what a batch id holds, so after a crash
the same id brings the same rows: a batch that was committed is left as it is, one that was not
is written over. Readers see committed tables alone, the last base and the batches after it.
Batches at or below a base are no longer read; they are left for running readers.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn.operators import vocab as V
from lexicorn.operators.ngram import ngram_counts

KEYS = ["k", "ctx", "w"]
COUNTS = "k int, ctx array<int>, w int, c bigint"


def _committed(spark: SparkSession, folder: str, kind: str) -> list[int]:
    """Numbers of the committed tables of a kind: a listing of names, no data."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{folder}/_committed")
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))


def _commit(df: DataFrame, folder: str, kind: str, number: int) -> None:
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{folder}/{kind}={number}")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_committed/{kind}={number}")
    mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).createNewFile(mark)


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """(k, ctx, w, c) over everything committed so far: what one count of all rows gives."""
    bases = _committed(spark, folder, "base")
    base = bases[-1] if bases else -1
    parts = [f"{folder}/base={b}" for b in bases[-1:]]
    parts += [f"{folder}/batch={b}" for b in _committed(spark, folder, "batch") if b > base]
    if not parts:
        return spark.createDataFrame([], COUNTS)
    tables = [spark.read.schema(COUNTS).parquet(p) for p in parts]
    return reduce(DataFrame.unionByName, tables).groupBy(*KEYS).agg(F.sum("c").alias("c"))


def add_batch(batch: DataFrame, batch_id: int, folder: str,
              count: Callable[[DataFrame], DataFrame], compact_every: int = 16) -> None:
    """Count one micro-batch unless its id is committed; every ``compact_every`` batches sum
    them into a new base, so a reader never opens more than that many tables."""
    spark = batch.sparkSession
    if batch_id not in _committed(spark, folder, "batch"):
        _commit(count(batch).select(*KEYS, "c"), folder, "batch", batch_id)
    bases = _committed(spark, folder, "base")
    if batch_id - (bases[-1] if bases else -1) >= compact_every:
        _commit(counts(spark, folder), folder, "base", batch_id)


def text_counter(vocab: DataFrame, order: int, append_eos: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Counts of a batch of (row_id, text), text cleaned, by a vocabulary fixed for the stream."""
    def count(batch: DataFrame) -> DataFrame:
        return ngram_counts(V.encode(batch.select("row_id", "text"), vocab, append_eos=append_eos), order)
    return count


def start_counts(stream: DataFrame, folder: str, count: Callable[[DataFrame], DataFrame],
                 compact_every: int = 16, once: bool = True):
    """Start counting a stream into ``folder``, where it also goes on after a restart."""
    q = (stream.writeStream.option("checkpointLocation", f"{folder}/_checkpoint")
         .foreachBatch(lambda batch, number: add_batch(batch, number, folder, count, compact_every)))
    return (q.trigger(availableNow=True) if once else q).start()
