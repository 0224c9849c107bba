"""Model directory and result sinks: parquet tables written by Spark writers.

Models are versioned. A writer takes a version number by creating the file
``<path>/_versions/<n>``, which only one of several writers can; then
``<path>/version=<n>/ngrams`` (k, ctx, w, c) and ``.../meta`` (one row: order, vocab_size,
lambdas, tag) are written, and last a row (version, tag, saved_at) is appended to
``<path>/pointer``. A reader follows the last pointer row of its tag, so a crash leaves the
previous version in place, and a number that was taken but never committed is just skipped. History and results are appended per run under
``run_id=``, so a crash loses at most the run in progress.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn.operators.ngram import NGramModel, context_totals

POINTER = "version long, tag string, saved_at timestamp"
META = "order int, vocab_size int, lambdas array<double>, tag string"


def _pointers(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(POINTER).parquet(f"{path}/pointer")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], POINTER)


def claim(spark: SparkSession, folder: str, first: int) -> int:
    """The smallest free number from ``first`` on, taken by creating ``<folder>/<number>``. The
    file system creates a file once, so no two writers get the same number."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    number = first
    while True:
        at = jvm.org.apache.hadoop.fs.Path(f"{folder}/{number}")
        fs = at.getFileSystem(conf)
        fs.mkdirs(at.getParent())
        if not fs.exists(at):
            try:
                # Hadoop's local file system looks and then creates, which two writers can both pass
                if fs.pathToFile(at).createNewFile() if fs.getScheme() == "file" else fs.createNewFile(at):
                    return number
            except Py4JJavaError:  # another writer was faster
                if not fs.exists(at):
                    raise
        number += 1


def save_model(model: NGramModel, path: str, tag: str = "best") -> int:
    """Write the next version and point to it; returns its number."""
    spark = model.ngrams.sparkSession
    last = _pointers(spark, path).agg(F.max("version")).first()[0]
    version = claim(spark, f"{path}/_versions", 1 if last is None else last + 1)
    at = f"{path}/version={version}"
    model.ngrams.write.mode("overwrite").parquet(f"{at}/ngrams")
    meta = spark.createDataFrame([(model.order, model.vocab_size, [float(x) for x in model.lambdas], tag)], META)
    meta.coalesce(1).write.mode("overwrite").parquet(f"{at}/meta")
    (spark.createDataFrame([(version, tag)], "version long, tag string")
     .withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/pointer"))
    return version


def load_model(spark: SparkSession, path: str, tag: str | None = None, version: int | None = None) -> NGramModel:
    """The version asked for, or the last one (of a tag)."""
    known = _pointers(spark, path)
    if tag is not None:
        known = known.filter(F.col("tag") == tag)
    if version is None:
        version = known.agg(F.max("version")).first()[0]
    if version is None:
        raise FileNotFoundError(f"no model{f' tagged {tag}' if tag else ''} below {path}")
    at = f"{path}/version={version}"
    meta = spark.read.schema(META).parquet(f"{at}/meta").first()
    ngr = spark.read.parquet(f"{at}/ngrams")
    return NGramModel(ngr, context_totals(ngr), int(meta["order"]), int(meta["vocab_size"]),
                      list(meta["lambdas"]))


def data_digest(df: DataFrame) -> str:
    """What a table holds, whatever the order of its rows: their number and a sum of hashes."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{row['n']}:{row['h']}"


def append_run(df: DataFrame, path: str, run_id: int) -> None:
    (df.withColumn("run_id", F.lit(int(run_id))).write.mode("append")
       .partitionBy("run_id").parquet(path))


def write_results_csv(df: DataFrame, path: str, order_col: str = "run_id") -> None:
    """Final single ordered CSV (the result table is one row per run: tiny)."""
    df.orderBy(order_col).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
