"""The cleaner on Structured Streaming: the same Column expression, no state.

New corpus files landing in a directory are cleaned and appended to a parquet sink;
the checkpoint location makes the query restartable after failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.functions.text import clean_text
from lexicorn.sources.corpus import turn_key

CORPUS_SCHEMA = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def cleaned_stream(spark: SparkSession, source_dir: str,
                   schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    raw = spark.readStream.schema(schema).parquet(source_dir)
    return raw.select(turn_key().alias("row_id"),
                      clean_text(F.nullif(F.col("text"), F.lit("NO_QUERY"))).alias("text"))


def start_clean_sink(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                     once: bool = True):
    q = (cleaned_stream(spark, source_dir).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
         .outputMode("append"))
    q = q.trigger(availableNow=True) if once else q
    return q.start()
