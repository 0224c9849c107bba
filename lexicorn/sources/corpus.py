"""Corpus sources: parquet adapters over the given tables and the headerless CSV scan.

Every adapter returns ``(row_id BIGINT, text STRING)``; only the needed columns are
selected so Catalyst prunes the parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The raw corpus layout (no header, all strings) and its null marker.
RAW_COLUMNS = ["target", "ids", "date", "flag", "user", "text"]
NULL_MARKER = "NO_QUERY"
RAW_ENCODING = "ISO-8859-1"

# The decoration appended to fixture rows so every cleaning step fires.
DECOR_URL = " http://ex.org/a?b=1 @user"
DECOR_TAG = " #Tag_"
DECOR_TAIL = " $5 www.site.com \U0001F600"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TURN_BITS = 20


def turn_key(conv: str = "conv_id", turn: str = "turn"):
    """One id for (conversation, turn) without collisions: the turn in the low 20 bits.

    A turn outside 0..2**20-1 is an error rather than a shared id; a null part gives null."""
    t = F.col(turn)
    return (F.when(F.col(conv).isNull() | t.isNull(), F.lit(None).cast("bigint"))
            .when(t.between(0, (1 << TURN_BITS) - 1), F.col(conv) * (1 << TURN_BITS) + t)
            .otherwise(F.raise_error(F.lit("turn does not fit its 20 bits")).cast("bigint")))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-domain short texts; ``row_id`` is the :func:`turn_key`."""
    return (table(spark, sf_dir, "conversations")
            .select(turn_key().alias("row_id"),
                    F.nullif(F.col("text"), F.lit(NULL_MARKER)).alias("text")))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-domain long texts, whole."""
    return (table(spark, sf_dir, "documents")
            .select(F.col("doc_id").alias("row_id"),
                    F.nullif(F.col("text"), F.lit(NULL_MARKER)).alias("text")))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "benchmark")
            .select(F.col("item_id").alias("row_id"), F.col("text")))


def decorated(df: DataFrame) -> DataFrame:
    """Append a URL, a mention, a hashtag, symbols and an emoji to every row."""
    rid = F.col("row_id").cast("string")
    return df.withColumn(
        "text",
        F.concat(F.col("text"), F.lit(DECOR_URL), rid, F.lit(DECOR_TAG), rid, F.lit(DECOR_TAIL)))


def first_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in file order (``row_id``): a deterministic top-k."""
    return df.orderBy("row_id").limit(n)


RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])


def csv_corpus(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Headerless latin-1 CSV of six string fields; keeps rows of any field count.

    PERMISSIVE keeps short rows (missing fields are null) and long rows (extra
    fields ignored), like the skip-free pandas behaviour. ``multiline=True`` allows
    quoted newlines but makes each file one split, so it is off by default.
    ``row_id`` is the ``ids`` field where it is an integer and otherwise a hash of the
    whole row: either stays with its row however the files are laid out.
    """
    raw = (spark.read.schema(RAW_SCHEMA)
           .option("header", "false")
           .option("encoding", RAW_ENCODING)
           .option("quote", '"')
           .option("escape", '"')
           .option("multiLine", str(multiline).lower())
           .option("mode", "PERMISSIVE")
           .option("nullValue", "\u0000never\u0000")
           .option("emptyValue", "")
           .csv(path))
    given = F.expr("try_cast(ids AS BIGINT)")
    return raw.select(F.coalesce(given, F.xxhash64(*RAW_COLUMNS)).alias("row_id"),
                      F.nullif(F.col("text"), F.lit(NULL_MARKER)).alias("text"))
