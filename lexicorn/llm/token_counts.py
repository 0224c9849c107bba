"""Operator 10: token counts through a digest cache.

The cache is a Parquet table (content_digest, tokenizer_digest, n_tokens) in the shared
folder. A text is normalised as the tokenizer's own normaliser does (the identity if it has
none), digested, and joined to the stored counts of the same tokenizer version (digest of
the tokenizer file, the library's version and the option used). Only distinct misses are
encoded, and their counts are appended to the cache, whose files are committed whole.

Copies are folded twice: inside each task before the shuffle, so a text that fills a third
of the table sends one row per task, and again per digest after it. Texts travel zlib
compressed, which keeps the shuffle below the size of the input.

Defined cases: null text = empty text; null ids and repeated rows are kept; an empty table
gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn.llm.common import materialize, without

CACHE_DDL = "content_digest binary, tokenizer_digest binary, n_tokens long"
_MISS = pa.schema([("content_digest", pa.binary()), ("packed", pa.binary())])
_COUNT = pa.schema([("content_digest", pa.binary()), ("n_tokens", pa.int64())])
_TOKENIZERS: dict[str, object] = {}
#: Spark runs as many tasks as there are cores; threads of the library's own only get in the way
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def load_tokenizer(path: str):
    """The library's tokenizer of a ``.json`` (tokenizers) or ``.model`` (sentencepiece) file."""
    if path not in _TOKENIZERS:
        if path.endswith(".model"):
            import sentencepiece
            _TOKENIZERS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer
            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _TOKENIZERS[path] = t
    return _TOKENIZERS[path]


def _counts(path: str, texts: list[str]) -> list[int]:
    t = load_tokenizer(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)]
    return [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> bytes:
    """Version of the tokenizer: its file and the library that reads it."""
    import importlib.metadata as meta
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        h = hashlib.sha256(f.read())
    h.update(f"\n{library} {meta.version(library)} no-special".encode())
    return h.digest()


def _normaliser(path: str):
    """The text's normal form; equal forms have equal counts."""
    if path.endswith(".model"):
        return load_tokenizer(path).normalize
    n = load_tokenizer(path).normalizer
    return n.normalize_str if n is not None else (lambda s: s)


def _local_misses(path: str):
    """Per task: digest the normal forms, and pack one text of each (as it is: the tokenizer
    normalises again). The set of digests is bounded by the rows of the task's input split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        normalise = _normaliser(path)
        for b in batches:
            digests, packed, size = [], [], 0
            for x in b.column(0):
                text = x.as_py()
                d = hashlib.sha256(normalise(text).encode()).digest()
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    packed.append(zlib.compress(text.encode(), 1))
                    size += len(packed[-1])
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], schema=_MISS)
                    digests, packed, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], schema=_MISS)
    return run


def _encode(path: str, chunk_bytes: int = 1 << 18):
    """Per task after the shuffle by digest: each distinct text is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            digests, texts, size = [], [], 0

            def flush() -> pa.RecordBatch:
                n = _counts(path, texts)
                return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(n, pa.int64())], schema=_COUNT)
            for d, p in zip(b.column(0).to_pylist(), b.column(1)):
                if d in seen:
                    continue
                seen.add(d)
                texts.append(zlib.decompress(p.as_py()).decode())
                digests.append(d)
                size += len(texts[-1])
                if size > chunk_bytes:
                    yield flush()
                    digests, texts, size = [], [], 0
            yield flush()
    return run


def _digests(path: str):
    """Digest of the normalised text, as a pandas UDF."""
    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        normalise = _normaliser(path)
        return texts.map(lambda t: hashlib.sha256(normalise(t).encode()).digest())
    return digest


def read_cache(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    """Stored counts of one tokenizer version, one row per digest (two runs may have appended
    the same one)."""
    stored = spark.read.schema(CACHE_DDL).parquet(cache)
    return (stored.filter(F.col("tokenizer_digest") == F.lit(version))
            .groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")))


def open_cache(spark: SparkSession, cache: str) -> str:
    """Create the cache table if the path holds none."""
    spark.createDataFrame([], CACHE_DDL).write.mode("append").parquet(cache)
    return cache


def count_tokens(df: DataFrame, cache: str, tokenizer: str, text: str = "text",
                 limit: int = 1024) -> DataFrame:
    """``df`` with ``n_bytes, n_tokens, over_limit``; missing counts are appended to ``cache``."""
    spark = df.sparkSession
    version = tokenizer_digest(tokenizer)
    open_cache(spark, cache)
    whole = F.coalesce(df[text], F.lit(""))
    identity = tokenizer.endswith(".json") and load_tokenizer(tokenizer).normalizer is None
    digest = F.unhex(F.sha2(whole.cast("binary"), 256)) if identity else _digests(tokenizer)(whole)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = (df.select(whole.alias("t")).mapInArrow(_local_misses(tokenizer), "content_digest binary, packed binary")
              .repartition(parts, "content_digest"))
    stored = read_cache(spark, cache, version).select("content_digest").hint("shuffle_hash")
    misses = packed.join(stored, "content_digest", "left_anti")
    (misses.mapInArrow(_encode(tokenizer), "content_digest binary, n_tokens long")
     .select("content_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens")
     .write.mode("append").parquet(cache))

    out = ["n_bytes", "n_tokens", "over_limit"]
    kept = without(df, out)
    rows = kept.select("*", F.octet_length(F.coalesce(kept[text], F.lit(""))).cast("long").alias("n_bytes"),
                       digest.alias("__digest"))
    # written first, so that the digest of many copies is a plain skewed join
    counts = materialize(read_cache(spark, cache, version), "token-counts").withColumnRenamed(
        "content_digest", "__digest")
    return (rows.join(counts, "__digest", "left").drop("__digest")
            .withColumn("over_limit", F.col("n_tokens") > limit))
