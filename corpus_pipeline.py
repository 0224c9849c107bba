"""Corpus pipeline over ``documents``: the stages in order, each written and read again.

Quality classifier (rejected documents go), SimHash near-dedup (one document of each group
stays), benchmark decontamination (documents with a benchmark passage go), byte-level BPE
encoding (the last stage returns ids in place of texts)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn.llm import bpe_codec, cotraining, decontaminate, simhash
from lexicorn.llm.common import materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cotraining.score_documents(docs, labels).filter("keep").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: 3-word shingles, 3 bits."""
    return simhash.keep_one(docs, k=3, radius=3)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return (bpe_codec.encode(docs.select("doc_id", "lang", "source", "text"), ranks, decoded=True)
            .select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                    F.sha2("ids_packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))


STAGES = [("quality classifier", keep_good), ("simhash near-dedup", drop_near_copies),
          ("benchmark decontamination", drop_leaks), ("byte-level bpe", encode)]

#: no stage can be put into SQL: a fitted model, XXH64 and BPE have no counterpart there
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
