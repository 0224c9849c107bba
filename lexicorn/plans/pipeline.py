"""Shared lineage: clean -> split -> vocabulary -> encode, parameterised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexicorn import sources as src
from lexicorn.functions.text import clean_text
from lexicorn.operators import splits, vocab as V
from lexicorn.session import cut_lineage


@dataclass(frozen=True)
class Config:
    seed: int = 42
    train: float = 0.8
    val: float = 0.1
    test: float = 0.1
    vocab_size: int = 8192
    max_length: int | None = None  # whole texts; a number truncates
    append_eos: bool = True
    order: int = 3
    min_count: int = 1
    fraction: float = 0.5


DEFAULT = Config()


def spread(texts: DataFrame) -> DataFrame:
    """Raw texts dealt evenly to as many tasks as a shuffle has. Cleaning, splitting into words and
    encoding cost far more than that shuffle, and a file with one row group is read by one task."""
    return texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def split_corpus(spark: SparkSession, sf: str, cfg: Config = DEFAULT) -> DataFrame:
    """(row_id, text, split) over cleaned conversations."""
    c = spread(src.conversations(spark, sf)).select("row_id", clean_text("text").alias("text"))
    return splits.hash_split(c, cfg.train, cfg.val, cfg.test, cfg.seed)


def clean_docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(src.documents(spark, sf)).select("row_id", clean_text("text").alias("text"))


def corpus_vocab(spark: SparkSession, sf: str, cfg: Config = DEFAULT, corpus: DataFrame | None = None,
                 docs: DataFrame | None = None) -> DataFrame:
    """One vocabulary for both models: in-domain train rows plus the documents. It has at
    most ``vocab_size`` rows and is written once, so no reader learns it again. ``corpus`` and ``docs``
    are the cleaned texts, if they are written already (also below)."""
    corpus = split_corpus(spark, sf, cfg) if corpus is None else corpus
    docs = clean_docs(spark, sf) if docs is None else docs
    train_text = corpus.filter(F.col("split") == "train").select("text")
    return cut_lineage(V.learn_vocab(train_text.unionByName(docs.select("text")), cfg.vocab_size))


def encoded_corpus(spark: SparkSession, sf: str, cfg: Config = DEFAULT,
                   vocab: DataFrame | None = None, corpus: DataFrame | None = None) -> DataFrame:
    """(row_id, split, ids): whole texts by default, with an EOS after each; an EOS is added
    only where the text really ends."""
    voc = vocab if vocab is not None else corpus_vocab(spark, sf, cfg)
    return V.encode(split_corpus(spark, sf, cfg) if corpus is None else corpus, voc, max_length=cfg.max_length,
                    append_eos=cfg.append_eos)


def encoded_docs(spark: SparkSession, sf: str, cfg: Config = DEFAULT,
                 vocab: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    voc = vocab if vocab is not None else corpus_vocab(spark, sf, cfg)
    return V.encode(clean_docs(spark, sf) if docs is None else docs, voc, max_length=cfg.max_length,
                    append_eos=cfg.append_eos)
