"""Vocabulary learned from the corpus (characters and frequent words), encode and decode.

The vocabulary is capped at ``vocab_size`` entries: ids 0..2 are reserved, 3..258 are the byte
values, and the learned tokens follow. A word without an id is spelled in its characters, a
character without one in its UTF-8 bytes, so every text has ids and comes back from them. The
vocabulary's rows go to the tasks after a check of their number, and encoding is a lookup
inside each row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.functions.tokens import (
    EOS_ID, EOS_TOKEN, FIRST_LEARNED, N_BYTES, N_RESERVED, PAD_ID, PAD_TOKEN, UNK_ID, UNK_TOKEN, pretokenize)
from lexicorn.session import write_once

DICTIONARY_MAX = 1_000_000
#: bytes of text that a task encodes or decodes at a time; its arrays take some tens of bytes for each
PIECE = 1 << 21
#: what a run of byte ids decodes to that is no UTF-8 (a sampled or cut one)
BROKEN = "\ufffd"


#: a whole code point, line breaks included (valid in Java and RE2)
CHARACTER = "(?s)."


def learn_vocab(texts: DataFrame, vocab_size: int = 8192, text_col: str = "text") -> DataFrame:
    """(token, id, count): specials 0..2 and bytes 3..258 (count 0), then the corpus' characters
    (at most half of the ids; the bytes spell the rest), then its most frequent longer words;
    each part by count desc, token asc."""
    if vocab_size <= FIRST_LEARNED:
        raise ValueError(f"vocab_size must exceed the {FIRST_LEARNED} reserved ids and bytes")
    # written once: characters and words are both taken from it, and the corpus is split once
    counts = write_once(texts.select(F.explode(pretokenize(text_col)).alias("token"))
                        .groupBy("token").agg(F.count(F.lit(1)).alias("count")))
    characters = (counts.select(F.explode(F.regexp_extract_all("token", F.lit(CHARACTER), F.lit(0))).alias("token"),
                                "count")
                  .groupBy("token").agg(F.sum("count").alias("count"))
                  .orderBy(F.col("count").desc(), "token").limit(vocab_size // 2))
    by = ["part", F.col("count").desc(), "token"]
    top = (characters.select(F.lit(0).alias("part"), "token", "count")
           .unionByName(counts.filter(F.char_length("token") > 1).select(F.lit(1).alias("part"), "token", "count"))
           .orderBy(*by).limit(vocab_size - FIRST_LEARNED))
    # numbering touches only the capped top rows (bounded by vocab_size)
    ranked = top.withColumn("id", (F.row_number().over(Window.orderBy(*by)) + F.lit(FIRST_LEARNED - 1)).cast("int"))
    spark = texts.sparkSession
    specials = spark.createDataFrame(
        [(PAD_TOKEN, PAD_ID, 0), (EOS_TOKEN, EOS_ID, 0), (UNK_TOKEN, UNK_ID, 0),
         *[(f"<0x{k:02X}>", N_RESERVED + k, 0) for k in range(N_BYTES)]],
        T.StructType([T.StructField("token", T.StringType()), T.StructField("id", T.IntegerType()),
                      T.StructField("count", T.LongType())]))
    return specials.unionByName(ranked.select("token", "id", "count"))


def eos_id(vocab: DataFrame) -> DataFrame:
    """One-row (eos_id): EOS, else a SEP token, else an error (raised by the query)."""
    eos = F.max(F.when(F.col("token") == EOS_TOKEN, F.col("id")))
    sep = F.max(F.when(F.col("token") == "<sep>", F.col("id")))
    found = F.coalesce(eos, sep)
    return vocab.agg(F.when(found.isNull(), F.raise_error(F.lit("vocabulary has neither eos nor sep")))
                     .otherwise(found).cast("int").alias("eos_id"))


def _dictionary(vocab: DataFrame) -> list[tuple[str, int]]:
    """The learned rows, after a check of their number; tasks get them with the function."""
    rows = (vocab.filter(F.col("id") >= FIRST_LEARNED).select("token", "id")
            .limit(DICTIONARY_MAX + 1).collect())
    if len(rows) > DICTIONARY_MAX:
        raise ValueError(f"a vocabulary of more than {DICTIONARY_MAX} tokens does not fit a task")
    return [(r["token"], r["id"]) for r in rows]


def _pieces(size: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """(first row, rows) of consecutive parts of a batch of lists, each up to ``limit`` in the
    sum of its elements' sizes, or a single row. What a task holds besides the batch then does
    not grow with the rows of the batch."""
    before = np.append(0, np.cumsum(size))[offsets]
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(int(np.searchsorted(before, before[row] + limit, "right")) - 1, row + 1)
        yield row, end - row
        row = end


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()


def encode(df: DataFrame, vocab: DataFrame, text_col: str = "text", out_col: str = "ids",
           max_length: int | None = None, append_eos: bool = False,
           keep_text: bool = False) -> DataFrame:
    """``df`` with ``ids``: pre-split in the JVM, then a vectorised lookup row by row, so rows
    are neither shuffled nor merged, whatever their ids. A word without an id becomes its
    characters, a character without one its bytes. Null text = no ids."""
    kept = df.columns if keep_text else [c for c in df.columns if c != text_col]
    rows = df.select(*kept, F.coalesce(pretokenize(text_col), F.array().cast("array<string>")).alias("_tokens"))
    ids = dict(_dictionary(vocab))
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out_col, T.ArrayType(T.IntegerType()))])

    def of_character(c: str) -> list[int]:
        return [ids[c]] if c in ids else [N_RESERVED + x for x in c.encode()]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(b.num_columns - 1)
            size = pc.binary_length(tokens.flatten()).to_numpy(zero_copy_only=False)
            for at, n in _pieces(size, _offsets(tokens), PIECE):
                yield b.slice(at, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            tokens = b.column(b.num_columns - 1)
            coded = tokens.flatten().dictionary_encode()
            spelled = [[ids[t]] if t in ids else [i for c in t for i in of_character(c)]
                       for t in coded.dictionary.to_pylist()]
            size = np.array([len(x) for x in spelled], np.int64)
            flat = np.array([i for x in spelled for i in x], np.int32)
            which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            out, ends = _gather(flat, np.cumsum(size) - size, size, which)
            bounds = np.append(0, ends)[_offsets(tokens)]
            column = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], column], names=[*b.schema.names[:-1], out_col])

    out = rows.mapInArrow(run, schema)
    if max_length is not None:
        whole = F.size(out_col) <= int(max_length)
        out = out.withColumn("_whole", whole).withColumn(out_col, F.slice(out_col, 1, int(max_length)))
    if append_eos:  # a text that was cut has no end here
        ended = F.concat(out_col, F.array(F.lit(EOS_ID)))
        out = out.withColumn(out_col, ended if max_length is None
                             else F.when(F.col("_whole"), ended).otherwise(F.col(out_col)))
    return out.drop("_whole") if max_length is not None else out


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``which`` of ``flat``; also where each of them ends."""
    n = size[which]
    ends = np.cumsum(n)
    place = np.repeat(start[which] - (ends - n), n) + np.arange(n.sum())
    return flat[place], ends


def decode(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Ids -> text row by row, skipping the reserved ids (pad, eos, unk); tokens carry their
    spaces. Neighbouring byte ids are joined; a run of them that is no UTF-8 becomes U+FFFD."""
    kept = [c for c in df.columns if c != out_col]
    known = {i: t.encode() for t, i in _dictionary(vocab)}
    spelling = [known.get(i, b"") for i in range(max(known, default=0) + 1)]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out_col, T.StringType())])

    def is_byte(i: int) -> bool:
        return N_RESERVED <= i < FIRST_LEARNED

    def joined(ids: list[int]) -> str:
        out = []
        for byte_run, run in itertools.groupby((i for i in ids if i >= N_RESERVED), is_byte):
            if byte_run:
                try:
                    out.append(bytes(i - N_RESERVED for i in run).decode())
                except UnicodeDecodeError:
                    out.append(BROKEN)
            else:
                out += [spelling[i].decode() for i in run if i < len(spelling)]
        return "".join(out)

    size = np.array([len(t) for t in spelling] + [0], np.int64)

    def places(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return flat, np.where((flat >= 0) & (flat < len(spelling)), flat, len(spelling))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            # an id counts for its text and for its place
            for at, n in _pieces(size[places(lists)[1]] + 1, _offsets(lists), PIECE):
                yield b.slice(at, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(b"".join(spelling), np.uint8)
        for b in parts(batches):
            lists = b.column(b.num_columns - 1)
            flat, which = places(lists)
            out, ends = _gather(table, np.cumsum(size) - size, size, which)
            at = _offsets(lists)
            bounds = np.append(0, ends)[at]
            odd = np.unique(np.searchsorted(at, np.flatnonzero((flat >= N_RESERVED) & (flat < FIRST_LEARNED)), "right") - 1)
            if len(odd):  # rows with byte ids are rare
                said = [out[x:y].tobytes().decode() for x, y in zip(bounds[:-1], bounds[1:])]
                for r in odd.tolist():
                    said[r] = joined(flat[at[r]:at[r + 1]].tolist())
                column = pa.array(said, pa.string())
            else:
                column = pa.StringArray.from_buffers(len(lists), pa.py_buffer(bounds.astype(np.int32)),
                                                     pa.py_buffer(np.ascontiguousarray(out)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], column], names=[*b.schema.names[:-1], out_col])
    return df.select(*kept, F.col(ids_col)).mapInArrow(run, schema)
