"""Subword merges learned from the corpus (byte-pair encoding over pre-split words).

A word is held as one string whose symbols stand between two delimiter characters (control
characters, which cleaned text does not hold), so applying a merge to a word is a single
built-in ``replace``, which works from left to right like the published algorithm. Learning
works on the table of distinct words x frequency: a job counts the adjacent pairs and brings
the first few hundred (count desc, then symbols asc) to the driver. Of these, the longest run
is applied at once that merging one by one is bound to choose too (`safe_batch`), so a job
makes several merges. Encoding applies the ranked merges to any word, seen or not, once for
each distinct word of a batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.functions.tokens import N_RESERVED, pretokenize
from lexicorn.operators.vocab import CHARACTER
from lexicorn.session import cut_lineage

OPEN, CLOSE = "\x02", "\x03"


def spell(word: Column) -> Column:
    """A word as delimited single characters."""
    return F.regexp_replace(word, CHARACTER, f"{OPEN}$0{CLOSE}")


def symbols(spelled: Column) -> Column:
    return F.regexp_extract_all(spelled, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))


def apply_merge(spelled: Column, a: str, b: str) -> Column:
    return F.replace(spelled, F.lit(f"{OPEN}{a}{CLOSE}{OPEN}{b}{CLOSE}"), F.lit(f"{OPEN}{a}{b}{CLOSE}"))


def word_table(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, freq, spelled) of the distinct pre-split words."""
    return (texts.select(F.explode(pretokenize(text_col)).alias("word"))
            .groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
            .withColumn("spelled", spell(F.col("word"))))


def _pairs(words: DataFrame) -> DataFrame:
    s = words.select("freq", symbols(F.col("spelled")).alias("s")).filter(F.size("s") > 1)
    pair = F.explode(F.arrays_zip(F.slice("s", F.lit(1), F.size("s") - 1).alias("a"),
                                  F.slice("s", F.lit(2), F.size("s") - 1).alias("b"))).alias("p")
    return (s.select("freq", pair).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
            .agg(F.sum("freq").alias("count")))


def merges_for(vocab_size: int, n_characters: int) -> int:
    """Merges that fill a vocabulary beside the reserved ids and the characters."""
    return max(0, vocab_size - N_RESERVED - n_characters)


def safe_batch(top: list[tuple[str, str, int]], made: set[str], whole: bool) -> int:
    """How many of the first pairs (by count desc, a, b) one-by-one merging would take in this
    order, without a count of what they create.

    Pairs without a common symbol leave each other's counts alone. A pair that a merge creates
    stands where an older pair with one of its symbols stood, so it is no more frequent than
    that one, which comes later in the list; only at equal counts could it come first, and then
    only if it begins with the new symbol and that sorts before. The batch ends before a common
    symbol, before such a tie, and where ties may lie beyond the list (unless it is ``whole``);
    it ends after a pair of one symbol with itself, and after one whose product exists already."""
    symbols_seen: set[str] = set()
    for i, (a, b, c) in enumerate(top):
        if i:
            if a in symbols_seen or b in symbols_seen or (c == top[-1][2] and not whole):
                return i
            product = {y: x + y for x, y, _ in top[:i]}
            if any(n == c and product.get(x, a) < a for x, _, n in top[i + 1:] if n == c):
                return i
        if a == b or a + b in made or any(x + y == a + b for x, y, _ in top[:i]):
            return i + 1 if not i else i
        symbols_seen |= {a, b}
    return len(top)


def learn_merges(texts: DataFrame, n_merges: int, text_col: str = "text", checkpoint_every: int = 24,
                 look_ahead: int = 512) -> tuple[DataFrame, DataFrame]:
    """(merges(rank, a, b, count), words(word, freq, spelled) after all merges)."""
    spark = texts.sparkSession
    words = cut_lineage(word_table(texts, text_col))
    merges: list[tuple[int, str, str, int]] = []
    made: set[str] = set()
    pending = 0
    while len(merges) < n_merges:
        top = [(r["a"], r["b"], int(r["count"])) for r in
               _pairs(words).orderBy(F.col("count").desc(), "a", "b").limit(look_ahead).collect()]
        if not top:
            break
        batch = top[:min(safe_batch(top, made, len(top) < look_ahead), n_merges - len(merges))]
        spelled = F.col("spelled")
        for a, b, c in batch:
            merges.append((len(merges) + 1, a, b, c))
            made.add(a + b)
            spelled = apply_merge(spelled, a, b)
        words, pending = words.withColumn("spelled", spelled), pending + len(batch)
        if pending >= checkpoint_every:
            words, pending = cut_lineage(words), 0
    return spark.createDataFrame(merges, "rank int, a string, b string, count long"), words


def subword_vocab(words: DataFrame, merges: DataFrame) -> DataFrame:
    """(symbol, id): after the reserved ids the corpus' characters in order of code points,
    then one symbol per merge in order of rank. Bounded by alphabet and merges."""
    from pyspark.sql import Window
    chars = words.select(F.explode(F.regexp_extract_all("word", F.lit(CHARACTER), F.lit(0))).alias("symbol")).distinct()
    every = (chars.select("symbol", F.lit(0).alias("rank"))
             .unionByName(merges.select(F.concat("a", "b").alias("symbol"), "rank"))
             .groupBy("symbol").agg(F.min("rank").alias("rank")))
    order = Window.orderBy("rank", "symbol")
    return every.select("symbol", (F.row_number().over(order) + N_RESERVED - 1).cast("int").alias("id"))


def split_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The word's symbols after all merges, applied in the order of their ranks."""
    parts, last = list(word), 0
    while True:
        rank = min((r for p in zip(parts, parts[1:]) if (r := ranks.get(p, 0)) > last), default=None)
        if rank is None:
            return parts
        out, i = [], 0
        while i < len(parts):
            both = i + 1 < len(parts) and ranks.get((parts[i], parts[i + 1])) == rank
            out.append(parts[i] + parts[i + 1] if both else parts[i])
            i += 1 + both
        parts, last = out, rank


def encode_words(texts: DataFrame, merges: DataFrame, text_col: str = "text",
                 out_col: str = "subwords") -> DataFrame:
    """``texts`` with the subwords of every row (an empty array for an empty or null text).

    Merges are as many as the caller asked for; they go to the tasks with the function."""
    ranks = {(r["a"], r["b"]): r["rank"] for r in merges.collect()}
    kept = [c for c in texts.columns if c != out_col]
    words = F.coalesce(pretokenize(text_col), F.array().cast("array<string>"))
    schema = T.StructType([*texts.select(*kept).schema.fields, T.StructField(out_col, T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(b.num_columns - 1)
            coded = lists.flatten().dictionary_encode()
            split = [split_word(w, ranks) for w in coded.dictionary.to_pylist()]
            which, at = coded.indices.to_pylist(), [o - lists.offsets[0].as_py() for o in lists.offsets.to_pylist()]
            out = [[s for k in which[x:y] for s in split[k]] for x, y in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.string()))],
                                             names=[*b.schema.names[:-1], out_col])
    return texts.select(*kept, words.alias("_words")).mapInArrow(run, schema)


def decode_words(subwords: Column) -> Column:
    """The text: symbols carry their blanks, so nothing is lost."""
    return F.array_join(subwords, "")
