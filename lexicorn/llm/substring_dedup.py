"""Operator 11: removal of long word sequences that occur more than once.

Every window of ``width`` words is an edge of a de Bruijn graph whose nodes are the runs of
``width - 1`` words; a word goes if a window that covers it starts anywhere else too.

Edges are never shuffled one by one. The anchor of a window is the smallest hash among its
runs of ``anchor`` words (the first of equal ones), which depends on the window's words alone,
and consecutive windows of a document with one anchor form a *stretch*, a path of the graph
that is compact from the start. A stretch travels as five longs, about one for every fourteen
words. Only stretches whose anchor occurs more than once can hold a repeated edge; they are
counted by (anchor, digest), map-side first.

* A stretch that occurs twice or more repeats as a whole. Where every occurrence goes on with
  the same next stretch, and that one occurs no more often, the node between them does not
  branch: a join on the representatives' source coordinates finds such pairs, and chains of
  them compact into one path. Occurrences of a path's first stretch then stand for all of it,
  so a copied document comes back as one span, not as one row an edge.
* A stretch that occurs once beside others of its anchor may share some edges with them (the
  rim of a passage). Its windows, and those of one representative of each other stretch of the
  anchor, are verified at their source coordinates: the words there are read again and
  digested (128 bits), and digests that occur twice are repeated edges.

Text moves twice: once to meet spans and rims, once more for documents with rims. A
document's coordinates are grouped by document, so a group is bounded by a text; no group of
copies, anchor or passage is ever collected.

A row is known by 80 bits of (key, text), so no row number must survive a lost executor, and
rows equal in both share their result. Stretches with equal anchors are equal if 64 bits of
digest are.

Defined cases: null text = no words, like an empty text; fewer words than ``width`` = nothing
to remove; repeated rows repeat each other; null and repeated keys are kept; an empty table
gives an empty result; input columns named like an output column are replaced, all others are
returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.llm.common import materialize, without

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: words that are hashed at a time
CHUNK = 1 << 18
#: odd multipliers of the two rolling digests, and their inverses modulo 2**64
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
INVERSES = tuple(pow(f, -1, 1 << 64) for f in FACTORS)
OUT = ["n_words", "n_removed", "spans", "kept"]
SPAN, ALONE, SHARED = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode())


# ------------------------------------------------------------------ stretches

def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits over the word (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Rolling:
    """Digest of any run of words in constant time, from prefix sums modulo 2**64."""

    def __init__(self, hashes: np.ndarray, which: int) -> None:
        n = len(hashes)
        powers = np.full(n + 1, FACTORS[which], np.uint64)
        powers[:1] = 1
        inverse = np.full(n + 1, INVERSES[which], np.uint64)
        inverse[:1] = 1
        self.inverse = np.cumprod(inverse)
        self.sums = np.append(np.uint64(0), np.cumsum(hashes * np.cumprod(powers)[:n]))

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start])


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of the first least one."""
    at, span = np.arange(len(values)), 1

    def first(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[a] <= values[b], a, b)
    while span * 2 <= width:
        at, span = first(at[:-span], at[span:]), span * 2
    return first(at[:len(at) - (width - span)], at[width - span:]) if span < width else at


def stretches(hashes: np.ndarray, ends: np.ndarray, width: int, anchor: int) -> dict[str, np.ndarray]:
    """Stretches of consecutive texts, given the word hashes and where each text ends: text
    number, first window, number of windows, anchor hash, digest, digest of the next (0: none)."""
    n = len(hashes)
    starts = np.append(0, ends[:-1]) if len(ends) else ends
    of_text = np.repeat(np.arange(len(ends)), ends - starts)
    if n < width:
        none = np.zeros(0, np.int64)
        return {k: none for k in ("text", "start", "n", "anchor", "digest", "next")}
    run, whole = _Rolling(hashes, 0), _Rolling(hashes, 1)
    least = run(np.arange(n - anchor + 1), anchor)
    window = np.flatnonzero(np.arange(n - width + 1) + width <= ends[of_text[:n - width + 1]])
    place = _first_least(least, width - anchor + 1)[window]
    first = np.flatnonzero(np.append(True, (np.diff(window) != 1) | (np.diff(place) != 0))[:len(window)])
    count = np.diff(np.append(first, len(window)))
    at = window[first]
    digest = whole(at, count + width - 1)
    follows = np.append(at[:-1] + count[:-1] == at[1:], False)[:len(at)]
    after = np.where(follows, np.append(digest[1:], np.uint64(0))[:len(at)], np.uint64(0))
    return {"text": of_text[at], "start": at - starts[of_text[at]], "n": count, "anchor": least[place[first]],
            "digest": digest, "next": after}


def _stretch_rows(width: int, anchor: int):
    """(id, tag, text) to rows of stretches; ``at`` holds tag, first window and windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        def made(ids: list[int], tags: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
            s = stretches(np.concatenate(hashes), np.cumsum([len(h) for h in hashes]), width, anchor)
            at = (np.array(tags, np.int64)[s["text"]] << 48) | (s["start"].astype(np.int64) << 6) | s["n"]
            return pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (s["anchor"].view(np.int64), s["digest"].view(np.int64),
                                       np.array(ids, np.int64)[s["text"]], at, s["next"].view(np.int64))],
                names=["anchor", "digest", "id", "at", "next"])
        for b in batches:
            ids, tags, hashes, held = [], [], [], 0
            for k in range(b.num_rows):
                words = words_of(b.column(2)[k].as_py())
                if len(words) < width:
                    continue
                ids.append(b.column(0)[k].as_py())
                tags.append(b.column(1)[k].as_py())
                hashes.append(np.fromiter(map(digest, words), np.uint64, len(words)))
                held += len(words)
                if held >= CHUNK:
                    yield made(ids, tags, hashes)
                    ids, tags, hashes, held = [], [], [], 0
            if ids:
                yield made(ids, tags, hashes)
    return run


# ------------------------------------------------------------------ graph

def _start(at: str) -> F.Column:
    return F.shiftright(F.col(at), 6).bitwiseAND(F.lit((1 << 42) - 1))


def _windows(at: str) -> F.Column:
    return F.col(at).bitwiseAND(F.lit(63))


def _tag(at: str) -> F.Column:
    return F.shiftright(F.col(at), 48).bitwiseAND(F.lit(0xFFFF)).cast("int")


def paths(repeated: DataFrame) -> DataFrame:
    """Nonbranching paths of repeated stretches: (anchor, digest) of the first and ``windows``.

    ``repeated``: (anchor, digest, c, id, at of the first occurrence, least and greatest next).
    If all occurrences of x go on with y, and y occurs as often, then the first occurrence of y
    follows that of x; so pairs meet by coordinates and chains lie within one text."""
    x = repeated.select("id", F.shiftright("at", 48).alias("tag"), _start("at").alias("start"), _windows("at").alias("n"),
                        "anchor", "digest", "c", F.when(F.col("least") == F.col("most"), F.col("least")).alias("next"))
    before = x.select("id", "tag", (F.col("start") + F.col("n")).alias("start"), F.col("next").alias("digest"), "c",
                      F.lit(True).alias("follows"))
    linked = x.join(before, ["id", "tag", "start", "digest", "c"], "left")
    along = Window.partitionBy("id", "tag").orderBy("start")
    chain = F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(along.rowsBetween(Window.unboundedPreceding, 0))
    return (linked.withColumn("chain", chain).groupBy("id", "tag", "chain")
            .agg(F.min(F.struct("start", "anchor", "digest")).alias("head"), F.sum("n").alias("windows"))
            .select("head.anchor", "head.digest", "windows"))


def _places(stretch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From stretches with repeated anchors: rows (id, tag, start, n, kind) of whole spans and
    of rims to verify."""
    counted = materialize(
        stretch.groupBy("anchor", "digest")
        .agg(F.count("*").alias("c"), F.min(F.struct("id", "at")).alias("first"), F.min("next").alias("least"),
             F.max("next").alias("most"))
        .select("anchor", "digest", "c", "first.id", "first.at", "least", "most"), "repeats-counted")
    whole = stretch.join(paths(counted.filter("c > 1")), ["anchor", "digest"])
    spans = whole.select("id", _tag("at").alias("tag"), _start("at").alias("start"), F.col("windows").alias("n"),
                         F.lit(SPAN).alias("kind"))
    several = materialize(counted.groupBy("anchor").count().filter("count > 1").select("anchor"), "repeats-several")
    rims = counted.join(several, "anchor", "left_semi").select(
        "id", _tag("at").alias("tag"), _start("at").alias("start"), _windows("at").alias("n"),
        F.when(F.col("c") > 1, SHARED).otherwise(ALONE).alias("kind"))
    return spans, rims


# ------------------------------------------------------------------ texts

def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open ranges, in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _without_spans(words: list[bytes], spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept += words[at:a]
        at = b
    return b" ".join(kept + words[at:]).decode()


_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))),
    T.StructField("kept", T.StringType())])
_CLAIMS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("weight", T.IntegerType()),
                                    T.StructField("high", T.LongType()), T.StructField("low", T.LongType())]))


def _window_digest(words: list[bytes]) -> tuple[int, int]:
    d = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _met(width: int, schema: T.StructType):
    """(row, id, tag, text, places) to results; a text with rims of its own stays open: ``kept``
    is then still the whole text, and its windows' digests are claims."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa_schema(schema)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows: list[tuple] = []
                for text, places in zip(part.column(3), part.column(4)):
                    text, places = text.as_py(), places.as_py() or []
                    words = words_of(text)
                    spans = merged([(p["start"], p["start"] + p["n"] + width - 1) for p in places if p["kind"] == SPAN])
                    claims = [(i, p["kind"], *_window_digest(words[i:i + width]))
                              for p in places if p["kind"] != SPAN for i in range(p["start"], p["start"] + p["n"])]
                    is_open = any(p["kind"] == ALONE for p in places)
                    rows.append((len(words), sum(y - x for x, y in spans), spans,
                                 text if is_open else _without_spans(words, spans), is_open, claims))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[_column(c, t) for c, t in zip(columns, types.types[3:])]], schema=types)
    return run


def _closed(width: int, schema: T.StructType):
    """(row, n_words, spans, kept, found) to results, with the windows that were verified."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa_schema(schema)
        for b in batches:
            rows: list[tuple] = []
            for spans, text, found in zip(*(b.column(k).to_pylist() for k in (2, 3, 4))):
                spans = merged([(s["start"], s["stop"]) for s in spans] + [(i, i + width) for i in found or []])
                rows.append((sum(y - x for x, y in spans), spans, _without_spans(words_of(text), spans)))
            columns = [_column(c, t) for c, t in zip(zip(*rows), types.types[2:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], schema=types)
    return run


def pa_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    if pa.types.is_list(kind):  # tuples to structs
        names = [f.name for f in kind.value_type]
        values = [[dict(zip(names, v)) for v in row] for row in values]
    return pa.array(values, kind)


# ------------------------------------------------------------------ operator

def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35, anchor: int = 8) -> DataFrame:
    """``df`` without its text, with ``n_words``, ``n_removed``, ``spans`` (the word ranges
    removed, from 0, end excluded) and ``kept``, the other words joined by one blank."""
    if not 1 <= anchor <= width or width - anchor > 62:
        raise ValueError("anchor must have 1 to width words, and at most 62 fewer than width")
    names = [c for c in without(df, OUT).columns if c.lower() != text.lower()]
    same = F.xxhash64(F.lit(1), F.col(key), F.coalesce(F.col(text), F.lit("")))
    rows = df.select(F.struct(*names).alias("row"), F.xxhash64(F.col(key), F.col(text)).alias("id"),
                     same.bitwiseAND(F.lit(0xFFFF)).cast("int").alias("tag"), F.col(text).alias("text"))
    every = rows.select("id", "tag", "text").mapInArrow(
        _stretch_rows(width, anchor), "anchor long, digest long, id long, at long, next long")
    # written before it is joined: a hot anchor is then a plain skewed join, which is split
    often = materialize(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "repeats-anchors")
    stretch = materialize(every.join(often, "anchor", "left_semi"), "repeats-stretches")
    spans, rims = _places(stretch)
    # bounded by the text: at most a place for each of its windows; equal rows fold
    places = spans.unionByName(rims).groupBy("id", "tag").agg(
        F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n"), "kind")).alias("places"))
    row = rows.schema["row"]
    met_schema = T.StructType([row, T.StructField("id", T.LongType()), T.StructField("tag", T.IntegerType()), *_RESULT.fields,
                               T.StructField("open", T.BooleanType()), T.StructField("claims", _CLAIMS)])
    met = materialize(rows.join(places, ["id", "tag"], "left").select("row", "id", "tag", "text", "places")
                      .mapInArrow(_met(width, met_schema), met_schema), "repeats-met")
    claims = met.select("id", "tag", F.explode("claims").alias("c")).select("id", "tag", "c.*")
    twice = claims.groupBy("high", "low").agg(F.sum("weight").alias("w")).filter("w > 1").select("high", "low")
    found = (claims.filter(F.col("weight") == ALONE).join(twice, ["high", "low"], "left_semi")
             .groupBy("id", "tag").agg(F.collect_set("pos").alias("found")))
    done_schema = T.StructType([row, *_RESULT.fields])
    closed = (met.filter("open").join(found, ["id", "tag"], "left").select("row", "n_words", "spans", "kept", "found")
              .mapInArrow(_closed(width, done_schema), done_schema))
    return met.filter("NOT open").select("row", *OUT).unionByName(closed).select("row.*", *OUT)
