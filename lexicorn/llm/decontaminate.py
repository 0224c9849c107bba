"""Operator 7: benchmark decontamination by q-gram lemma filtering.

Texts are reduced to lower-case letters and digits with one blank between runs. Each
benchmark item is cut into overlapping segments in two ways: of ``length`` characters, half a
segment apart, and of ``short`` characters every ``stride`` (the last one of each ends with the
item; a shorter item is one segment). So an exact passage of ``short + stride - 1`` characters
is found wherever it begins in the item, and the long segments, whose edits may stand closer
together, are found as well. Each has an edit budget ``e`` of ``rate`` times its length. If a segment occurs in a document with at most ``e`` edits, the two share
at least ``length - q + 1 - q * e`` q-grams whose diagonals (place in the document less
place in the segment) differ by at most ``e``. So the shared q-grams are counted in diagonal
bands of width ``2 (e + 1)`` that begin every ``e + 1`` diagonals, bands that reach the bound
are kept, and every kept band is verified by a banded alignment. No occurrence within the
budget is lost, and nothing is reported that is not within it.

A document is a row from beginning to end: there is no shuffle and no join of documents.
The benchmark is read in blocks of about ``block_chars`` characters (the bound of what a
task holds); each block is one more step over the same rows, so any benchmark size will do.

Defined cases: null text = empty text, never contaminated; an item of fewer than
``q`` normalised characters is one segment that matches as a whole run of words, without edits; an
item without letters and digits matches nothing; repeated rows and null ids are
judged row by row; equal benchmark items are all reported; an empty table or benchmark gives
no match; input columns named like an output column are replaced. Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.llm.common import without

_RUN = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


@dataclass(frozen=True)
class Budget:
    q: int = 12
    length: int = 100
    rate: float = 0.06
    short: int = 60
    stride: int = 10

    def segments(self, n: int) -> list[tuple[int, list[int]]]:
        """(length, starts) of the two kinds of segments of an item of n characters; a start
        is given once for each length."""
        kinds = []
        for length, step in ((self.length, self.length // 2), (self.short, self.stride)):
            size, last = min(n, length), max(0, n - length)
            if all(size != other for other, _ in kinds):
                kinds.append((size, sorted({*range(0, last, step), last})))
        return kinds

    def edits(self, n: int) -> int:
        """Edit budget of a segment of n characters; small enough for a positive bound."""
        return max(0, min(int(self.rate * n), (n - self.q) // self.q))

    def shared(self, n: int) -> int:
        """Least number of shared q-grams within the budget."""
        return n - self.q + 1 - self.q * self.edits(n)


def normalise(text: str | None) -> str:
    return _RUN.sub(" ", (text or "").lower()).strip()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hash of the q-gram that begins at each place."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= _BASE
        h += codes[k:k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Index:
    """Q-grams of one block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str | None]], budget: Budget):
        self.budget = budget
        self.item: list[int | None] = []
        self.start: list[int] = []
        self.segment: list[str] = []
        entries = []
        short: dict[int, dict[str, list[int]]] = {}  # by length, with the blanks around them
        for item_id, text in items:
            s = normalise(text)
            if len(s) < budget.q:
                if s:
                    short.setdefault(len(s) + 2, {}).setdefault(f" {s} ", []).append(len(self.item))
                    self.item.append(item_id)
                    self.start.append(0)
                    self.segment.append(s)
                continue
            h = _grams(_codes(s), budget.q)
            at = np.arange(len(h))
            for length, starts in budget.segments(len(s)):
                # the segments of this length that hold the q-gram at a place are neighbours
                lo = np.searchsorted(starts, at - (length - budget.q), "left")
                entries.append((h, at, lo + len(self.item), np.searchsorted(starts, at, "right") - lo))
                self.item += [item_id] * len(starts)
                self.start += starts
                self.segment += [s[a:a + length] for a in starts]
        self.edits = np.array([budget.edits(len(s)) for s in self.segment], np.int64)
        self.need = np.array([budget.shared(len(s)) for s in self.segment], np.int64)
        flat, at, first, n = map(np.concatenate, zip(*entries)) if entries else [np.zeros(0, np.uint64)] * 4
        order = np.argsort(flat, kind="stable")
        self.hash = flat[order]
        self.place, self.first, self.n = (x[order].astype(np.int32) for x in (at, first, n))
        self.starts = np.array(self.start, np.int64)
        self.short = [(n, np.sort(np.concatenate([_grams(_codes(x), n) for x in of])), of) for n, of in short.items()]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[(self.hash >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, segment, place in the segment) of every shared q-gram."""
        h = _grams(codes, self.budget.q)
        place = np.flatnonzero(self.known[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        lo = np.searchsorted(self.hash, h[place], "left")
        n = np.searchsorted(self.hash, h[place], "right") - lo
        place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, n = np.repeat(place, n), self.n[entry].astype(np.int64)
        seg = np.repeat(self.first[entry] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(place, n), seg, np.repeat(self.place[entry].astype(np.int64), n) - self.starts[seg]

    def candidates(self, codes: np.ndarray) -> list[tuple[int, int, int]]:
        """(segment, first diagonal, last diagonal) of each band that reaches the bound."""
        place, seg, at = self.hits(codes)
        if len(place) == 0:
            return []
        step = self.edits[seg] + 1
        first = np.floor_divide(place - at, step)
        seg2, band = np.concatenate([seg, seg]), np.concatenate([first, first - 1])
        order = np.lexsort((band, seg2))
        seg2, band = seg2[order], band[order]
        new = np.flatnonzero(np.r_[True, (seg2[1:] != seg2[:-1]) | (band[1:] != band[:-1])])
        count = np.diff(np.r_[new, len(seg2)])
        seg2, band = seg2[new], band[new]
        kept = count >= self.need[seg2]
        width = self.edits[seg2] + 1
        return [(int(s), int(b * w), int((b + 2) * w - 1))
                for s, b, w in zip(seg2[kept], band[kept], width[kept])]

    def runs(self, text: str) -> Iterator[tuple[int, int]]:
        """(segment, first place) of each item shorter than q that is a whole run of words."""
        padded = f" {text} "
        for n, hashes, of in self.short:
            h = _grams(_codes(padded), n)
            place = np.flatnonzero(hashes[np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)] == h)
            seen: set[str] = set()
            for p in place[np.unique(h[place], return_index=True)[1]].tolist():
                run = padded[p:p + n]
                if run in of and run not in seen:
                    seen.add(run)
                    yield from ((seg, p) for seg in of[run])

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(segment, edits, diagonal) of each segment found within its budget, at its best."""
        codes = _codes(text)
        best: dict[int, tuple[int, int]] = {seg: (0, place) for seg, place in self.runs(text)}
        for seg, lo, hi in self.candidates(codes):
            if seg in best and best[seg][0] == 0:
                continue
            found = banded(_codes(self.segment[seg]), codes, lo, hi, int(self.edits[seg]))
            if found is not None and (seg not in best or found < best[seg]):
                best[seg] = found
        return [(s, *best[s]) for s in sorted(best)]


def banded(segment: np.ndarray, codes: np.ndarray, lo: int, hi: int, budget: int) -> tuple[int, int] | None:
    """(edits, diagonal it ends on) of the best alignment of the whole segment that stays on
    diagonals lo..hi, or None if it takes more than ``budget`` edits."""
    n, width = len(segment), hi - lo + 1
    padded = np.zeros(n + width, np.int64)  # code point 0 does not occur in normalised text
    a, b = max(0, lo), min(len(codes), lo + n + width)
    if a < b:
        padded[a - lo:b - lo] = codes[a:b]
    windows = np.lib.stride_tricks.sliding_window_view(padded, n)[:width]
    wrong = windows != segment
    exact = wrong.sum(axis=1)
    if exact.min() == 0:
        return 0, lo + int(exact.argmin())
    steps = np.arange(width)
    row = np.zeros(width, np.int64)  # a match may begin anywhere in the band
    for i in range(n):
        down = row + wrong[:, i]
        down[:-1] = np.minimum(down[:-1], row[1:] + 1)  # a character of the segment is missing
        row = np.minimum.accumulate(down - steps) + steps  # the document has one more
        if row.min() > budget:
            return None
    return (int(row.min()), lo + int(row.argmin())) if row.min() <= budget else None


# ------------------------------------------------------------------ Spark jobs

def _blocks(benchmark: DataFrame, item: str, text: str, budget: Budget, block_chars: int) -> Iterator[Index]:
    """One index per block of items; blocks are dealt by a hash, so none grows with the table."""
    rows = benchmark.select(benchmark[item].alias("item"), benchmark[text].alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield Index([(r["item"], r["text"]) for r in part.sort("item", "text").collect()], budget)


MATCH = "array<struct<item_id:bigint,segments:int,edits:int,place:int>>"


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
               item_text: str = "text", budget: Budget = Budget(), block_chars: int = 1 << 20) -> DataFrame:
    """``df`` with ``leaks``: per benchmark item found, the number of its segments that occur,
    the fewest edits of one and its place in the normalised text."""
    out = df.select(*[df[c] for c in without(df, ["leaks"]).columns], F.array().cast(MATCH).alias("leaks"))
    at = next(k for k, c in enumerate(out.columns) if c.lower() == text.lower())
    for index in _blocks(benchmark, item, item_text, budget, block_chars):
        out = out.mapInArrow(_finder(index, at), out.schema)
    return out


def _finder(index: Index, at: int):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("segments", pa.int32()),
                               ("edits", pa.int32()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaks = b.column(b.num_columns - 1).to_pylist()
            for k, x in enumerate(b.column(at)):
                found: dict = {}
                for seg, edits, place in index.matches(normalise(x.as_py())):
                    n, best = found.get(index.item[seg], (0, (edits, place)))
                    found[index.item[seg]] = n + 1, min(best, (edits, place))
                leaks[k] = leaks[k] + [{"item_id": i, "segments": n, "edits": e, "place": max(0, p)}
                                       for i, (n, (e, p)) in found.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(leaks, kind)], names=b.schema.names)
    return run


def decontaminate(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` in which no benchmark segment occurs; all columns stay."""
    found = find_leaks(df, benchmark, **options)
    return found.filter(F.size("leaks") == 0).drop("leaks").select(*without(df, ["leaks"]).columns)
