"""Operator 4: byte-level BPE encoding and decoding.

Pre-tokenisation uses no regular expression. Each code point has a class (from a table that
asks the tokenizer library which code points its own pattern classes match). An automaton
over classes follows the split pattern, contractions included; the transition functions of
its classes generate a finite monoid, so the run over a text is an associative scan: blocks
compose their functions side by side in numpy, block totals are combined by doubling, and
every position then reads its state, from which boundaries follow. The slices between
boundaries go through a cache of merged pieces; a miss is merged by ranks with a heap. Byte
offsets of the tokens are kept, and decoding gathers the vocabulary's bytes by them.

Defined cases: null text = empty text (no ids); repeated rows are encoded again (the cache
holds their pieces); an empty table gives an empty result; input columns named like an
output column are replaced. Very long texts and very long pieces are handled whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.llm.common import without

# classes of code points; the letters of a contraction have classes of their own
LETTER, SHORT, R, V, L, E, NUMBER, SPACE, BLANK, OTHER, APOSTROPHE, END = range(12)
# states: what the last code point was part of. QUOTE is an apostrophe that begins a token,
# AFTER_* a contraction begun by it, CLOSED the last letter of a contraction.
IN_LETTERS, IN_NUMBERS, IN_SPACE, AT_BLANK, IN_OTHERS, QUOTE, AFTER_R, AFTER_V, AFTER_L, CLOSED = range(10)
MAX_CACHE, MAX_CACHED_PIECE = 1 << 18, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def class_table() -> np.ndarray:
    """Class of every code point, as the tokenizer library's own pattern classes have it."""
    import tiktoken
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}
    for code, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        hit = bytes(probe.encode_ordinary(points)).decode()
        table[np.frombuffer(hit.encode("utf-32-le"), np.uint32)] = code
    table[0x20] = BLANK
    for c, code in (("'", APOSTROPHE), ("s", SHORT), ("t", SHORT), ("m", SHORT), ("d", SHORT),
                    ("r", R), ("v", V), ("l", L), ("e", E)):
        table[ord(c)] = code
    return table


def _transition(state: int, cls: int) -> int:
    if cls <= E:
        if state == QUOTE:
            return {SHORT: CLOSED, R: AFTER_R, V: AFTER_V, L: AFTER_L}.get(cls, IN_LETTERS)
        if (state, cls) in ((AFTER_R, E), (AFTER_V, E), (AFTER_L, L)):
            return CLOSED
        return IN_LETTERS
    if cls == APOSTROPHE:
        return IN_OTHERS if state in (IN_OTHERS, QUOTE, AT_BLANK) else QUOTE
    return {NUMBER: IN_NUMBERS, SPACE: IN_SPACE, BLANK: AT_BLANK, OTHER: IN_OTHERS, END: IN_SPACE}[cls]


class _Monoid:
    """Transition functions closed under composition; ``table[a, b]`` is first a, then b.
    Element 0 is the identity."""

    def __init__(self) -> None:
        generators = [tuple(_transition(s, c) for s in range(10)) for c in range(12)]
        items = [tuple(range(10))]
        index = {items[0]: 0}
        for f in items:
            for g in generators:
                h = tuple(g[x] for x in f)
                if h not in index:
                    index[h] = len(items)
                    items.append(h)
        self.functions = np.array(items, np.uint8)
        self.table = np.array([[index[tuple(b[x] for x in a)] for b in items] for a in items], np.uint16)
        self.of_class = np.array([index[g] for g in generators], np.uint16)


_MONOID = _Monoid()


def scan_states(classes: np.ndarray, start: int = IN_SPACE, block: int = 64) -> np.ndarray:
    """State after each position: an inclusive scan of transition functions."""
    n = len(classes)
    m, t = _MONOID, _MONOID.table
    rows = max(1, -(-n // block))
    f = np.zeros(rows * block, np.uint16)
    f[:n] = m.of_class[classes]
    by_place = np.ascontiguousarray(f.reshape(rows, block).T)
    for k in range(1, block):  # all blocks side by side
        by_place[k] = t[by_place[k - 1], by_place[k]]
    total, step = by_place[-1].copy(), 1
    while step < rows:  # inclusive scan of the block totals by doubling
        total[step:] = t[total[:-step], total[step:]]
        step *= 2
    entry = np.full(rows, start, np.uint8)
    entry[1:] = m.functions[total[:-1], start]
    return m.functions[by_place, entry[None, :]].T.reshape(-1)[:n]


def boundaries(classes: np.ndarray) -> np.ndarray:
    """Where tokens begin; END positions (between texts) are tokens of their own."""
    n = len(classes)
    if n == 0:
        return np.zeros(0, bool)
    state = scan_states(classes)
    space = (classes == SPACE) | (classes == BLANK)
    end = classes == END
    group = np.zeros(12, np.uint8)
    group[[NUMBER, SPACE, BLANK, OTHER, APOSTROPHE, END]] = [1, 2, 2, 3, 3, 4]
    g = group[classes]
    begin = np.ones(n, bool)
    begin[1:] = (g[1:] != g[:-1]) | end[1:]
    # a blank goes with the word, number or signs after it
    begin[1:] &= ~((classes[:-1] == BLANK) & ~space[1:] & ~end[1:])
    # the last white space of a run stands apart if something follows it
    follows = np.zeros(n, bool)
    follows[:-1] = ~space[1:] & ~end[1:]
    begin |= space & follows
    # a contraction is one token, and what follows it is another
    closed = np.flatnonzero(state == CLOSED)
    begin[closed] = False
    long = closed[classes[closed] != SHORT]
    begin[long - 1] = False
    after = closed + 1
    begin[after[after < n]] = True
    return begin


class Pieces(dict):
    """Cache from a piece to its ids as little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self._merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= MAX_CACHED_PIECE:
            if len(self) >= MAX_CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def _merge(self, raw: bytes) -> list[int]:
        """Merge the pair of lowest rank first, the leftmost of equals."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        if n <= MAX_CACHED_PIECE:  # the same merges, by scans of a short list
            none = len(ranks) + 256
            starts = list(range(n + 1))
            pair = [ranks.get(raw[i:i + 2], none) for i in range(n - 1)]
            while pair and (best := min(pair)) < none:
                i = pair.index(best)
                del starts[i + 1], pair[i]
                if i:
                    pair[i - 1] = ranks.get(raw[starts[i - 1]:starts[i + 1]], none)
                if i < len(pair):
                    pair[i] = ranks.get(raw[starts[i]:starts[i + 2]], none)
            return [ranks[raw[a:b]] for a, b in zip(starts, starts[1:])]
        ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(raw[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = ends[i]
            if not alive[i] or j >= n or ranks.get(raw[i:ends[j]]) != rank:
                continue  # one side has been merged since
            alive[j] = False
            ends[i] = k = ends[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(raw[i:ends[k]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := ranks.get(raw[before[i]:k])) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [ranks[raw[i:ends[i]]] for i in range(n) if alive[i]]


class Codec:
    """Encoder and decoder of one rank file; one per Python worker."""

    _loaded: dict[str, "Codec"] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.pieces = Pieces(ranks)
        self.classes = class_table()
        by_id = sorted((i, b) for b, i in ranks.items())
        self.length = np.zeros(by_id[-1][0] + 1, np.int64)
        self.length[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(b for _, b in by_id), np.uint8)

    @classmethod
    def load(cls, path: str) -> "Codec":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the number of ids of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        joined = "\0".join(texts) + "\0"
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        classes = self.classes[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        classes[ends] = END
        at = np.flatnonzero(boundaries(classes))
        is_end = classes[at] == END
        stops = np.append(at[1:], len(classes))
        text_at, text_stop = at[~is_end].tolist(), stops[~is_end].tolist()
        slices = [joined[a:b] for a, b in zip(text_at, text_stop)]
        packed = list(map(self.pieces.__getitem__, slices))
        ids = np.frombuffer(b"".join(packed), "<u4")
        per_piece = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        owner = np.searchsorted(ends, at[~is_end])
        counts = np.bincount(owner, weights=per_piece, minlength=len(texts)).astype(np.int64)
        return ids, counts

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token in its text."""
        size = self.length[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The text's bytes, gathered from the vocabulary by the kept offsets."""
        if len(ids) == 0:
            return b""
        size = self.length[ids]
        total = int(offsets[-1] + size[-1])
        place = np.repeat(self.start[ids] - offsets, size)
        return self.bytes[place + np.arange(total)].tobytes()


def _chunks(sizes: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    start = held = 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def _list(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))


def _back(codec: Codec, ids: pa.ListArray, offsets: pa.ListArray) -> list[pa.Array]:
    """Decoded bytes and packed ids of each row, from its ids and offsets."""
    decoded, packed = [], []
    for i, o in zip(ids, offsets):
        i = np.asarray(i.values, np.int64)
        decoded.append(codec.decode(i, np.asarray(o.values, np.int64)))
        packed.append(i.astype("<u4").tobytes())
    return [pa.array(decoded, pa.binary()), pa.array(packed, pa.binary())]


_CODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("offsets", T.ArrayType(T.IntegerType()))]
_DECODED = [T.StructField("decoded", T.BinaryType()), T.StructField("ids_packed", T.BinaryType())]


def encode(df: DataFrame, ranks: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` and ``offsets`` (byte offset of each token), both ARRAY<INT>. With
    ``decoded`` the ids are decoded again at once, and the columns of `decode` follow."""
    added = _CODED + (_DECODED if decoded else [])
    kept = without(df, [f.name for f in added])
    rows = kept.select("*", F.coalesce(df[text], F.lit("")).alias("__text"))
    schema = T.StructType([*kept.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks)
        for b in batches:
            texts = b.column(b.num_columns - 1)
            for lo, hi in _chunks(pc.binary_length(texts).to_pylist()):
                ids, counts = codec.encode(texts.slice(lo, hi - lo).to_pylist())
                size = codec.length[ids]
                at = np.cumsum(size) - size
                first = np.cumsum(counts) - counts
                base = np.repeat(at[np.minimum(first, max(0, len(at) - 1))] if len(at) else first, counts)
                coded = [_list(ids, counts), _list(at - base, counts)]
                more = _back(codec, *coded) if decoded else []
                yield pa.RecordBatch.from_arrays([*b.slice(lo, hi - lo).columns[:-1], *coded, *more],
                                                 names=schema.names)
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str) -> DataFrame:
    """``df`` with ``decoded`` (BINARY) from ``ids`` and ``offsets``, and ``ids_packed``, the
    ids as little-endian unsigned 32-bit integers (BINARY)."""
    kept = without(df, [f.name for f in _DECODED])
    schema = T.StructType([*kept.schema.fields, *_DECODED])
    ids_at, offsets_at = kept.columns.index("ids"), kept.columns.index("offsets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(ranks)
        for b in batches:
            for lo, hi in _chunks([4 * n for n in pc.list_value_length(b.column(ids_at)).to_pylist()]):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, *_back(codec, part.column(ids_at), part.column(offsets_at))],
                                                 names=schema.names)
    return kept.mapInArrow(run, schema)
