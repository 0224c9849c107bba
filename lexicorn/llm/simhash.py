"""Operator 8: SimHash near-duplicates by tiled exact comparison.

Each document gets a 64-bit fingerprint: words are runs of bytes outside space, tab, LF, VT,
FF, CR after lower-casing A-Z; shingles of ``k`` words joined by a blank are hashed (XXH64,
seed 42); a bit is set if it is set in over half the hashes. Documents with equal
fingerprints are folded into one, and distinct fingerprints are compared exactly.

Tiles: a fingerprint's population counts in two or four equal sections name its cell. Two
fingerprints within ``radius`` bits differ by at most ``radius`` in the sum of their sections'
count differences, so only cells that near can hold links; every other pair of tiles is
skipped. Two sections make cells large enough to be worth a row while there are few
fingerprints, four skip more pairs when there are many; the links are the same. A cell with
more than ``tile_rows`` fingerprints is split into several tiles by a hash. A tile travels as
one row, a packed array of at most that many fingerprints, to the tiles it has to meet. A task
holds one tile at a time and streams the visiting arrays past it (exclusive or, bit counts).

A tile emits a spanning forest of its links, at most one edge per fingerprint it read, never
all pairs. Components: every partition of ``edge_rows`` edges is replaced by its spanning
stars; while there is more than one such partition, alternating large-star and small-star
rounds follow, written to the shared folder every round. Tables are coalesced to their rows,
so that few edges are few tasks however many shuffle partitions the session has. The table of
cell sizes has at most 17**4 rows.

Defined cases: null text = no words, like an empty text (fingerprint 0, linked like any
other); fewer than ``k`` words = one shingle of all words; null ids get their component's
smallest id; repeated rows are kept; an empty table gives an empty result; input columns
named like an output column (``fingerprint``, ``component_id``) are replaced, all others are
returned whatever their names.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicorn.llm.common import materialize, without

#: from so many distinct fingerprints on, four sections in place of two
MANY = 1 << 17
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


# ------------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, k: int = 3, block: int = 1 << 14) -> int:
    """SimHash of one text as an unsigned 64-bit integer."""
    import xxhash
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], stops[:-1] + 1])
    if len(words) > k:
        starts, stops = starts[:len(words) - k + 1], stops[k - 1:]
    else:
        starts, stops = starts[:1], stops[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts.tolist(), stops.tolist())),
                         np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), block):  # a byte's bits, most significant first
        part = hashes[at:at + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = total * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def with_fingerprints(df: DataFrame, row: list[str], key: str, text: str, k: int) -> DataFrame:
    """(row, key, fp): the columns ``row`` as one struct, so that no name of theirs can clash,
    and the fingerprint as a signed long. A text that is part of the row is sent once."""
    inside = row.index(text) if text in row else None
    rows = df.select(F.struct(*[df[c] for c in row]).alias("row"), df[key].alias("key"),
                     *([] if inside is not None else [df[text].alias("text")]))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).field(inside) if inside is not None else b.column(2)
            prints = np.fromiter((fingerprint(x.as_py(), k) for x in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(prints.view(np.int64))], names=["row", "key", "fp"])
    return rows.mapInArrow(run, schema)


# ------------------------------------------------------------------ tiled comparison

def _near_cells(radius: int, sections: int) -> list[tuple[int, ...]]:
    """Differences of section counts with an absolute sum of at most ``radius``."""
    span = range(-radius, radius + 1)
    return [d for d in itertools.product(span, repeat=sections) if sum(map(abs, d)) <= radius]


def _cell(counts: F.Column, sections: int) -> F.Column:
    cell = F.lit(0)
    for k in range(sections):
        cell = cell * (64 // sections + 1) + counts[k]
    return cell.cast("int")


def _tasks(spark: SparkSession, rows: int, a_task: int) -> int:
    """Tasks for so many rows, at most the session's shuffle partitions."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // a_task)))


def _tiles(prints: DataFrame, n: int, radius: int, tile_rows: int, sections: int) -> DataFrame:
    """(cell, part, home, fps): every tile's fingerprints at home, and as a visitor in every other
    tile that comes after it and is near enough to hold a link."""
    bits = 64 // sections
    masks = [((1 << bits) - 1) << (bits * i) for i in range(sections)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    counts = F.array(*[F.bit_count(F.col("fp").bitwiseAND(F.lit(m))) for m in masks])
    counted = prints.select("fp", counts.alias("q")).withColumn("cell", _cell(F.col("q"), sections))
    sizes = counted.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("parts"))
    # at most 17**4 cells of eight bytes: a proven bound for the broadcast
    sizes = F.broadcast(materialize(sizes.coalesce(1), "simhash-cells"))
    dealt = counted.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("fp"), "parts").cast("int"))
    # a tile has about tile_rows fingerprints, whatever its cell has
    own = (dealt.groupBy("cell", "part").agg(F.first("q").alias("q"), F.first("parts").alias("parts"),
                                             F.collect_list("fp").alias("fps"))
           .coalesce(_tasks(prints.sparkSession, n, 1 << 16)))
    own = materialize(own, "simhash-tiles")
    ahead = [d for d in _near_cells(radius, sections) if d > (0,) * sections]
    steps = F.array(*[F.array(*map(F.lit, d)) for d in ahead])
    moved = (own.select("fps", "q", F.explode(steps).alias("d"))
             .select("fps", F.zip_with("q", "d", lambda a, b: a + b).alias("q"))
             .filter(F.forall("q", lambda x: x.between(0, bits)))
             .select("fps", _cell(F.col("q"), sections).alias("cell")))
    visits = (moved.join(sizes, "cell")
              .select("cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "fps"))
    beside = (own.filter("part + 1 < parts")
              .select("cell", F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("part"), "fps"))
    return (own.select("cell", "part", F.lit(True).alias("home"), "fps")
            .unionByName(visits.unionByName(beside).withColumn("home", F.lit(False))))


class Forest:
    """Union-find over the fingerprints of one tile; `add` says whether an edge joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while (p := up.get(x, x)) != root:
            up[x] = root
            x = p
        return root

    def add(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _links(radius: int, block: int = 512):
    """Stream of tiles sorted by (cell, part, visitors last) to a forest of links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, forest = None, np.zeros(0, np.uint64), Forest()
        for b in batches:
            found: list[tuple[int, int]] = []
            for cell, part, at_home, fps in zip(*(b.column(k) for k in range(4))):
                rows = fps.values.to_numpy().view(np.uint64)
                if key != (cell.as_py(), part.as_py()):
                    key, home, forest = (cell.as_py(), part.as_py()), np.zeros(0, np.uint64), Forest()
                # the home tile comes first and meets itself; visitors meet only the home tile
                at_home = at_home.as_py()
                if at_home:
                    home = rows
                for k in range(0, len(rows), block):
                    far = np.bitwise_count(rows[k:k + block, None] ^ home[None, :])
                    x, y = np.nonzero(far <= radius)
                    if at_home:
                        later = y < k + x
                        x, y = x[later], y[later]
                    found += [(u, v) for u, v in zip(rows[k + x].tolist(), home[y].tolist()) if forest.add(u, v)]
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def links(prints: DataFrame, radius: int = 3, tile_rows: int = 4096, n: int | None = None,
          sections: int | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span every component of the links."""
    n = prints.count() if n is None else n
    spark = prints.sparkSession
    tiles = _tiles(prints, n, radius, tile_rows, sections or (4 if n >= MANY else 2))
    # partitions are merged after the shuffle, before the sort: a task takes thousands of fingerprints
    tiles = (tiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell", "part")
             .coalesce(_tasks(spark, n, 1 << 12)).sortWithinPartitions("cell", "part", F.col("home").desc()))
    return tiles.mapInArrow(_links(radius), "a long, b long")


# ------------------------------------------------------------------ components

def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning forest of one partition's edges: (node, smallest node of its tree)."""
    forest = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            forest.add(u, v)
    nodes = list(forest.up)
    roots = [forest.find(x) for x in nodes]
    for lo in range(0, len(nodes), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[lo:lo + (1 << 16)], pa.int64()),
                                          pa.array(roots[lo:lo + (1 << 16)], pa.int64())], names=["a", "b"])


def _is_stars(edges: DataFrame) -> bool:
    """Every node hangs on one node, which hangs on none."""
    n = edges.agg(F.count("*").alias("n"), F.countDistinct("a").alias("d")).first()
    hung = edges.select(F.col("a").alias("b"))
    return n["n"] == n["d"] and edges.join(hung, "b", "left_semi").isEmpty()


def components(edges: DataFrame, edge_rows: int = 1 << 19) -> DataFrame:
    """(node, root) of every node with an edge, root = the component's smallest node.

    Edges point from a larger to a smaller node. A round hangs a node's larger neighbours
    (large star), then its smaller ones (small star), on the smallest of them, until all
    edges form stars. The minima are written before they are joined, so that a hub is a
    plain skewed join, which adaptive execution splits."""
    spark = edges.sparkSession
    edges = materialize(edges, "cc-links")
    n = edges.count()
    # a partition's forest is held in a task: ``edge_rows`` edges, 16 bytes each
    parts = max(1, -(-n // edge_rows))
    dealt = edges.coalesce(1) if parts == 1 else edges.repartition(parts, "b")
    both = dealt.mapInArrow(_contract, "a long, b long")
    if parts == 1:
        return both.select(F.col("a").alias("node"), F.col("b").alias("root"))

    def written(df: DataFrame, name: str) -> DataFrame:
        return materialize(df.coalesce(_tasks(spark, n, 1 << 16)), name)
    both = written(both.distinct(), "cc-edges")
    while not _is_stars(both):
        sides = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "cc-low")
        large = (sides.filter("b > a").join(low, "a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        large = written(large, "cc-large")
        low = written(large.groupBy("a").agg(F.min("b").alias("low")), "cc-low")
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(low.select("a", F.col("low").alias("b")))
                 .filter("a <> b").distinct())
        both = written(small, "cc-small")
    return both.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _least_of_component(prints: DataFrame, least: F.Column, radius: int, tile_rows: int) -> DataFrame:
    """(fp, least): for every fingerprint of the written table ``prints``, the least value of
    ``least`` in its component."""
    spark = prints.sparkSession
    rows = prints.count()
    distinct = materialize(prints.groupBy("fp").agg(F.min(least).alias("own")).coalesce(_tasks(spark, rows, 1 << 16)),
                           "simhash-distinct")
    n = distinct.count()
    roots = materialize(components(links(distinct, radius, tile_rows, n)).coalesce(_tasks(spark, n, 1 << 16)),
                        "simhash-roots")
    by_print = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
                .withColumn("root", F.coalesce("root", "fp")))
    component = materialize(by_print.groupBy("root").agg(F.min("own").alias("least"))
                            .coalesce(_tasks(spark, n, 1 << 16)), "simhash-components")
    return materialize(by_print.join(component, "root").select("fp", "least").coalesce(_tasks(spark, n, 1 << 16)),
                       "simhash-labels")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3,
                    radius: int = 3, tile_rows: int = 4096) -> DataFrame:
    """``df`` without its text, with ``fingerprint`` (16 hex digits) and ``component_id``, the
    smallest key in the document's component."""
    kept = [c for c in without(df, ["fingerprint", "component_id"]).columns if c.lower() != text.lower()]
    prints = materialize(with_fingerprints(df, kept, key, text, k), "simhash")
    labels = _least_of_component(prints, F.struct(F.col("key").isNull().alias("last"), "key"), radius, tile_rows)
    return (prints.join(labels, "fp", "left")
            .select("row.*", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                    F.col("least.key").alias("component_id")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, radius: int = 3,
             tile_rows: int = 4096) -> DataFrame:
    """One row of ``df`` of each component, with all its columns: a row of the smallest key.

    Rows are numbered and written once with their fingerprints; only numbers, keys and
    fingerprints are grouped, and whole rows meet no more than the list of rows to drop."""
    text = next(c for c in df.columns if c.lower() == text.lower())
    whole = materialize(with_fingerprints(df, df.columns, key, text, k)
                        .withColumn("number", F.monotonically_increasing_id()), "simhash-rows")
    light = whole.select("fp", "number", "key")
    labels = _least_of_component(light, F.struct(F.col("key").isNull().alias("last"), "key", "number"), radius, tile_rows)
    dropped = light.join(labels, "fp").filter(F.col("number") != F.col("least.number")).select("number")
    return whole.join(materialize(dropped, "simhash-dropped"), "number", "left_anti").select("row.*")
