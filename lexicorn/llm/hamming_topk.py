"""Operator 6: exact top-k search over binary codes by incremental multi-index hashing.

A vector's code holds the signs of its components (bit set: component > 0), cut into 16-bit
segments. The index lists every distinct code once per segment, under (segment number,
segment value). In round r each open query probes, for each of its segments, all values at
exactly r bits from its own, and every code found is verified by its full distance. After
round r with m segments every code within m (r + 1) - 1 bits has been seen (pigeonhole), so
a query closes as soon as its k-th verified distance is not above that, and only open
queries go on.

Equal vectors are folded: a code keeps its k smallest ids (more can't reach any result),
chosen before the shuffle; equal query codes are searched once. An upper bound of the k-th
distance, first taken against a bounded sample of codes, lets the join drop verified codes
that can't be results; it never drops one that can.

Defined cases: a null vector has no code (not found, asks nothing); a null component or one
beyond a short vector's end = bit not set; NaN counts as the largest value; a vector longer than ``bits`` is an error; null
ids are not queries and sort last; ties go to the smaller id; a query finds its own row; repeated
rows count each; fewer than k rows = all of them; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicorn.llm.common import materialize

SEGMENT = 16


def _words(vector: Column, bits: int) -> list[Column]:
    """The sign bits as 64-bit words."""
    def word(at: int) -> Column:
        part = F.slice(vector, at + 1, min(64, bits - at))
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(
            F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))

    def aligned(at: int) -> Column:  # a short vector's missing components are zero bits
        size = min(64, bits - at)
        short = F.greatest(F.lit(0), F.lit(size) - F.greatest(F.lit(0), F.size(vector) - at))
        return F.call_function("shiftleft", word(at), F.least(short, F.lit(63)))
    return [aligned(at) for at in range(0, bits, 64)]


def codes(df: DataFrame, bits: int, key: str, vector: str) -> DataFrame:
    """(id, w0, w1, ...) of every row with a vector."""
    v = df[vector]
    checked = F.when(F.size(v) > bits, F.raise_error(F.lit(f"a vector has more than {bits} components"))
                     .cast(df.schema[vector].dataType)).otherwise(v)
    rows = df.filter(v.isNotNull()).select(df[key].cast("long").alias("id"), checked.alias("v"))
    return rows.select("id", *[w.alias(f"w{i}") for i, w in enumerate(_words(F.col("v"), bits))])


def _segments(bits: int, prefix: str = "") -> Column:
    """Array of the 16-bit segments of a code."""
    out = []
    for at in range(0, bits, SEGMENT):
        size = min(64, bits - at // 64 * 64)
        shift = size - SEGMENT - at % 64
        out.append(F.shiftrightunsigned(F.col(f"{prefix}w{at // 64}"), shift).bitwiseAND(F.lit(0xFFFF)).cast("int"))
    return F.array(*out)


def _distance(n_words: int, a: str, b: str) -> Column:
    total = F.lit(0)
    for i in range(n_words):
        total = total + F.bit_count(F.col(f"{a}w{i}").bitwiseXOR(F.col(f"{b}w{i}")))
    return total


def search(df: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, key: str = "vec_id",
           vector: str = "embedding", sample: int = 1024) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k rows of ``df`` nearest to each row of
    ``queries`` by (Hamming distance, id)."""
    if bits % SEGMENT:
        raise ValueError(f"bits must be a multiple of {SEGMENT}")
    n_words, m = -(-bits // 64), bits // SEGMENT
    words = [f"w{i}" for i in range(n_words)]
    qwords = [f"qw{i}" for i in range(n_words)]

    per_code = Window.partitionBy(*words).orderBy(F.col("id").asc_nulls_last())
    index = materialize(
        codes(df, bits, key, vector).withColumn("_n", F.row_number().over(per_code)).filter(F.col("_n") <= k)
        .groupBy(*words).agg(F.array_sort(F.collect_list(F.struct(F.col("id").isNull().alias("last"), "id"))).alias("ids")),
        "mih-codes")
    n_rows = index.agg(F.sum(F.size("ids"))).first()[0] or 0
    need = min(k, n_rows)
    asked = materialize(codes(queries, bits, key, vector).filter("id is not null").distinct(), "mih-queries")
    if need == 0:
        return _result(asked.limit(0).withColumn("found", F.array().cast(
            "array<struct<distance:int,last:boolean,id:bigint>>")))

    segments = index.select(*words, F.posexplode(_segments(bits)).alias("seg", "value"))
    start = asked.select(*[F.col(w).alias(q) for w, q in zip(words, qwords)]).distinct()
    pivots = [tuple(r) for r in index.select(*words).orderBy(F.xxhash64(*words), *words).limit(sample).collect()]
    if len(pivots) >= need:  # each pivot stands for a row at least
        table = F.from_json(F.lit(json.dumps([dict(zip(words, p)) for p in pivots])),
                            f"array<struct<{','.join(w + ':bigint' for w in words)}>>")
        far = F.array_sort(F.transform(table, lambda p: sum(
            (F.bit_count(F.col(q).bitwiseXOR(p[w])) for w, q in zip(words, qwords)), F.lit(0))))
        start = start.withColumn("bound", F.element_at(far, need))
    else:
        start = start.withColumn("bound", F.lit(bits))
    state = materialize(start.withColumn("open", F.lit(True)), "mih-state")
    kept = None

    powers = [1 << i for i in range(SEGMENT)]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for radius in range(SEGMENT + 1):
        # at most 12,870 masks, a literal that is read once per plan
        masks = F.from_json(F.lit(json.dumps([sum(c) for c in itertools.combinations(powers, radius)])), "array<int>")
        probes = (state.filter("open").repartition(parts, *qwords)
                  .select(*qwords, "bound", F.posexplode(_segments(bits, "q")).alias("seg", "own"))
                  .select(*qwords, "bound", "seg", F.explode(masks).alias("mask"), "own")
                  .select(*qwords, "bound", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("value")))
        distance = _distance(n_words, "q", "")
        met = (probes.join(segments.hint("shuffle_hash"), ["seg", "value"])
               .filter(distance <= F.col("bound")).select(*qwords, *words, distance.alias("distance")))
        if kept is not None:
            met = met.unionByName(kept)
        kept = materialize(_best(met.distinct(), index, words, qwords, k), "mih-found")
        covered = m * (radius + 1) - 1
        state = materialize(_bounds(state, kept, index, words, qwords, need)
                            .withColumn("open", F.col("open") & (F.coalesce("kth", F.lit(bits + 1)) > covered))
                            .drop("kth"), "mih-state")
        if covered >= bits or state.filter("open").isEmpty():
            break

    found = (kept.join(index, words)
             .select(*qwords, F.explode("ids").alias("x"), "distance")
             .withColumn("_n", F.row_number().over(Window.partitionBy(*qwords).orderBy("distance", "x")))
             .filter(F.col("_n") <= k).groupBy(*qwords)
             .agg(F.array_sort(F.collect_list(F.struct("distance", "x.last", "x.id"))).alias("found")))
    found = found.select(*[F.col(q).alias(w) for q, w in zip(qwords, words)], "found")
    return _result(asked.join(materialize(found, "mih-results"), words))


def _best(met: DataFrame, index: DataFrame, words: list[str], qwords: list[str], k: int) -> DataFrame:
    """The k codes nearest to each query by (distance, smallest id): every code stands for a
    row at least, so the k nearest rows have their codes among these."""
    first = index.select(*words, F.col("ids")[0].alias("_first"))
    order = Window.partitionBy(*qwords).orderBy("distance", "_first", *words)
    return (met.join(first, words).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k)
            .drop("_n", "_first"))


def _bounds(state: DataFrame, kept: DataFrame, index: DataFrame, words: list[str], qwords: list[str],
            need: int) -> DataFrame:
    """``state`` with the distance of each query's last needed row so far (null: too few)."""
    rows = kept.join(index.select(*words, F.size("ids").alias("_rows")), words)
    so_far = F.sum("_rows").over(Window.partitionBy(*qwords).orderBy("distance"))
    kth = (rows.withColumn("_sum", so_far).filter(F.col("_sum") >= need)
           .groupBy(*qwords).agg(F.min("distance").alias("kth")))
    return (state.join(kth, qwords, "left")
            .withColumn("bound", F.least("bound", F.coalesce("kth", F.col("bound")))))


def _result(answered: DataFrame) -> DataFrame:
    return (answered.select(F.col("id").alias("query_id"), F.posexplode("found").alias("_at", "x"))
            .select("query_id", (F.col("_at") + 1).cast("long").alias("rank"),
                    F.col("x.id").alias("neighbor_id"), F.col("x.distance").cast("long").alias("distance")))
