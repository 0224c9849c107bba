"""Operator 13: whitening of embeddings with MLlib's BlockMatrix.

Components are fixed to whole numbers first (``floor(64 c) + 1000000``), so equal vectors are
equal numbers and the sums behind the centre are exact. The fit list holds each distinct
vector once. Its centred rows are indexed into a distributed block matrix ``A``; the scatter
is ``transpose(A) * A``, split along the rows so that no task multiplies more than a few
blocks; the eigenvectors come from a local ``eigh`` of that dims x dims matrix, which does not
grow with the rows. All rows, centred the same way, are a second block matrix, and its product
with the whitening matrix projects them. Rows are indexed without gaps from the place where
they were written: one offset per written partition is all that is broadcast.

Defined cases: rows whose vector is null or holds null, NaN or infinite entries are dropped; a
shorter vector counts as ending in zeros; repeated rows are all returned, and count once in
the fit; null and repeated keys are kept (rows are matched by place, not by key); an empty
table, or one of empty vectors, gives an empty result; fewer dimensions than components give
as many components as dimensions; a component without variance has a null ``whitened`` and
stands outside ``identity_error``; input columns named like an output column are replaced, all
others are returned. A deviation beyond a long is an error (ANSI arithmetic), never a wrapped
number.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexicorn.llm.common import materialize, without

SCALE, SHIFT = 64, 1_000_000
#: rows of a block: 512 KB of 64 doubles each
BLOCK_ROWS = 1024
#: middle blocks that one task of a product multiplies
BLOCKS_PER_TASK = 4
#: an eigenvalue below this part of the largest is none
RANK_TOLERANCE = 1e-12
OUT = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    c = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))


def grid(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long"))


def _indexed(rows: DataFrame) -> DataFrame:
    """``rows``, written with ``mid``, and their gapless ``index``. Offsets: a row a partition."""
    part = F.shiftright("mid", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    place = F.col("mid") - F.shiftleft("part", 33)
    return (rows.withColumn("part", part).join(F.broadcast(offsets), "part")
            .withColumn("index", F.col("offset") + place).drop("part", "offset", "mid"))


def _written(rows: DataFrame, name: str) -> DataFrame:
    """Written once with the place of every row; a filter after the write would leave gaps."""
    return materialize(rows.withColumn("mid", F.monotonically_increasing_id()), name)


def _blocks(rows: DataFrame, n_rows: int, dims: int) -> BlockMatrix:
    """(index, centred) as a block matrix."""
    vectors = rows.select("index", array_to_vector("centred").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n_rows, dims)
    return matrix.toBlockMatrix(BLOCK_ROWS, dims)


def _gram(a: BlockMatrix) -> np.ndarray:
    """transpose(a) * a. The middle dimension is split (an argument that the Python wrapper
    lacks), or one task would get every block."""
    splits = max(1, math.ceil(a.numRowBlocks / BLOCKS_PER_TASK))
    product = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, a.colsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def _local(spark, matrix: np.ndarray) -> BlockMatrix:
    """A small local matrix as one block."""
    rows = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(matrix)], "index long, centred array<double>")
    vectors = rows.select("index", array_to_vector("centred").alias("vector"))
    return (IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), *matrix.shape)
            .toBlockMatrix(matrix.shape[0], matrix.shape[1]))


def _empty(df: DataFrame, names: list[str]) -> DataFrame:
    return (df.select(*names).filter(F.lit(False))
            .select("*", F.lit(None).cast("int").alias("component"), F.lit(None).cast("long").alias("n"),
                    F.lit(None).cast("long").alias("deviation"),
                    *[F.lit(None).cast("double").alias(c) for c in OUT[3:]]))


def whiten(df: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """A row per remaining row of ``df`` and component: the input's columns without the vector,
    then ``component`` (from 1), ``n`` (size of the fit list), ``deviation`` (exact sum over
    dimensions of ``(n x - S)^2``), ``whitened``, ``explained`` and ``identity_error``."""
    spark = df.sparkSession
    names = [c for c in without(df, OUT).columns if c.lower() != vector.lower()]
    rows = _written(df.filter(finite(F.col(vector))).select(F.struct(*names).alias("row"), grid(F.col(vector)).alias("x")),
                    "whitening-rows")
    seen = rows.agg(F.max(F.size("x")).alias("dims"), F.count("*").alias("rows")).first()
    dims = seen["dims"]
    if not dims:
        return _empty(df, names)
    zero = F.lit(SHIFT).cast("long")
    padded = F.concat("x", F.array_repeat(zero, F.lit(dims) - F.size("x")))
    rows = rows.withColumn("x", padded)
    # equal vectors meet map-side first, so a vector of a third of all rows costs a row a task
    fit = _written(rows.select("x").distinct(), "whitening-fit")
    known = fit.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[d]).alias(f"s{d}") for d in range(dims)]).first()
    n, sums = known["n"], F.array(*[F.lit(known[f"s{d}"]).cast("long") for d in range(dims)])
    off = F.zip_with("x", sums, lambda x, s: x * F.lit(n).cast("long") - s)
    centred = F.transform("off", lambda o: o / F.lit(float(n)))

    a = _blocks(_indexed(fit).withColumn("off", off).select("index", centred.alias("centred")), n, dims)
    a.persist(StorageLevel.MEMORY_AND_DISK)  # three products read it; a lost block is made again
    cov = _gram(a) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    order = np.argsort(values)[::-1][:components]
    values, vectors = values[order], vectors[:, order]
    # either sign would do; the entry of the greatest size is made positive
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)
    live = values > max(values[0], 0.0) * RANK_TOLERANCE
    whitening = _local(spark, vectors * np.where(live, 1 / np.sqrt(np.where(live, values, 1.0)), 0.0))

    total = float(np.trace(cov))
    made = _gram(a.multiply(whitening)) / n
    error = float(np.abs((made - np.eye(len(values)))[np.ix_(live, live)]).max()) if live.any() else 0.0
    a._java_matrix_wrapper._java_model.blocks().unpersist(False)
    every = _indexed(rows).withColumn("off", off)
    projected = _blocks(every.select("index", centred.alias("centred")), seen["rows"], dims).multiply(whitening)
    back = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    back = back.select("index", vector_to_array("vector").alias("whitened"))
    deviation = F.aggregate("off", F.lit(0).cast("long"), lambda t, o: t + o * o)
    parts = F.array(*[F.struct(F.lit(k + 1).alias("component"), F.lit(bool(live[k])).alias("live"),
                               F.lit(float(values[k]) / total if total > 0 else 0.0).alias("explained"))
                      for k in range(len(values))])
    return (every.select("index", "row", deviation.alias("deviation")).join(back, "index")
            .select("row", "deviation", "whitened", F.explode(parts).alias("part"))
            .select("row.*", F.col("part.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                    F.when(F.col("part.live"), F.element_at("whitened", F.col("part.component"))).alias("whitened"),
                    F.col("part.explained").alias("explained"), F.lit(error).alias("identity_error")))
