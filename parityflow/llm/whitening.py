"""Whitening of embeddings with distributed block matrices.

Components c become the whole numbers x = floor(64 c) + 1000000. The fit list, every distinct
vector once, is centred and indexed into a BlockMatrix; its transpose times itself is the scatter,
which is split over the inner dimension so that no task multiplies more than its share of the
blocks. The eigenvectors of the covariance (dimensions x dimensions) come from a local ``eigh``, and
a second BlockMatrix product with the whitening matrix projects the rows. Distinct vectors, sums,
scatter and projections cover all rows; only matrices of dimensions x dimensions reach the driver.

Vectors that are null or hold entries that are null, not finite or beyond 2^56 (no long holds their
x) take no part, nor do those of another length than the commonest (of equally common ones the
longest). Directions without variance, which one vector alone or equal rows have, cannot be whitened
and give no rows, so fewer components than asked for may come back. Repeated rows are each projected,
rows without an id too. ``deviation`` is exact; it is null where no long holds it. An empty table
gives an empty table, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parityflow.session import materialised

SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 56)
BLOCK_ROWS = 1024
SEGMENT_ROWS = 1 << 28  #: rows of one matrix; row numbers of a block matrix are ints, and its block list goes to the driver
MOST_SPLITS = 2048
COMPONENTS = 16
FLAT = 1e-12  #: share of the total variance below which a direction counts as flat

OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id, x`` of the rows that take part."""
    e = F.col(f"`{embedding}`").cast("array<double>")
    sound = F.col(f"`{embedding}`").isNotNull() & ~F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    x = F.transform(e, lambda c: F.floor(c * SCALE) + F.lit(SHIFT))
    rows = vectors.filter(sound & (F.size(e) > 0)).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x"))
    commonest = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("x") == (commonest.d if commonest else 0))


def indexed(rows: DataFrame) -> DataFrame:
    """``index`` from 0 on without gaps. Rows are written with their place in their task; places are lifted by the tasks before."""
    written = materialised(rows.withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    sizes = written.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("held"))  # a row a task
    before = F.coalesce(F.sum("held").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lifted = written.join(F.broadcast(sizes.select("task", before.alias("before"))), task == F.col("task"))
    return lifted.select((F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("index"), *rows.columns)


@dataclass
class Moments:
    """Sums of the fit list."""

    n: int
    sums: list[int]
    reach: int  #: no entry of n*x - S is farther from 0

    @staticmethod
    def of(fit: DataFrame) -> Moments | None:
        x = F.col("x")
        span = fit.agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min(x)).alias("low"), F.max(F.array_max(x)).alias("high"), F.max(F.size(x)).alias("d")).first()
        if not span.n:
            return None
        wide = span.n * max(abs(span.low), abs(span.high)) >= 1 << 63
        sums = fit.agg(*[F.sum(x[i].cast("decimal(20,0)") if wide else x[i]).alias(f"s{i}") for i in range(span.d)]).first()
        sums = [int(s) for s in sums]
        return Moments(span.n, sums, max(max(abs(span.n * span.low - s), abs(span.n * span.high - s)) for s in sums))

    def centred(self, x: Column) -> Column:
        """x - S/n; whole and fractional part of S/n go apart, so that large x lose nothing."""
        whole = F.array(*[F.lit(s // self.n) for s in self.sums])
        part = F.array(*[F.lit((s % self.n) / self.n) for s in self.sums])
        return F.zip_with(F.zip_with(x, whole, lambda a, b: (a - b).cast("double")), part, lambda a, b: a - b)

    def deviation(self, x: Column) -> Column:
        """The sum of (n*x - S)^2, in longs where they hold it for sure, else in decimals."""
        if len(self.sums) * self.reach**2 < 1 << 63:
            off = F.zip_with(x, F.array(*[F.lit(s) for s in self.sums]), lambda a, s: a * F.lit(self.n) - s)
            return F.aggregate(off, F.lit(0).cast("long"), lambda total, v: total + v * v)
        exact = "decimal(38,0)"
        sums = F.array(*[F.lit(str(s)).cast(exact) for s in self.sums])
        off = F.zip_with(x, sums, lambda a, s: (a.cast("decimal(19,0)") * F.lit(self.n).cast("decimal(18,0)") - s).cast(exact))
        total = F.aggregate(off, F.lit(0).cast(exact), lambda t, v: F.try_add(t, F.try_multiply(v, v)).cast(exact))
        return total.try_cast("long")


def segments(rows: DataFrame, n: int) -> Iterator[tuple[int, int, DataFrame]]:
    """Runs of at most ``SEGMENT_ROWS`` indexed rows, numbered from 0 again, with their first index and length."""
    for start in range(0, n, SEGMENT_ROWS):
        held = min(SEGMENT_ROWS, n - start)
        part = rows if held == n else rows.filter((F.col("index") >= start) & (F.col("index") < start + held))
        yield start, held, part.withColumn("index", F.col("index") - F.lit(start))


def block_matrix(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """``index, values`` as a matrix of blocks of rows; the vectors stay in the JVM."""
    vectors = rows.select("index", array_to_vector("values").alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, dims).toBlockMatrix(BLOCK_ROWS, dims)


def scatter(matrix: BlockMatrix, n: int) -> np.ndarray:
    """Transpose times matrix. Its only block is added up from parts of the inner dimension, each multiplied by its own task."""
    splits = min(MOST_SPLITS, -(-n // BLOCK_ROWS))
    left = matrix.transpose()
    # the product with a number of splits of the inner dimension is public in the JVM only
    product = left._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def times(matrix: BlockMatrix, directions: np.ndarray, spark) -> BlockMatrix:
    """Matrix times ``directions`` (dimensions x components), which go to the blocks as one block."""
    d, k = directions.shape
    block = Matrices.dense(d, k, directions.ravel(order="F").tolist())
    return matrix.multiply(BlockMatrix(spark.sparkContext.parallelize([((0, 0), block)], 1), d, k))


def matrix_rows(matrix: BlockMatrix) -> DataFrame:
    """``index, z`` of the rows of a matrix, without a way through Python."""
    indexed_rows = matrix.toIndexedRowMatrix()  # its JVM side goes with it, so it is held until the rows are
    rows = callMLlibFunc("getIndexedRows", indexed_rows._java_matrix_wrapper._java_model)
    return MLUtils.convertVectorColumnsToML(rows, "vector").select("index", vector_to_array("vector").alias("z"))


@dataclass
class Whitening:
    """A fitted whitening: unit directions by falling variance, and the matrix that projects and scales at once."""

    moments: Moments
    variances: np.ndarray
    total: float
    matrix: np.ndarray
    identity_error: float


def fit_whitening(x_rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct vectors of ``x``; None where nothing varies."""
    spark = x_rows.sparkSession
    fit = indexed(x_rows.select("x").distinct())
    m = Moments.of(fit)
    if m is None:
        return None
    d = len(m.sums)
    values = fit.select("index", m.centred(F.col("x")).alias("values"))
    parts = [(block_matrix(rows, held, d), held) for _, held, rows in segments(values, m.n)]
    covariance = sum(scatter(part, held) for part, held in parts) / m.n
    variances, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    total = float(np.trace(covariance))
    kept = [i for i in range(d)[::-1][:components] if total > 0 and variances[i] > FLAT * total]
    if not kept:
        return None
    matrix = vectors[:, kept] / np.sqrt(variances[kept])
    white = sum(scatter(times(part, matrix, spark), held) for part, held in parts) / m.n
    return Whitening(m, variances[kept], total, matrix, float(np.abs(white - np.eye(len(kept))).max()))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row per vector that takes part and component: the whitened value and what the fit says of its direction."""
    spark = vectors.sparkSession
    rows = indexed(whole_vectors(vectors, vec_id, embedding))
    w = fit_whitening(rows.select("x"), components)
    if w is None:
        return spark.createDataFrame([], OUT)
    d = len(w.moments.sums)
    values = rows.select("index", w.moments.centred(F.col("x")).alias("values"))
    made = None
    for start, held, part in segments(values, rows.count()):
        z = matrix_rows(times(block_matrix(part, held, d), w.matrix, spark)).withColumn("index", F.col("index") + F.lit(start))
        made = z if made is None else made.union(z)
    told = rows.select("index", "vec_id", w.moments.deviation(F.col("x")).alias("deviation"))
    explained = F.array(*[F.lit(float(v) / w.total) for v in w.variances])
    each = told.join(made, "index").select("vec_id", "deviation", F.posexplode("z").alias("i", "whitened"))
    return each.select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(w.moments.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("i")).alias("explained"),
        F.lit(w.identity_error).alias("identity_error"),
    )
