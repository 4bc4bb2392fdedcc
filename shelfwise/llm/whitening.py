"""Whitening of embeddings with distributed block matrices.

Components of a vector are put on a grid of whole numbers, so sums over all vectors are exact and
equal vectors meet. Each distinct vector counts once: centred, indexed and cut into the blocks of
a ``BlockMatrix`` X. X'X is the scatter, its eigenvectors are found locally (dimensions x
dimensions, whatever the number of vectors), and X times the whitening matrix projects the rows.
"""

import math
from functools import reduce

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import materialise

#: The grid: a component c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: The scatter and its eigenvectors are held by the driver: at most this many squared.
MAX_DIMENSIONS = 4096
#: Bytes of a block of rows, and about those of the blocks that one task of a product may hold.
BLOCK_BYTES, TASK_BYTES = 512 << 10, 128 << 20
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def on_grid(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def gapless(scan: DataFrame, name: str) -> DataFrame:
    """Number the rows of a written table from 0: places in a file after the rows of the files
    before it. Only one count a file meets in one task."""
    place = scan.metadataColumn("_metadata")
    rows = scan.withColumns({"__file": place["file_path"], "__at": place["row_index"]})
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__file").agg(F.count("*").alias("__n")).select(
        F.col("__file").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    joined = rows.join(starts, F.col("__file") == F.col("__of"))
    return joined.withColumn(name, F.col("__start") + F.col("__at")).drop("__file", "__at", "__of", "__start")


def _product(a: BlockMatrix, b: BlockMatrix, splits: int) -> BlockMatrix:
    """a x b, with the blocks that add up to one block of the result dealt over ``splits`` tasks,
    an argument that only the matrix on the JVM's side takes."""
    made = a._java_matrix_wrapper.call("multiply", b._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, a.rowsPerBlock, b.colsPerBlock)


def _scatter(x: BlockMatrix, splits: int) -> np.ndarray:
    return _product(x.transpose(), x, splits).toLocalMatrix().toArray()


class _Slab:
    """Consecutive rows as one BlockMatrix. A BlockMatrix deals its grid over the square root of
    its partitions, so a slab has as many blocks as keep a task's share within TASK_BYTES."""

    def __init__(self, indexed: DataFrame, low: int, rows: int, dim: int, per_block: int):
        blocks = -(-rows // per_block)
        part = indexed.where((F.col("index") >= low) & (F.col("index") < low + rows))
        vectors = part.select((F.col("index") - low).alias("index"), array_to_vector("centred").alias("vector")).repartition(min(blocks, 4096), "index")
        matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), rows, dim)
        self.low, self.blocks, self.splits = low, matrix.toBlockMatrix(per_block, dim), max(1, math.isqrt(blocks))

    def scatter(self) -> np.ndarray:
        return _scatter(self.blocks, self.splits)

    def times(self, weights: np.ndarray) -> BlockMatrix:
        d, k = weights.shape
        one = self.blocks._java_matrix_wrapper._sc.parallelize([((0, 0), DenseMatrix(d, k, weights.flatten("F").tolist()))], 1)
        return _product(self.blocks, BlockMatrix(one, d, k), 1)


def _slabs(indexed: DataFrame, n: int, dim: int) -> list[_Slab]:
    per_block = max(1, BLOCK_BYTES // (8 * dim))
    rows = per_block * max(1, (TASK_BYTES // (8 * dim * per_block)) ** 2)
    return [_Slab(indexed, low, min(rows, n - low), dim, per_block) for low in range(0, n, rows)]


def _rows_of(matrix: BlockMatrix, low: int) -> DataFrame:
    """(index, projected) without a detour through Python."""
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    plain = MLUtils.convertVectorColumnsToML(rows, "vector")
    return plain.select((F.col("index") + low).alias("index"), vector_to_array("vector").alias("projected"))


def whitening_matrix(scatter: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions x k projection over the root of the eigenvalue, k shares of the variance) by
    falling eigenvalue. Directions without variance, up to rounding, have no component. The sign
    makes the largest entry of an eigenvector positive."""
    cov = (scatter + scatter.T) / (2 * n)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > max(e[0], 0) * len(e) * np.finfo(float).eps * 4).sum())) if e[0] > 0 else 0
    e, v = e[:k], v[:, :k]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    return v / np.sqrt(e), e / np.trace(cov)


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1), n, deviation, whitened,
    explained, identity_error.

    Vectors that are null, empty or hold null or non-finite entries are left out; repeated rows and
    null ids are kept and get rows like any others, equal vectors the same values. Extra columns
    are ignored, and no name of theirs clashes. An empty table, or one distinct vector only, has no
    components and gives no rows. Vectors of unequal length are an error, as are more dimensions
    than MAX_DIMENSIONS, and sums of squares past 64 bits.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("vector")).where(usable(F.col("vector")))
    rows = materialise(kept.select("vec_id", on_grid(F.col("vector")).alias("x")), "grid-rows")
    fit = materialise(rows.select("x").distinct(), "grid-vectors")
    n, low, dim = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != dim:
        raise ValueError(f"vectors of {low} and of {dim} entries have no common covariance")
    if n == 0:
        return spark.createDataFrame([], SCHEMA)
    if dim > MAX_DIMENSIONS:
        raise ValueError(f"{dim} dimensions; at most {MAX_DIMENSIONS}")
    by_place = fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("total"))
    totals = F.lit([r.total for r in by_place.orderBy("pos").collect()])  # one number a dimension

    apart = F.zip_with("x", totals, lambda x, s: x * n - s)
    squares = F.aggregate("apart", F.lit(0).cast("long"), lambda a, d: a + d * d)
    numbered = gapless(fit, "index").withColumn("apart", apart)
    indexed = materialise(numbered.select("index", "x", squares.alias("deviation"), F.transform("apart", lambda d: d / F.lit(n)).alias("centred")), "centred")

    slabs = _slabs(indexed, n, dim)
    weights, shares = whitening_matrix(sum(s.scatter() for s in slabs), n, components)
    k = weights.shape[1]
    if k == 0:
        return spark.createDataFrame([], SCHEMA)
    products = [(s, s.times(weights)) for s in slabs]
    spread = sum(_scatter(w, s.splits) for s, w in products) / n
    error = float(np.abs(spread - np.eye(k)).max())
    projected = reduce(DataFrame.unionByName, (_rows_of(w, s.low) for s, w in products))
    fitted = materialise(indexed.select("index", "x", "deviation").join(projected, "index").drop("index"), "projected")
    explained = F.element_at(F.lit([float(s) for s in shares]), F.col("pos") + 1)
    out = rows.join(fitted, "x").select("vec_id", "deviation", F.posexplode("projected").alias("pos", "whitened"))
    return out.select(
        "vec_id", (F.col("pos") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
