"""Whitening of vectors by principal components, on Spark MLlib's block matrices.

Components become integers, whose sums are exact; centred rows get consecutive numbers and become blocks of a
``BlockMatrix`` A.  The scatter matrix is the product of A's transpose and A, of one block per pair of column
blocks, summed over ``splits`` stretches of rows at a time.  Its eigenvectors are found on the driver, as it
has only the square of the dimension entries, and A times the whitening matrix projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sloflow.llm.common import written
from sloflow.llm.query_blocks import usable

SCALE, SHIFT = 64, 1_000_000
MOST = 32
BLOCK_ROWS, BLOCK_COLUMNS = 1024, 1024


def numbered(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` from a written copy with ``index`` 0 to n - 1 without gaps, and n; numbers follow the parts of the copy."""
    placed = written(rows.withColumn("_place", F.monotonically_increasing_id()), name)
    part = F.shiftright("_place", 33)
    # One row per part: as few as the tasks that wrote them.
    counts = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(c for _, c in counts)]).tolist()
    bases = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before[:-1], strict=True)], "_part long, _base long")
    index = F.col("_base") + F.col("_place").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("index", index).drop("_part", "_base", "_place"), before[-1]


def blocks(rows: DataFrame, values: str, n: int, size: int) -> BlockMatrix:
    """A block matrix of ``rows`` (index, array of double)."""
    vectors = rows.select("index", array_to_vector(F.col(values)).alias("vector"))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, size).toBlockMatrix(BLOCK_ROWS, BLOCK_COLUMNS)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The product of the transpose of ``matrix`` and itself, on the driver.

    The inner dimension is split, as otherwise all blocks of a column would meet in one task.
    """
    splits = max(1, min(matrix.numRowBlocks, int(matrix._java_matrix_wrapper._sc.defaultParallelism) * 2, matrix.numRowBlocks // 4))
    java = matrix._java_matrix_wrapper._java_model
    product = BlockMatrix(java.transpose().multiply(java, splits), BLOCK_COLUMNS, BLOCK_COLUMNS)
    found = np.zeros((matrix.numCols(), matrix.numCols()))
    for (i, j), block in product.blocks.toLocalIterator():
        found[i * BLOCK_COLUMNS : i * BLOCK_COLUMNS + block.numRows, j * BLOCK_COLUMNS : j * BLOCK_COLUMNS + block.numCols] = block.toArray()
    return found


def components(variance: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues and their unit eigenvectors as columns; each vector's largest entry is positive.

    Values within rounding of zero become zero.
    """
    values, vectors = np.linalg.eigh((variance + variance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > max(values.max(initial=0), 0) * len(variance) * np.finfo(float).eps * 8, values, 0.0)
    largest = np.abs(vectors).argmax(0)
    return values, vectors * np.sign(vectors[largest, np.arange(len(values))])


def whiten(vectors: DataFrame, most: int = MOST, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per usable row of ``vectors`` (vec_id long, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or has null or non-finite entries are left out, and the others keep their
    repeats; other columns are not looked at.  All vectors must have one size, else it is an error.  An entry c
    becomes ``floor(scale * c) + shift``; an entry or a deviation that does not fit in 64 bits is an error too.  A
    component without variance has whitened null, and identity_error is taken over the others (0 if there are
    none).  No rows give an empty table.
    """
    spark = vectors.sparkSession
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(F.lit(scale) * c) + F.lit(shift))
    good = F.size("embedding") > 0
    rows = vectors.where(usable("embedding") & good).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("x"))
    rows, n = numbered(rows, "whole-vectors")
    if not n:
        return spark.createDataFrame([], ddl)
    least, size = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != size:
        raise ValueError(f"vectors have {least} to {size} entries")
    sums = [r["s"] for r in rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("s")).orderBy("at").collect()]
    total = F.array(*[F.lit(s).cast("long") for s in sums])
    # n * x - S is exact; only its quotient by n is rounded.
    off = F.zip_with("x", total, lambda x, s: F.lit(n).cast("long") * x - s)
    centred = written(
        rows.select("index", "vec_id", off.alias("off")).select(
            "index", "vec_id", F.aggregate("off", F.lit(0).cast("long"), lambda a, d: a + d * d).alias("deviation"),
            F.transform("off", lambda d: d.cast("double") / F.lit(float(n))).alias("c"),
        ),
        "centred-vectors",
    )
    matrix = blocks(centred, "c", n, size)
    variance = scatter(matrix) / n
    values, axes = components(variance, most)
    count = len(values)
    factors = axes / np.sqrt(np.where(values > 0, values, 1.0))
    projection = BlockMatrix(spark.sparkContext.parallelize(_cut(factors)), BLOCK_COLUMNS, BLOCK_COLUMNS, size, count)
    product = matrix.multiply(projection)
    indexed = product.toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", indexed._java_matrix_wrapper._java_model)
    found = written(MLUtils.convertVectorColumnsToML(found, "vector").select("index", vector_to_array("vector").alias("z")), "projected-vectors")
    error = _identity_error(found, values, n)
    trace = float(np.trace(variance))
    shares = [float(v / trace) if trace > 0 else 0.0 for v in values]
    told = F.array(*[F.struct(F.lit(i + 1).alias("component"), F.lit(float(v) > 0).alias("real"), F.lit(s).alias("explained")) for i, (v, s) in enumerate(zip(values, shares, strict=True))])
    return (
        centred.select("index", "vec_id", "deviation")
        .join(found, "index")
        .select("vec_id", "deviation", F.explode(F.arrays_zip("z", told.alias("told"))).alias("e"))
        .select(
            "vec_id", F.col("e.told.component").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
            F.when(F.col("e.told.real"), F.col("e.z")).alias("whitened"), F.col("e.told.explained").alias("explained"), F.lit(error).alias("identity_error"),
        )
    )


def _cut(factors: np.ndarray) -> list:
    """The blocks of a small matrix."""
    found = []
    for i in range(0, factors.shape[0], BLOCK_COLUMNS):
        for j in range(0, factors.shape[1], BLOCK_COLUMNS):
            part = factors[i : i + BLOCK_COLUMNS, j : j + BLOCK_COLUMNS]
            found.append(((i // BLOCK_COLUMNS, j // BLOCK_COLUMNS), DenseMatrix(*part.shape, part.ravel(order="F").tolist())))
    return found


def _identity_error(found: DataFrame, values: np.ndarray, n: int) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    count = len(values)
    means = found.select(F.posexplode("z").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).orderBy("at").collect()
    middle = F.array(*[F.lit(r["m"]) for r in means])
    off = found.select("index", F.zip_with("z", middle, lambda v, m: v - m).alias("z"))
    covariance = scatter(blocks(off, "z", n, count)) / n
    real = values > 0
    return float(np.abs((covariance - np.eye(count))[np.ix_(real, real)]).max(initial=0.0))
