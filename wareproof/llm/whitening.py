"""Operator 13: whitening of embeddings with distributed block matrices.

Every entry becomes a whole number, sums are taken exactly, and rows are centred before anything is multiplied. The centred rows are
numbered and laid into blocks of a ``BlockMatrix``; its transpose times itself is the scatter, multiplied in splits of the
long dimension so that no task sees all blocks. The covariance, a square of the dimension, goes to the driver for its eigenvectors,
and the blocks times the whitening matrix give the projected rows. Their own covariance is taken the same way for the error.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareproof.llm.common import written
from wareproof.llm.order import numbered

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Rows of a block, and splits of the long dimension: so many products are added up per split before they meet.
BLOCK_ROWS = 1024
SPLIT_BLOCKS = 16
#: Components whose share of the largest eigenvalue is below this are no directions but rounding, and are left out.
LEAST_SHARE = 1e-11


def usable(vector: str) -> Column:
    """Whether a vector has entries and all of them are finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def whole(vector: str) -> Column:
    """The entries as whole numbers."""
    return F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint") + F.lit(SHIFT))


def _sums(rows: DataFrame, array: str) -> list:
    """Sums of the entries by dimension, a row per dimension to the driver."""
    entries = rows.select(F.posexplode(array).alias("j", "c"))
    return [r.s for r in entries.groupBy("j").agg(F.sum("c").alias("s")).orderBy("j").collect()]


def _blocks(rows: DataFrame, array: str, n: int, d: int) -> BlockMatrix:
    """Rows (row, array) in blocks as wide as a row, written once: a product reads its factors several times."""
    frame = MLUtils.convertVectorColumnsFromML(rows.select("row", array_to_vector(array).alias("v")), "v")
    dealt = IndexedRowMatrix(frame, n, d).toBlockMatrix(BLOCK_ROWS, d)
    frame = callMLlibFunc("getMatrixBlocks", dealt._java_matrix_wrapper._java_model)
    stored = written(frame.select(F.col("_1").cast("struct<_1:bigint,_2:bigint>").alias("_1"), "_2"), "blocks")
    return BlockMatrix(callMLlibFunc("createBlockMatrix", stored, BLOCK_ROWS, d, n, d), BLOCK_ROWS, d)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left times right, the common dimension dealt to ``splits`` partitions whose products are then added."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def scatter(blocks: BlockMatrix, n: int) -> np.ndarray:
    """The transpose of the rows times the rows."""
    splits = max(1, -(-n // (BLOCK_ROWS * SPLIT_BLOCKS)))
    local = _product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray()
    return (local + local.T) / 2


def _local_block(spark, matrix: np.ndarray) -> BlockMatrix:
    d, k = matrix.shape
    block = ((0, 0), Matrices.dense(d, k, matrix.flatten(order="F")))
    return BlockMatrix(spark.sparkContext.parallelize([block], 1), d, k)


def components_of(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns: at most ``most``, without those that are rounding."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > LEAST_SHARE * max(values.max(initial=0.0), 0.0)]
    return values[order], vectors[:, order]


def whitened(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, name: str = "whitened",
) -> tuple[DataFrame, dict | None]:
    """(vec_id, ``name`` array of the whitened components, deviation) of every usable row, and the model: ``n``,
    ``dimension``, ``sums``, ``values`` (eigenvalues), ``vectors``, ``explained`` and ``identity_error``. The model is None if no row is usable.

    A vector that is null, empty, or has a null or non-finite entry takes no part; of vectors of several lengths those of the most common one do
    (ties: the longest). A null id is an id like others; rows that share an id, and equal rows, count and are returned each. A dimension
    without variance, or fewer rows than dimensions, give fewer components. If all vectors are equal there are none and the array is empty.
    Other columns are ignored. To the driver come a number per dimension and the covariance, whatever the number of rows. Sums and deviations are exact;
    a deviation beyond 64 bits ends the query.
    """
    spark = table.sparkSession
    rows = table.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("e")).filter(usable("e"))
    rows = rows.select("vec_id", whole("e").alias("x"), F.size("e").alias("d"))
    rows = written(rows.withColumn("tie", F.xxhash64("x")), "whole")
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if sizes is None:
        empty = spark.createDataFrame([], f"vec_id bigint, {name} array<double>, deviation bigint")
        return empty.withColumn("vec_id", F.col("vec_id").cast(table.schema[vec_id].dataType)), None
    n, d = sizes.n, sizes.d
    rows = rows.filter(F.col("d") == d)
    sums = _sums(rows, "x")
    total = F.array(*(F.lit(int(s)) for s in sums))
    apart = F.zip_with("x", total, lambda x, s: x * F.lit(n) - s)
    rows = numbered(rows, ["vec_id", "tie"], "row").select("vec_id", F.col("row").cast("bigint").alias("row"), apart.alias("y"))
    deviation = F.aggregate("y", F.lit(0).cast("bigint"), lambda a, y: a + y * y)
    centred = written(rows.select("vec_id", "row", deviation.alias("deviation"), F.transform("y", lambda y: y / F.lit(float(n))).alias("c")), "centred")
    blocks = _blocks(centred, "c", n, d)
    covariance = scatter(blocks, n) / n
    trace = float(np.trace(covariance))
    values, vectors = components_of(covariance, components)
    model = {"n": n, "dimension": d, "sums": sums, "values": values, "vectors": vectors, "explained": values / trace if trace > 0 else values, "identity_error": 0.0}
    if not len(values):
        return centred.select("vec_id", F.array().cast("array<double>").alias(name), "deviation"), model
    projected = blocks.multiply(_local_block(spark, vectors / np.sqrt(values)))
    found = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    found = MLUtils.convertVectorColumnsToML(found, "vector")
    found = written(found.select(F.col("index").alias("row"), vector_to_array("vector").alias("w")), "projected")
    model["identity_error"] = identity_error(found, n, len(values))
    return centred.join(found, "row").select("vec_id", F.col("w").alias(name), "deviation"), model


def identity_error(projected: DataFrame, n: int, k: int) -> float:
    """The largest entry, without sign, of the covariance of (row, w) minus the identity."""
    means = F.array(*(F.lit(s / n) for s in _sums(projected, "w")))
    centred = projected.select("row", F.zip_with("w", means, lambda w, m: w - m).alias("c"))
    return float(np.abs(scatter(_blocks(centred, "c", n, k), n) / n - np.eye(k)).max())


def whitened_components(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``whitened`` as a row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    found, model = whitened(table, vec_id, vector, components, name="w")
    shares = [] if model is None else model["explained"].tolist()
    explained = F.array(*(F.lit(float(e)) for e in shares)).cast("array<double>")
    rows = found.select("vec_id", "deviation", F.posexplode(F.arrays_zip("w", explained.alias("e"))).alias("j", "z"))
    return rows.select(
        "vec_id", (F.col("j") + 1).cast("int").alias("component"), F.lit(0 if model is None else model["n"]).cast("bigint").alias("n"), "deviation",
        F.col("z.w").alias("whitened"), F.col("z.e").alias("explained"), F.lit(0.0 if model is None else model["identity_error"]).alias("identity_error"),
    )
