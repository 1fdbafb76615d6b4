"""Embedding whitening with MLlib's block matrices.

Entries become whole numbers (256 steps to one). The distinct vectors are numbered and centred, laid out as a
distributed BlockMatrix, and multiplied with their own transpose; the scatter matrix, as wide as a vector, comes to
the driver for the eigenvectors. The whitening matrix is a BlockMatrix again, and one multiplication projects all rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from habitscope.llm.common import written

STEPS, COMPONENTS = 256, 4
ROWS, COLUMNS = 4096, 1024
_IN_PARTITION = (1 << 33) - 1  # monotonically_increasing_id keeps the place within a partition in its lower 33 bits

SCHEMA = (
    "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
)


def usable(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector.cast("array<double>"), bad)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """The rows with ``index`` from 0 without gaps, written: places within the written partitions, and their offsets.

    Only one count for each partition is ordered in one place.
    """
    held = written(rows.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    counts = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows")).orderBy("_part").collect()
    offsets, before = [], 0
    for r in counts:
        offsets.append((r["_part"], before))
        before += r["_rows"]
    offsets = held.sparkSession.createDataFrame(offsets, "_part long, _before long")
    placed = held.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn("index", F.col("_before") + F.col("_at").bitwiseAND(_IN_PARTITION)).drop("_at", "_part", "_before")


def scatter(blocks: BlockMatrix) -> np.ndarray:
    """transpose * blocks as a local matrix. The middle dimension is split into the row blocks, so that no task gets
    them all; the Python method has no argument for that, so the Scala one is called."""
    turned = blocks.transpose()
    splits = max(1, blocks.numRowBlocks)
    product = turned._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, turned.rowsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def whitening(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors over their roots, as columns; directions without variance are out."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > 16 * len(cov) * np.finfo(float).eps * max(np.trace(cov), 0.0)
    values, vectors = values[real][:components], vectors[:, real][:, :components]
    return values, vectors / np.sqrt(values)


def _block_matrix(spark, local: np.ndarray, rows: int, columns: int) -> BlockMatrix:
    blocks = [
        ((i // rows, j // columns), Matrices.dense(*part.shape, part.ravel(order="F")))
        for i in range(0, local.shape[0], rows)
        for j in range(0, local.shape[1], columns)
        for part in [local[i : i + rows, j : j + columns]]
    ]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), rows, columns, *local.shape)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, rows_per_block: int = ROWS, columns_per_block: int = COLUMNS
) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: rows for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are left out. An entry c becomes floor(256 * c), held to
    the range of a long. Vectors shorter than the longest one have zeros at their end. The fit is over the ``n``
    distinct vectors, each once. A direction without variance is no component, so with one distinct vector, without
    entries or without vectors there are no rows. deviation is null where it is no long. Rows that repeat a vec_id, or
    have none, each have their own rows; columns other than vec_id and embedding are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["vec_id"].dataType.simpleString()
    entry = lambda c: F.floor(c * STEPS).cast("long")
    rows = vectors.where(usable(F.col("embedding"))).select(
        "vec_id", F.transform(F.col("embedding").cast("array<double>"), entry).alias("x")
    )
    nothing = spark.createDataFrame([], SCHEMA.format(kind))
    shape = rows.agg(F.max(F.size("x")).alias("most"), F.min(F.size("x")).alias("least")).first()
    width = shape["most"] or 0
    if not width:
        return nothing
    if shape["least"] < width:
        zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))
        rows = rows.withColumn("x", F.concat("x", zeros))
    # A hash goes before the vector in every comparison; equality is on the vector.
    rows = rows.withColumn("h", F.xxhash64("x"))
    distinct = numbered(rows.select("h", "x").distinct(), "distinct-vectors")

    entries = distinct.select(F.posexplode("x").alias("at", "c"))
    sums = entries.groupBy("at").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("total"), F.count("*").alias("n")).collect()
    n = sums[0]["n"]
    totals = [0] * width
    for r in sums:
        totals[r["at"]] = int(r["total"])
    means = F.array(*[F.lit(t / n) for t in totals])
    centred = distinct.select("index", F.zip_with("x", means, lambda c, m: c.cast("double") - m).alias("centred"))
    frame = centred.select("index", array_to_vector("centred").alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(frame, "vector"), n, width)
    blocks = indexed.toBlockMatrix(rows_per_block, columns_per_block)

    cov = scatter(blocks) / n
    cov = (cov + cov.T) / 2
    values, matrix = whitening(cov, components)
    if not len(values):
        return nothing
    explained = values / np.trace(cov)
    projected = blocks.multiply(_block_matrix(spark, matrix, columns_per_block, columns_per_block))
    whitened = written(
        projected.toIndexedRowMatrix()
        .rows.map(lambda r: (r.index, r.vector.toArray().tolist()))
        .toDF("index long, whitened array<double>"),
        "projected-vectors",
    )

    # identity_error: the covariance of what came out, centred before multiplying, against the identity.
    column = lambda k: F.get("whitened", F.lit(k))
    count = len(values)
    middle = whitened.agg(*[F.avg(column(k)).alias(f"m{k}") for k in range(count)]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    product = lambda i, j: (column(i) - middle[i]) * (column(j) - middle[j])
    second = whitened.agg(*[F.sum(product(i, j)).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(second[k] / n - (i == j)) for k, (i, j) in enumerate(pairs))

    whole = [t if abs(t) < 1 << 63 else None for t in totals]
    sums_of = F.array(*[F.lit(t).cast("long") for t in whole])
    off = F.zip_with("x", sums_of, lambda c, s: F.try_subtract(F.try_multiply(c, F.lit(n).cast("long")), s))
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda s, d: F.try_add(s, F.try_multiply(d, d)))
    # Written, so that the join of a vector that very many rows share can be split.
    named = written(distinct.join(whitened, "index").select("h", "x", deviation.alias("deviation"), "whitened"), "whitened-vectors")
    shares = F.array(*[F.lit(float(e)) for e in explained])
    out = rows.join(named, ["h", "x"]).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
