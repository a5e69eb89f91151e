"""Embedding whitening with distributed block matrices.

Rows get consecutive numbers and become an IndexedRowMatrix of centred rows, cut into blocks of rows. The
transposed block matrix times itself is the scatter matrix, of which one d x d matrix reaches the driver
for its eigenvectors; the block matrix times the whitening matrix projects all rows.

The middle dimension of the scatter product (the rows) is dealt to many tasks, each of which sums the
products of its blocks; so no task gets all blocks of the one result block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seaglint.llm.common import give_back, materialise, prepare

COMPONENTS = 32
#: x = floor(STEPS * entry) + SHIFT.
STEPS, SHIFT = 64, 1_000_000
#: Numbers in a block: 1 MB.
BLOCK = 1 << 17


def usable(vector: Column) -> Column:
    """Whether a vector is there, has entries, and all of them are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def whole_numbers(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """index (from 0, without gaps), id and x (array<long>) of the usable vectors of the commonest length."""
    vector = F.col(vector_col)
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS) + F.lit(SHIFT).cast("long"))
    good = vectors.where(usable(vector)).select(F.col(id_col).alias("id"), x.alias("x"))
    lengths = good.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    rows = materialise(good.where(F.size("x") == (lengths["d"] if lengths else 0)).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # One row for each partition, as many as the scan has tasks.
    counts = sorted(rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).toPandas().itertuples(index=False))
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(int(p), at) for (p, _), at in zip(counts, before)], "part long, before long")
    numbered = rows.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.select((F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("index"), "id", "x")


def column_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each entry of ``x``."""
    prepare(rows.sparkSession)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
                total, n = total + x.sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total))), pa.array([n, *total.tolist()])], names=["place", "value"])
        give_back()

    sums = rows.select("x").mapInArrow(add, "place long, value long").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    return (sums[0]["value"], [r["value"] for r in sums[1:]]) if sums else (0, [])


def block_matrix(rows: DataFrame, n: int, d: int) -> BlockMatrix:
    """Rows ``index`` and ``row`` (array<double>) as blocks of whole rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("row").alias("row")), "row")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(max(1, BLOCK // d), d)


def product(left: BlockMatrix, right: BlockMatrix, splits: int = 1) -> BlockMatrix:
    """left x right; the middle dimension is dealt to ``splits`` tasks for each block of the result."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def covariance(rows: DataFrame, blocks: BlockMatrix, n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of rows that are centred."""
    splits = max(1, min(blocks.numRowBlocks, max(rows.sparkSession.sparkContext.defaultParallelism, blocks.numRowBlocks // 64)))
    return product(blocks.transpose(), blocks, splits).toLocalMatrix().toArray() / n


def local_blocks(rows: DataFrame, values: np.ndarray) -> BlockMatrix:
    """A small matrix as one block."""
    one = rows.sparkSession.sparkContext.parallelize([((0, 0), Matrices.dense(*values.shape, values.ravel(order="F")))], 1)
    return BlockMatrix(one, *values.shape)


def indexed_rows(blocks: BlockMatrix) -> DataFrame:
    """index and row (array<double>) of each row of a block matrix."""
    rows = callMLlibFunc("getIndexedRows", blocks.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("row"))


def whitened_sums(rows: DataFrame, d: int) -> list[float]:
    return list(rows.agg(*[F.sum(F.get("row", F.lit(i))).alias(f"c{i}") for i in range(d)]).first())


def less_mean(rows: DataFrame, means: list[float]) -> DataFrame:
    centre = F.array(*map(F.lit, means))
    return rows.select("index", F.zip_with("row", centre, lambda a, m: a - m).alias("row"))


def whiten(vectors: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained, identity_error, a row for each usable vector and component.

    Vectors that are null, empty, or hold null or non-finite entries are dropped, and those of another
    length than the commonest one (of equally common ones the longest). Ids may repeat or be null; each row
    is one of its own. Other columns are not looked at. Without usable vectors there are no rows. A
    direction without variance (no more than rounding) has whitened 0 and explained 0, and is left out of
    identity_error. ``deviation`` is exact; a sum beyond 64 bits stops with an overflow error.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    shape = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    numbered = whole_numbers(vectors, vector_col, id_col)
    n, sums = column_sums(numbered)
    if not n:
        return spark.createDataFrame([], shape)
    d = len(sums)
    # n * x - S is a whole number: its squares add up exactly, and divided by n it is the centred entry.
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: x * F.lit(n).cast("long") - s)
    centred = materialise(numbered.select("index", "id", apart.alias("apart"))).select(
        "index", "id",
        F.aggregate("apart", F.lit(0).cast("long"), lambda t, a: t + a * a).alias("deviation"),
        F.transform("apart", lambda a: a.cast("double") / n).alias("row"),
    )
    blocks = block_matrix(centred, n, d)
    scatter = covariance(centred, blocks, n)
    values, directions = np.linalg.eigh(scatter)
    values, directions = values[::-1][:components], directions[:, ::-1][:, :components]
    trace = float(np.trace(scatter))
    real = values > trace * d * np.finfo(float).eps
    scale = np.where(real, 1 / np.sqrt(np.where(real, values, 1)), 0)
    projected = indexed_rows(product(blocks, local_blocks(centred, directions * scale)))
    whitened = materialise(projected)
    means = [r / n for r in whitened_sums(whitened, len(values))]
    again = less_mean(whitened, means)
    identity = covariance(again, block_matrix(again, n, len(values)), n) - np.eye(len(values))
    error = float(np.abs(identity[np.ix_(real, real)]).max(initial=0))
    explained = np.where(real, values / (trace or 1), 0)
    return (
        centred.select("index", "id", "deviation")
        .join(whitened, "index")
        .select("id", "deviation", F.posexplode("row").alias("place", "whitened"))
        .select(
            F.col("id").alias(id_col),
            (F.col("place") + 1).cast("int").alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(F.array(*map(F.lit, explained.tolist())), F.col("place")).alias("explained"),
            F.lit(error).alias("identity_error"),
        )
    )
