"""Principal components of tables with very many columns.

The covariance is never built. A pass over the rows multiplies it with a block of a few vectors: every task adds up its
rows' share, Spark sums the shares of each slot, and only matrices of width by block travel. The blocks span a growing
space (a block Lanczos iteration from a random block, restarted with the best directions found), in which the leading
components are determined until they leave no residual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from impactrec.operators.reduce import Components, cumulative_variance
from impactrec.operators.sparse import vector_cells

_CHUNK = 1 << 21
#: Numbers in the matrices that the driver holds at once (8 bytes each).
DRIVER_NUMBERS = 1 << 28


def _listed(column: str) -> Column:
    """A vector's cells with empty lists for NULL ones, as which a dense vector's indices and a NULL vector are stored.

    Arrow's writer takes many times as long over a NULL list as over an empty one.
    """
    cells = F.col(column)
    return F.struct(
        F.coalesce(cells["type"], F.lit(0).cast("tinyint")).alias("type"),
        F.coalesce(cells["indices"], F.array().cast("array<int>")).alias("indices"),
        F.coalesce(cells["values"], F.array().cast("array<double>")).alias("values"),
    ).alias(column)


class _Batch:
    """Some rows as the slots set, their values, and where each row ends; ``dense`` if every slot is given."""

    def __init__(self, cells: pa.StructArray, width: int):
        values, indices = cells.field("values"), cells.field("indices")
        self.n = len(cells)
        given = cells.field("type").to_numpy(zero_copy_only=False) == 1
        self.ends = np.cumsum(values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        self.values = values.flatten().to_numpy(zero_copy_only=False)
        self.dense = bool(given.all()) and len(self.values) == self.n * width
        if self.dense:
            return
        self.at = np.empty(len(self.values), dtype=np.int64)
        starts = np.concatenate([[0], self.ends[:-1]])
        lengths = self.ends - starts
        full = np.repeat(given, lengths)
        self.at[full] = (np.arange(len(self.values)) - np.repeat(starts, lengths))[full]
        self.at[~full] = indices.flatten().to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(self.n), lengths)

    def chunks(self, width: int, cols: int) -> Iterator[tuple[int, int]]:
        """Row ranges whose products stay small."""
        begin = 0
        while begin < self.n:
            before = self.ends[begin - 1] if begin else 0
            end = int(np.searchsorted(self.ends, before + max(1, _CHUNK // max(1, cols)), side="right"))
            end = max(begin + 1, min(end, begin + max(1, _CHUNK // max(1, cols)), self.n))
            yield begin, end
            begin = end

    def times(self, begin: int, end: int, block: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The rows times a block, less what the mean row gives."""
        width = block.shape[0]
        if self.dense:
            return self.values.reshape(self.n, width)[begin:end] @ block - shift
        low, high = (self.ends[begin - 1] if begin else 0), self.ends[end - 1]
        out = np.zeros((end - begin, block.shape[1]))
        if high > low:
            product = self.values[low:high, None] * block[self.at[low:high]]
            rows = self.row[low:high]
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            out[rows[first] - begin] = np.add.reduceat(product, first, axis=0)
        return out - shift

    def spread(self, begin: int, end: int, found: np.ndarray, total: np.ndarray) -> None:
        """Add the transposed rows times ``found`` to ``total``."""
        if self.dense:
            total += self.values.reshape(self.n, len(total))[begin:end].T @ found
            return
        low, high = (self.ends[begin - 1] if begin else 0), self.ends[end - 1]
        if high > low:
            order = np.argsort(self.at[low:high], kind="stable")
            at = self.at[low:high][order]
            product = self.values[low:high][order, None] * found[self.row[low:high][order] - begin]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            total[at[first]] += np.add.reduceat(product, first, axis=0)


def _summed(cells: DataFrame, column: str, width: int, cols: int, add: Callable[[_Batch, np.ndarray], None]) -> np.ndarray:
    """The sum over all rows of a ``width`` by ``cols`` matrix that ``add`` adds each batch to.

    A task gives a row for each slot it has met, and the slots' shares are summed by Spark.
    """
    shape = T.StructType([T.StructField("slot", T.IntegerType()), *[T.StructField(f"v{i}", T.DoubleType()) for i in range(cols)]])

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, cols))
        for batch in batches:
            if batch.num_rows:
                add(_Batch(batch.column(0), width), total)
        met = np.flatnonzero(total.any(axis=1))
        for part in np.array_split(met, max(1, len(met) * cols // _CHUNK)):
            arrays = [pa.array(part.astype(np.int32)), *[pa.array(np.ascontiguousarray(total[part, i])) for i in range(cols)]]
            yield pa.RecordBatch.from_arrays(arrays, names=shape.names)

    # One share for each task slot of the cluster: more would only be more shares to shuffle.
    slots = cells.sparkSession.sparkContext.defaultParallelism
    shares = cells.select(_listed(column)).coalesce(2 * slots).mapInArrow(share, shape)
    sums = shares.groupBy("slot").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(cols)]).toArrow()
    out = np.zeros((width, cols))
    if sums.num_rows:
        out[sums.column("slot").to_numpy()] = np.column_stack([sums.column(f"v{i}").to_numpy() for i in range(cols)])
    return out


def _moments(cells: DataFrame, column: str, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and sample standard deviation of each slot; deviations are summed in a second pass."""
    n = cells.count()

    def sums(batch: _Batch, total: np.ndarray) -> None:
        ones = np.ones((batch.n, 1))
        batch.spread(0, batch.n, ones, total[:, :1])
        if batch.dense:
            total[:, 1] += batch.n
        else:
            total[:, 1] += np.bincount(batch.at, minlength=width)

    first = _summed(cells, column, width, 2, sums)
    mean = first[:, 0] / max(1, n)
    sent = cells.sparkSession.sparkContext.broadcast(mean)

    def squares(batch: _Batch, total: np.ndarray) -> None:
        if batch.dense:
            total[:, 0] += ((batch.values.reshape(batch.n, width) - sent.value) ** 2).sum(axis=0)
        else:
            total[:, 0] += np.bincount(batch.at, (batch.values - sent.value[batch.at]) ** 2, minlength=width)

    squared = _summed(cells, column, width, 1, squares)[:, 0] + (n - first[:, 1]) * mean**2
    sent.unpersist()
    return n, mean, np.sqrt(squared / max(1, n - 1))


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Directions of ``block`` that ``basis`` lacks."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 1e-14] / size[size > 1e-14]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        left, strength, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, strength > 1e-10]
    return block


def pca_wide(
    df: DataFrame,
    vector_col: str,
    k: int,
    names: Sequence[str] | None = None,
    block: int | None = None,
    tolerance: float = 1e-9,
    passes: int = 60,
    seed: int = 42,
) -> Components:
    """The ``k`` leading components of the scaled slots of a vector column, which may be sparse.

    Like ``pca``, with ``pca_features`` as an array in the scores, for widths whose covariance no machine could hold.
    The driver holds a few matrices of width by ``block``; widths at which they exceed ``DRIVER_NUMBERS`` are refused.
    Slots are called by ``names`` or their position. Stops when no component leaves more residual
    than ``tolerance`` of the largest, or raises after ``passes`` over the rows. A NULL vector counts as zeros. A table
    without rows, or with constant slots alone, has no components.
    """
    spark = df.sparkSession
    cells = vector_cells(df, vector_col)
    given = cells.where(F.col(vector_col).isNotNull())
    any_row = given.select(F.coalesce(F.col(f"{vector_col}.size"), F.size(f"{vector_col}.values")).alias("size")).first()
    width = any_row["size"] if any_row else 0
    block = min(block or k + 8, width)
    deepest = min(width, 6 * block)
    if width * (2 * deepest + 4 * block) > DRIVER_NUMBERS:
        raise ValueError(f"{width} slots in blocks of {block} are more than the driver can hold; use fewer components")
    n, mean, deviation = _moments(cells, vector_col, width)
    weight = np.divide(1.0, deviation, out=np.zeros_like(deviation), where=deviation > 0)
    varied = int((deviation > 0).sum())
    k = min(k, varied)

    def covariance(vectors: np.ndarray) -> np.ndarray:
        scaled = np.ascontiguousarray(weight[:, None] * vectors)
        sent = spark.sparkContext.broadcast((scaled, mean @ scaled))

        def add(batch: _Batch, total: np.ndarray) -> None:
            matrix, shift = sent.value
            for begin, end in batch.chunks(width, matrix.shape[1]):
                batch.spread(begin, end, batch.times(begin, end, matrix, shift), total)

        found = _summed(cells, vector_col, width, vectors.shape[1], add)
        sent.unpersist()
        return weight[:, None] * found / (n - 1)

    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    start = np.random.default_rng(seed).standard_normal((width, block)) * (weight > 0)[:, None]
    fresh = _orthonormal(start, basis)
    values, vectors = np.zeros(0), np.zeros((width, 0))
    for _ in range(passes if k else 0):
        basis, image = np.hstack([basis, fresh]), np.hstack([image, covariance(fresh)])
        small = basis.T @ image
        found, turn = np.linalg.eigh((small + small.T) / 2)
        turn = turn[:, ::-1]
        basis, image, values = basis @ turn, image @ turn, found[::-1]
        residual = image[:, :block] - basis[:, :block] * values[:block]
        vectors = basis[:, :k]
        if np.linalg.norm(residual[:, :k], axis=0).max(initial=0.0) <= tolerance * values[0]:
            break
        if basis.shape[1] + block > deepest and deepest < varied:
            basis, image = basis[:, : 2 * block], image[:, : 2 * block]
        fresh = _orthonormal(residual, basis)
        if not fresh.shape[1]:
            break
    else:
        if k:
            raise ValueError(f"not settled after {passes} passes; allow more, a wider block, or a larger tolerance")
    if k:
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(k)])

    ratios = [(i + 1, float(v / varied)) for i, v in enumerate(values[:k])]
    variance = cumulative_variance(spark.createDataFrame(ratios, "component int, ratio double"))
    slot = np.tile(np.arange(width), k)
    table = pa.table({
        "component": pa.array(np.repeat(np.arange(1, k + 1, dtype=np.int32), width)),
        "feature": pa.array([names[i] if names else str(i) for i in slot], pa.string()),
        "loading": pa.array(vectors.T.ravel()),
    })
    return Components(_scored(cells, vector_col, weight[:, None] * vectors), variance, spark.createDataFrame(table))


def _scored(cells: DataFrame, column: str, block: np.ndarray) -> DataFrame:
    """Replace the vectors by ``pca_features``."""
    kept = [c for c in cells.columns if c != column]
    shape = T.StructType([*cells.select(*kept).schema.fields, T.StructField("pca_features", T.ArrayType(T.DoubleType()))])
    sent = cells.sparkSession.sparkContext.broadcast(block)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, matrix = _Batch(batch.column(column), len(sent.value)), sent.value
            parts = [rows.times(b, e, matrix, np.zeros(matrix.shape[1])) for b, e in rows.chunks(len(matrix), matrix.shape[1])]
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * matrix.shape[1])
            scores = pa.ListArray.from_arrays(ends, pa.array(np.vstack(parts).ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], scores], names=shape.names)

    return cells.withColumn(column, _listed(column)).mapInArrow(add, shape)
