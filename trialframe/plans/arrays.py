"""Feature vectors as array<double>: moving them to numpy and adding them up in Spark."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list<double> column as a rows × width matrix, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.empty((0, width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, dtype="float64").reshape(len(column), width)


def to_lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    rows, width = matrix.shape
    offsets = np.arange(0, (rows + 1) * width, width, dtype="int32")
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.array(np.ascontiguousarray(matrix).ravel(), kind)
    )


def array_sum(name: str, width: int) -> Column:
    """Element-wise sum of an array column (aggregate)."""
    return F.array(*[F.sum(F.col(name)[i]) for i in range(width)])


def sum_arrays(df: DataFrame, keys: Sequence[str], name: str, width: int) -> DataFrame:
    """groupBy(keys) with the element-wise sum of one array column."""
    return df.groupBy(*keys).agg(array_sum(name, width).alias(name))


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of all rows of two blocks by one matrix product."""
    d = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)
