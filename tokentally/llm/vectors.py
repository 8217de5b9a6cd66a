"""Vectors of Arrow list columns as numpy matrices, and sums of matrices over all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of partial sums that reach the driver, at most (one of them, if it is larger).
GATHERED_BYTES = 32 << 20


def finite_by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in double precision) for each length of the vectors that are not null, not
    empty, and hold neither nulls nor non-finite numbers."""
    if not len(column):
        return
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for width in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == width)
        matrix = values[offsets[rows][:, None] + np.arange(width)].astype(np.float64)
        finite = np.isfinite(matrix).all(axis=1)
        if finite.any():
            yield rows[finite], matrix[finite]


def finite_vectors(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a usable vector of this length, and the matrix of these."""
    for rows, matrix in finite_by_width(column):
        if matrix.shape[1] == width:
            return rows, matrix
    return np.empty(0, np.int64), np.empty((0, width))


def summed(
    frame: DataFrame, matrices: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], shape: tuple[int, ...]
) -> np.ndarray:
    """The sum of the matrices (of one shape) that all tasks make of the frame's batches.

    Each task adds up its own; these sums are added up again in so few tasks that what they hold
    together is bounded, and only that reaches the driver.
    """

    def one(total: np.ndarray) -> pa.RecordBatch:
        part = TaskContext.get().partitionId()
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([total.tobytes()])], ["part", "total"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for matrix in matrices(batches):
            total += matrix
        yield one(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for content in batch.column(1):
                total += np.frombuffer(content.as_buffer(), np.float64).reshape(shape)
        yield one(total)

    schema = "part long, total binary"
    few = max(1, min(64, GATHERED_BYTES // (8 * int(np.prod(shape)))))
    partial = frame.mapInArrow(own, schema).repartition(few, "part").sortWithinPartitions("part")
    total = np.zeros(shape)
    for row in sorted(partial.mapInArrow(add, schema).collect()):  # GATHERED_BYTES
        total += np.frombuffer(row["total"], np.float64).reshape(shape)
    return total
