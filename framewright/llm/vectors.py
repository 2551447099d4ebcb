"""Vectors of an Arrow column as matrices of integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Squared lengths of integer vectors stay below this, so that products and sums of two fit 64 bits.
LARGEST = float(1 << 61)


def integers(vectors: pa.Array, scale: int, width: int | None = None, largest: float = LARGEST) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and theirs as rows of floor(scale * x), zeros behind the shorter ones.

    A vector that is null or holds a null, NaN or infinite component isn't kept.
    """
    vectors = vectors.cast(pa.list_(pa.float64()))
    offsets = vectors.offsets.to_numpy()
    flat = vectors.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    odd = np.append(0, np.cumsum(~np.isfinite(flat)))
    lengths = np.diff(offsets)
    keep = vectors.is_valid().to_numpy(zero_copy_only=False) & (odd[offsets[1:] - offsets[0]] == odd[offsets[:-1] - offsets[0]])
    width = int(lengths.max(initial=0)) if width is None else width
    out = np.zeros((len(vectors), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    floored = np.floor(out[keep, :width] * scale)
    if floored.size and float(np.square(floored).sum(1).max()) >= largest:
        raise OverflowError("a vector is so long that sums of its squares don't fit 64 bits")
    return keep, floored.astype(np.int64)


def as_binary(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix of 64-bit integers as bytes."""
    rows = np.ascontiguousarray(rows, "<i8")
    size = rows.shape[1] * 8
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(rows)])


def from_binary(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The matrix whose rows ``as_binary`` has made."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), width)


def measured(vectors: DataFrame, column: str, scale: int) -> tuple[int, int, float]:
    """Number of kept vectors, components of the longest, and the largest squared length."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = integers(batch.column(0), scale)
            lengths = np.array([0 if x is None else x for x in batch.column(0).value_lengths().to_pylist()])[keep]
            yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([int(lengths.max(initial=0))], pa.int32()), pa.array([float(np.square(rows).sum(1).max(initial=0))])], ["n", "width", "norm"])

    one = vectors.select(column).mapInArrow(measure, "n long, width int, norm double").agg(F.sum("n"), F.max("width"), F.max("norm")).first()
    return int(one[0] or 0), int(one[1] or 0), float(one[2] or 0)
