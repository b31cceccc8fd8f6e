"""Vectors as packed integers: each component x becomes floor(256 * x)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 256
BLOCK = 4 << 20  # numbers of one numpy block


def usable(column: str) -> Column:
    """A vector without null, NaN or infinite components. NULL for a null vector, which a filter drops."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.forall(F.col(column), lambda x: finite(x.cast("double")))


def whole(values: np.ndarray, limit: int) -> np.ndarray:
    """floor(256 * x) as int64; a value of ``limit`` or more raises, as sums of products would leave the long range."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if len(scaled) and np.abs(scaled).max() >= limit:
        raise ValueError(f"a component is beyond {limit // SCALE}: exact results do not fit a long")
    return scaled.astype(np.int64)


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values of a list column without nulls, and where each list ends."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.asarray(column.value_lengths(), np.int64))
    return values, ends


def pack(values: np.ndarray, ends: np.ndarray, kind: str = "<i4") -> pa.Array:
    """One binary value per vector."""
    size = np.dtype(kind).itemsize
    offsets = np.concatenate([[0], ends * size]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(values.astype(kind).tobytes())])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def unpack(column, width: int, kind: str = "<i4") -> np.ndarray:
    """A matrix of the packed vectors; shorter ones are padded with zeros."""
    if not len(column):
        return np.zeros((0, width), np.int64)
    data, sizes = _bytes(column)
    values = np.frombuffer(data.tobytes(), kind)
    sizes = sizes // np.dtype(kind).itemsize
    if (sizes == width).all():
        return values.reshape(-1, width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    out[row, np.arange(len(values)) - start[row]] = values
    return out


def blocks(batch: pa.RecordBatch, width: int, most: int = 1024):
    """Slices of a batch whose matrices have at most ``BLOCK`` numbers (one row at least)."""
    step = max(1, min(most, BLOCK // max(1, width)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
