"""What the operators on vectors share: which vectors count, integer components, and sums of integers over all tasks.

Sums are of integers, so they are the same however the rows are dealt out and whichever task runs again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

#: Scaled components lie below this, so that products of them and their sums over a vector are exact in double precision.
MOST = 1 << 20


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False))


def longest(df: DataFrame, vector: str) -> int:
    """The number of components of the longest vector; shorter ones count as if zeros followed."""
    return df.agg(F.max(F.size(vector))).first()[0] or 0


def floored(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of each component (as double), a row for each vector, zeros up to the width."""
    out = np.zeros((len(vectors), width), np.int64)
    sizes = np.diff(vectors.offsets.to_numpy())
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(x * scale)
    if len(x) and np.abs(x).max() >= MOST:
        raise ValueError(f"a component is {np.abs(x).max() / scale}; the components must lie below {MOST / scale}")
    out[np.arange(width) < sizes[:, None]] = x.astype(np.int64)
    return out


def packed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows)]).cast(pa.binary())


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    """The rows that `packed` made."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def added(rows: DataFrame) -> dict[int, np.ndarray]:
    """rows: key int, sums binary (64-bit integers, equally many for a key). The sums of each key; for keys whose number and width are bounded."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, x in zip(batch.column("key").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64)
                have[key] = have[key] + x if key in have else x
        if have:
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([x.tobytes() for x in have.values()], pa.binary())], names=["key", "sums"])

    found = rows.repartition(partitions(rows), "key").mapInArrow(add, "key int, sums binary").toArrow()
    return {k: np.frombuffer(x, np.int64) for k, x in zip(found.column("key").to_pylist(), found.column("sums").to_pylist(), strict=True)}
