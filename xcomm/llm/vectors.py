"""Arrow columns of vectors as dense matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lists_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length (-1: null), place of the first entry, and entries (as doubles, null: NaN) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = column.cast(pa.large_list(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    return lengths, lists.offsets.to_numpy(zero_copy_only=False)[:-1], lists.values.to_numpy(zero_copy_only=False)


def dense(column: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose vector has ``dims`` entries, none null or non-finite, and these vectors as a matrix."""
    lengths, first, values = lists_of(column)
    rows = np.flatnonzero(lengths == dims)
    x = values[first[rows][:, None] + np.arange(dims)] if len(rows) and dims else np.zeros((len(rows), dims))
    good = np.isfinite(x).all(axis=1)
    return rows[good], x[good]


def steps(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """``floor(scale * x)`` as 64-bit integers, held within ``-limit .. limit``."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * float(scale)), -float(limit), float(limit)).astype(np.int64)
