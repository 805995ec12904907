"""Small numpy helpers for streams of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row differs from the row before it in one of the columns (nulls are equal); the first is False."""
    n = batch.num_rows
    out = np.zeros(n, dtype=bool)
    for name in names:
        a = batch.column(name)
        this, last = a.slice(1), a.slice(0, n - 1)
        differs = pc.fill_null(pc.not_equal(this, last), False).to_numpy(zero_copy_only=False)
        if a.null_count:
            differs = differs | (pc.is_null(this).to_numpy(zero_copy_only=False) != pc.is_null(last).to_numpy(zero_copy_only=False))
        out[1:] |= differs
    return out


def values(batch: pa.RecordBatch, names: list[str], row: int) -> tuple:
    return tuple(batch.column(name)[row].as_py() for name in names)


def int64(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column as int64, null as 0."""
    a = batch.column(name)
    return (pc.fill_null(a, 0) if a.null_count else a).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
