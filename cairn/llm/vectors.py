"""Columns of vectors as matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def valid_rows(column: pa.Array) -> np.ndarray:
    """Indices of the lists that are not null, not empty, and hold finite values only."""
    lists = column.cast(pa.list_(pa.float64()))
    n = np.diff(lists.offsets.to_numpy()) * np.asarray(lists.is_valid())
    flat = lists.values[lists.offsets[0].as_py() : lists.offsets[-1].as_py()]
    bad = ~np.isfinite(flat.fill_null(np.nan).to_numpy(zero_copy_only=False))
    held = np.cumsum(np.r_[0, bad])
    at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return np.flatnonzero((n > 0) & (held[at[1:]] == held[at[:-1]]))


def matrices(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row indices, matrix of doubles) of the valid rows, one for each length of vector."""
    rows = valid_rows(column)
    if not len(rows):
        return []
    lists = column.cast(pa.list_(pa.float64())).take(pa.array(rows))
    n = np.diff(lists.offsets.to_numpy())
    flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
    return [(rows[n == d], flat[at[n == d][:, None] + np.arange(d)]) for d in np.unique(n)]
