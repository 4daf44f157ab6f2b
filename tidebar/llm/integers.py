"""Vectors as whole numbers: what the exact operators on ``embeddings`` share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def integer_vectors(lists: pa.Array, scale: int, room: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, places of the rows, floor(scale * x) as a matrix of int64) for each length of vector in ``lists``.

    Rows that are null, empty or hold a null or non-finite component are left out, and so are rows with a whole number beyond
    ``room`` / sqrt(dimension): sums of products of such numbers have no value in 64 bits.
    """
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    values = np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan))
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(values * scale)
    ends = np.cumsum(sizes)
    most = np.zeros(len(sizes))
    some = sizes > 0
    if some.any():  # nulls and non-finite components are beyond any room
        size = np.where(np.isfinite(values), np.abs(values), np.inf)
        most[some] = np.maximum.reduceat(size, (ends - sizes)[some])
    out = []
    for dim in np.unique(sizes[some]):
        rows = np.flatnonzero((sizes == dim) & (most <= room / np.sqrt(dim)))
        if len(rows):
            out.append((int(dim), rows, values[(ends[rows] - dim)[:, None] + np.arange(dim)].astype(np.int64)))
    return out
