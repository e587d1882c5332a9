"""Helpers for columns of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(v: Column) -> Column:
    """True for vectors that are not null and hold no null or non-finite component."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite, F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def runs(batches, n_keys: int):
    """Arrow tables of the rows of each run of equal values in the first n_keys columns.

    The rows must come sorted by those columns; a run may span batches.
    """
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        if not len(held):
            continue
        keys = [held.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        for a, b in zip([0, *new[:-1]], new):
            yield held.slice(a, b - a)
        held = held.slice(new[-1]) if len(new) else held
    if held is not None and len(held):
        yield held
