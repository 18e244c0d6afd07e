"""Shared by the operators on vectors: which rows count, and streams of keyed Arrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(vector: str) -> Column:
    """The vector is there and none of its components is null, NaN or infinite."""
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column, all of one length, in doubles."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(column[0]) if len(column) else 0)


def keyed_runs(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """(key, rows) of sorted batches: runs of at most ``rows`` rows whose first ``keys`` columns agree."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            key = tuple(batch.column(k)[start].as_py() for k in range(keys))
            for at in range(start, stop, rows):
                yield key, batch.slice(at, min(rows, stop - at))
