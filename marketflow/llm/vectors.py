"""Shared helpers of the vector operators: whole-number vectors and their numpy form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True where the vector and all its components are there and finite."""
    size = lambda x: F.abs(x.cast("double"))
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(size(x) < float("inf"), F.lit(False))), F.lit(False))


def by_length(column: pa.ChunkedArray | pa.Array):
    """(length, row numbers, matrix of doubles) for each length among the vectors of a column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    sizes = np.asarray(column.value_lengths())
    values = np.asarray(column.flatten(), dtype=np.float64)
    begin = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, values[begin[rows, None] + np.arange(n)]
