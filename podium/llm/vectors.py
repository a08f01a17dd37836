"""Reading vector columns: which rows take part, and their values as doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(col: str):
    """Not null, not empty, without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & ~F.exists(F.col(col).cast("array<double>"), bad), F.lit(False))


def lengths(df: DataFrame, col: str) -> list[int]:
    """Lengths of the vectors; vectors of unequal length are never compared."""
    return sorted(r[0] for r in df.select(F.size(col)).distinct().collect())


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 0))
