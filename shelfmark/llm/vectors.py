"""What the operators on embeddings share: which vectors take part, and Arrow columns as numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, *others: str) -> DataFrame:
    """vec_id, v and other columns of rows that take part: an id, and a vector of finite components, not all zero. Vectors may differ in length."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *others)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column (equal lengths, no nulls) as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as a list column."""
    n, d = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(rows.ravel(), kind))


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1))[:, None]


def sampled(vec_id: Column, rows: int, most: int, seed: int) -> Column:
    """True for about most of rows ids, the same ids each time."""
    share = min(1.0, most / max(1, rows))
    return F.pmod(F.xxhash64(vec_id, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
