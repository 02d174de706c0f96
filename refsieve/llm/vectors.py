"""Embedding columns as integer matrices, for operators 12 and 13."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integers are below this in size, so that 64 bits hold every sum of products of up to 4,096 of them, times 100.
LIMIT = 1 << 22


def length_of(table: DataFrame, id_col: str, vector_col: str) -> int:
    """The length that counts: that of the vector of the least id, ties to the shorter; 0 if there is none."""
    sized = table.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0))
    row = sized.agg(F.min(F.struct(F.col(id_col), F.size(vector_col).alias("n"))).alias("x")).first()
    return row["x"]["n"] if row["x"] else 0


def integers(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector of ``size`` finite components within the LIMIT, and their floor(scale * x), as int64."""
    kept = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    x = column.filter(pa.array(kept)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    good = np.isfinite(x).all(axis=1)
    whole = np.floor(np.where(good[:, None], x, 0) * scale)
    good &= (np.abs(whole) < LIMIT).all(axis=1)
    kept[kept] = good
    return kept, whole[good].astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in floating point where every sum fits into 53 bits."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T
