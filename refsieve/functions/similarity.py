"""Character-sequence similarity, which Spark has no function for, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity; not symmetric: the claimed text comes first."""
    return SequenceMatcher(None, a, b).ratio()


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of folded texts; null where either is null, so that callers can leave rows out."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
