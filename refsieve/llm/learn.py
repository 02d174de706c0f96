"""What the trained operators share: folds, bounded samples of labelled rows, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5; 0 is held out. Null ids count as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(0))


def sample(labelled: DataFrame, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about ``bound`` rows of ``labelled``, picked by a hash of the id, the least row of each id: the same rows on every run."""
    n = labelled.count()
    if n <= bound:
        return labelled
    picked = labelled.where(F.pmod(F.xxhash64(id_col, F.lit(11)), F.lit(1_000_000)) < int(1_000_000 * bound / n))
    rest = [c for c in labelled.columns if c != id_col]
    return picked.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("row")).select(id_col, "row.*")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def isotonic(score: np.ndarray, label: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Points of the increasing fit of labels to scores, by pooling adjacent violators.

    With ``count``, a point stands for so many rows of one score and ``label`` is the sum of their labels.
    """
    order = np.argsort(score, kind="stable")
    count = np.ones(len(score)) if count is None else count
    pools: list[list[float]] = []  # sum of labels, count, sum of scores
    for x, y, n in zip(score[order], label[order], count[order], strict=True):
        pools.append([float(y), float(n), float(x) * float(n)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([(p[0] + 0.5) / (p[1] + 1) for p in pools])


def temperature(logits: np.ndarray, label: np.ndarray) -> float:
    """The temperature, from a fixed grid, with the least log loss."""
    grid = np.geomspace(0.1, 10, 41)
    loss = [-np.log(softmax(logits / t)[np.arange(len(label)), label] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
