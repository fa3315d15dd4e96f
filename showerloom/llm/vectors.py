"""What the vector operators share: usable vectors as float64 rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, col: str) -> DataFrame:
    """Rows whose vector is not null or zero, has only finite components, and the table's usual length.

    The usual length is the most frequent one of such vectors (the larger on ties).
    """
    x = F.col(col)
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size(x).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size(x) == (top[0]["d"] if top else 0))


def matrix(vectors) -> np.ndarray:
    return np.array(vectors.to_list(), dtype=np.float64) if len(vectors) else np.zeros((0, 1))


def top_rows(score: np.ndarray, x: np.ndarray, q: np.ndarray, tie: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For one query q: rows of its k largest inner products (ties to smaller `tie`) and the products.

    score is a fast first pass; rows within rounding of the k-th are computed again, each by the same
    sequence of operations, so equal vectors tie exactly.
    """
    if len(score) > k:
        near = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - 1e-9 * max(1.0, np.abs(score).max()))
    else:
        near = np.arange(len(score))
    exact = np.einsum("ij,j->i", x[near], q)
    order = np.lexsort((tie[near], -exact))[:k]
    return near[order], exact[order]
