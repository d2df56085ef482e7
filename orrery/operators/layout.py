"""Two-dimensional layout of vectors by their principal components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def principal_axes(vectors: DataFrame, vector: str, n: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the ``n`` axes of most variance, and their variances, from sums over all rows.

    Every task adds up its rows' sums and products into one square of the vectors' length; squares are added cell by cell, and
    as many cells as a square has reach the driver, whatever the rows.  Of an axis' two directions the one is taken whose
    largest component is positive (the first of equals).  Null vectors, and those with null or non-finite parts, don't count.
    """

    def sums(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: np.ndarray | None = None
        for b in batches:
            x = finite(b["v"])
            if len(x):
                x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "s": total.ravel()})

    cells = vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(sums, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    found = cells.collect()  # (length + 1) squared
    if not found:
        return np.zeros(0), np.zeros((n, 0)), np.zeros(n)
    size = max(r.i for r in found) + 1
    total = np.zeros((size, size))
    for r in found:
        total[r.i, r.j] = r.s
    mean = total[0, 1:] / total[0, 0]
    values, axes = np.linalg.eigh(total[1:, 1:] / total[0, 0] - np.outer(mean, mean))
    axes = axes[:, ::-1][:, :n].T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(np.round(axes, 9)).argmax(axis=1)])
    return mean, axes * signs[:, None], values[::-1][:n]


def finite(vectors: pd.Series) -> np.ndarray:
    rows = [np.asarray(v, float) for v in vectors if v is not None]
    rows = [v for v in rows if np.isfinite(v).all()]
    return np.stack(rows) if rows else np.zeros((0, 0))


def layout_2d(vectors: DataFrame, key: str, vector: str, digits: int = 6) -> DataFrame:
    """``key, x, y``: places along the two principal axes; null where a vector doesn't count."""
    mean, axes, _ = principal_axes(vectors, vector, 2)
    middle = axes @ mean if len(mean) else np.zeros(2)

    def along(axis: np.ndarray, start: float):
        parts = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(a)) for a in axis]), lambda v, a: v * a)
        total = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) - F.lit(float(start))
        return F.when(~F.isnan(total) & (F.abs(total) < float("inf")), F.round(total, digits))

    return vectors.select(key, along(axes[0], middle[0]).alias("x"), along(axes[1], middle[1]).alias("y"))
