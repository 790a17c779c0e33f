"""D17 as mergeable sums: means, variances and covariances of many columns at once.

A batch gives, for every pair of columns and over the rows that have both, the count,
both means, and the centred sums of squares and products. Two such summaries merge
exactly by the shift between their means, so nothing is ever subtracted from a large
sum of squares and the result does not depend on where the data lie. Tasks
merge their batches, then a few tasks merge the tasks, then one merges those: what
moves has the size of tasks x columns squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MERGERS = 16                     # tasks of the middle round

# A summary is four d x d matrices: n, mean of i where j is there, C = sum of products, V = sum of squares of i.


def summary(x: np.ndarray) -> np.ndarray:
    """Of the rows of ``x`` (NaN: missing)."""
    there = ~np.isnan(x)
    m = there.astype(float)
    centre = np.where(there, x, 0.0).sum(0) / np.maximum(m.sum(0), 1)
    y = np.where(there, x - centre, 0.0)
    n = m.T @ m
    mean = (y.T @ m) / np.maximum(n, 1)
    return np.stack([n, mean + centre[:, None], y.T @ y - n * mean * mean.T, (y * y).T @ m - n * mean * mean])


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    safe = np.maximum(n, 1)
    d = b[1] - a[1]
    both = a[0] * b[0] / safe
    return np.stack([n, a[1] + d * b[0] / safe, a[2] + b[2] + d * d.T * both, a[3] + b[3] + d * d * both])


def _merged(batches, d: int):
    total = np.zeros((4, d, d))
    for b in batches:
        for row in b.column(0).to_pylist():
            total = merge(total, np.array(row).reshape(4, d, d))
    return total


def comoments(df: DataFrame, cols: list[str]) -> DataFrame:
    """``col_a, col_b, n, mean_a, mean_b, cov, corr`` of every ordered pair (population
    covariance), over the rows that have both values; NULL where there are none, and
    ``corr`` NULL where a column does not vary."""
    d = len(cols)

    def partial(batches):
        total = np.zeros((4, d, d))
        for b in batches:
            if b.num_rows:
                flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
                total = merge(total, summary(flat.reshape(-1, d)))
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["s"])

    def middle(batches):
        yield pa.RecordBatch.from_arrays([pa.array([_merged(batches, d).ravel().tolist()])], names=["s"])

    def final(batches):
        n, mean, c, v = _merged(batches, d)
        rows = []
        for i in range(d):
            for j in range(d):
                k, spread = n[i, j], np.sqrt(max(v[i, j], 0.0)) * np.sqrt(max(v[j, i], 0.0))
                rows.append((cols[i], cols[j], int(k), mean[i, j] if k else None, mean[j, i] if k else None,
                             c[i, j] / k if k else None, float(np.clip(c[i, j] / spread, -1, 1)) if spread > 0 else None))
        kinds = [pa.string(), pa.string(), pa.int64(), *[pa.float64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)],
                                         names=["col_a", "col_b", "n", "mean_a", "mean_b", "cov", "corr"])
    x = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("x"))
    return (x.mapInArrow(partial, "s array<double>").repartition(MERGERS).mapInArrow(middle, "s array<double>")
            .repartition(1).mapInArrow(final, "col_a string, col_b string, n long, mean_a double, mean_b double, cov double, "
                                              "corr double"))
