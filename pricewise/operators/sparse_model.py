"""I16 on one-hot columns: weighted L2 logistic regression over sparse rows.

A row is its non-zero columns (index and value); the levels of the categories are a
table of (column, value, index), so encoding is a join and no level becomes a column of
a DataFrame. The solver is a limited-memory quasi-Newton method: its state is vectors as
long as the number of columns (the coefficients and a few step/gradient pairs), never a
matrix. A pass over the rows gives the loss and the gradient at every trial step of
the line search at once, as sums added up by Spark, so an iteration is one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import balanced_weights
from .model import LinearModel
from .rows import with_row_index

MAX_WIDTH = 1 << 22              # columns: vectors of 32 MB on the driver and in every task
MEMORY = 12                      # step/gradient pairs kept
TRIALS = (1.0, 0.25)             # step lengths looked at in one pass
TOL = 1e-10                      # largest scaled gradient entry at the end
MAX_ITER = 300


# ---------------------------------------------------------------- rows

@dataclass
class SparseColumns:
    """Fitted columns: one per level of ``categorical``, then ``numeric`` as they are."""
    levels: DataFrame            # column_name, value, idx
    categorical: list[str]
    numeric: list[str]
    n_levels: int

    @property
    def width(self) -> int:
        return self.n_levels + len(self.numeric)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``_idx`` and ``_val``: its non-zero columns. A level not seen in fitting
        and a null have no column."""
        out, cells = df, []
        for c in self.categorical:
            m = (self.levels.filter(F.col("column_name") == c)
                 .select(F.col("value").alias(f"_v_{c}"), F.col("idx").alias(f"_i_{c}")))
            out = out.join(m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
            cells.append(F.when(F.col(f"_i_{c}").isNotNull(), F.struct(F.col(f"_i_{c}").cast("int").alias("i"),
                                                                       F.lit(1.0).alias("v"))))
        for j, c in enumerate(self.numeric):
            x = F.col(c).cast("double")
            cells.append(F.when(x != 0, F.struct(F.lit(self.n_levels + j).alias("i"), x.alias("v"))))
        cells = F.array_compact(F.array(*cells))
        return out.select(*[F.col(f"`{c}`") for c in df.columns], F.transform(cells, lambda x: x["i"]).alias("_idx"),
                          F.transform(cells, lambda x: x["v"]).alias("_val"))

    def names(self) -> DataFrame:
        """``idx, name`` of every column."""
        spark = self.levels.sparkSession
        rest = spark.createDataFrame([(self.n_levels + j, c) for j, c in enumerate(self.numeric)], "idx long, name string")
        return self.levels.select("idx", F.concat_ws("_", "column_name", "value").alias("name")).unionByName(rest)


def fit_columns(df: DataFrame, categorical: list[str], numeric: list[str], max_width: int = MAX_WIDTH) -> SparseColumns:
    """Levels of every category, in one aggregate; a category with exactly two keeps the
    second alone. Raises if there are more than ``max_width`` columns."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(c).alias("column_name"),
                                                   F.col(c).cast("string").alias("value"))
                                          for i, c in enumerate(categorical)])).alias("_c"))
    levels = cells.select("_c.*").filter("value IS NOT NULL").distinct()
    sizes = levels.groupBy("p").agg(F.count(F.lit(1)).alias("_n"), F.min("value").alias("_least"))
    kept = (levels.join(sizes, "p").filter((F.col("_n") != 2) | (F.col("value") != F.col("_least")))
            .select("p", "column_name", "value"))
    indexed = with_row_index(kept, [F.col("p"), F.col("value")], "idx", materialise_input=True).drop("p")
    indexed = indexed.checkpoint(eager=True)
    n = indexed.count()
    if n + len(numeric) > max_width:
        raise ValueError(f"{n + len(numeric)} columns; the bound is {max_width}")
    return SparseColumns(indexed, list(categorical), list(numeric), n)


def sparse_table(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """What a pass reads (``_idx, _val, y, w``), written to the checkpoint folder and cached."""
    data = df.select("_idx", "_val", F.col(label).cast("double").alias("y"), F.col(weight_col).cast("double").alias("w"))
    return data.na.drop(subset=["y", "w"]).checkpoint(eager=True).persist()


# ---------------------------------------------------------------- passes

def _pass(data: DataFrame, size: int, function) -> np.ndarray:
    """Sum over all rows of ``function(row of each entry, idx, val, y, w) -> vector``."""
    def run(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                idx, val = b.column(0), b.column(1)
                rows = np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy()))
                total += function(rows, idx.flatten().to_numpy(), val.flatten().to_numpy(),
                                  b.column(2).to_numpy(), b.column(3).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["i", "v"])
    out = np.zeros(size)
    for r in data.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r["i"]] = r["v"]
    return out


def _entries(rows, idx, val, coef, n):
    return np.bincount(rows, val * coef[idx], minlength=n)


def _scales(data: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted sums of every column and of its squares, and of the weights."""
    def run(rows, idx, val, y, w):
        u = w[rows] * val
        return np.concatenate([np.bincount(idx, u, minlength=width), np.bincount(idx, u * val, minlength=width), [w.sum()]])
    s = _pass(data, 2 * width + 1, run)
    return s[:width], s[width:-1], float(s[-1])


def _losses(data: DataFrame, coef: np.ndarray, step: np.ndarray, trials, mean: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(loss, gradient) of the data term at ``coef + t * step`` for every trial ``t``. The last
    entry is the intercept of the centred columns."""
    width = len(coef) - 1

    def run(rows, idx, val, y, w):
        n, out = len(y), []
        base = _entries(rows, idx, val, coef, n) + (coef[-1] - mean @ coef[:-1])
        move = _entries(rows, idx, val, step, n) + (step[-1] - mean @ step[:-1])
        for t in trials:
            z = base + t * move
            r = w * (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y)
            out += [[(w * (np.logaddexp(0, z) - y * z)).sum()], np.bincount(idx, val * r[rows], minlength=width), [r.sum()]]
        return np.concatenate(out)
    got = _pass(data, len(trials) * (width + 2), run).reshape(len(trials), width + 2)
    return [(float(g[0]), np.append(g[1:-1] - mean * g[-1], g[-1])) for g in got]


def fit_sparse_logistic(data: DataFrame, width: int, C: float, max_iter: int = MAX_ITER, tol: float = TOL) -> LinearModel:
    """Minimise 1/2 |b|^2 + C * sum_i w_i * logloss_i (free intercept) over ``sparse_table`` rows.

    Columns are centred by moving the intercept (rows stay sparse), and steps are scaled by
    the diagonal of the curvature at zero. Ends when no gradient entry, in units of its
    column's curvature, passes ``tol``."""
    s1, s2, total = _scales(data, width)
    mean = s1 / total if total else np.zeros(width)
    diagonal = np.append(C / 4 * np.maximum(s2 - s1 * mean, 0) + 1, max(C / 4 * total, 1e-300))
    coef, step = np.zeros(width + 1), np.zeros(width + 1)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def whole(got, at):
        loss, g = got
        return C * loss + 0.5 * at[:-1] @ at[:-1], C * g + np.append(at[:-1], 0.0)
    f, g = whole(_losses(data, coef, step, (0.0,), mean)[0], coef)
    scale = 1.0
    for _ in range(max_iter):
        if np.abs(g / diagonal).max(initial=0.0) <= tol:
            break
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ (y / diagonal))
        q /= diagonal
        for (s, y), a in zip(pairs, reversed(alphas)):
            q += (a - (y @ q) / (s @ y)) * s
        step = -q
        if g @ step >= 0:                                # not downhill: start again
            pairs, step = [], -g / diagonal
        trials = [scale * t for t in TRIALS]
        found = None
        for t, got in zip(trials, _losses(data, coef, step, trials, mean)):
            f1, g1 = whole(got, coef + t * step)
            if f1 <= f + 1e-4 * t * (g @ step) + 1e-14 * abs(f):
                found = (t, f1, g1)
                break
        if found is None:
            if scale < 1e-8:                             # no progress is left at this precision
                break
            scale /= 16
            continue
        t, f1, g1 = found
        s, y = t * step, g1 - g
        if s @ y > 1e-14 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs, (s, y)][-MEMORY:]
        coef, f, g, scale = coef + s, f1, g1, 1.0
    return LinearModel(coef[:-1].copy(), float(coef[-1] - mean @ coef[:-1]))


def fit_one_hot_logistic(df: DataFrame, categorical: list[str], numeric: list[str], label: str,
                         C: float) -> tuple[SparseColumns, LinearModel]:
    """I16 as the draft fits it: one-hot categories, numbers as they are, balanced weights.
    Rows with a null feature or label take no part."""
    rows = df.na.drop(subset=[*categorical, *numeric, label])
    columns = fit_columns(rows, categorical, numeric)
    data = sparse_table(columns.transform(balanced_weights(rows, label)), label)
    model = fit_sparse_logistic(data, columns.width, C)
    data.unpersist()
    return columns, model


def sparse_coefficients(columns: SparseColumns, model: LinearModel) -> DataFrame:
    """I23 of a sparse model: ``name, coef``, largest first, with the intercept."""
    spark = columns.levels.sparkSession
    rows = [(i, float(c)) for i, c in enumerate(model.coefficients)]
    coefs = spark.createDataFrame(rows, "idx long, coef double").join(columns.names(), "idx")
    last = spark.createDataFrame([("intercept", float(model.intercept))], "name string, coef double")
    return coefs.select("name", "coef").unionByName(last).orderBy(F.desc("coef"), "name")


def score_sparse(columns: SparseColumns, model: LinearModel, df: DataFrame,
                 pred_col: str = "y_pred", proba_col: str = "proba") -> DataFrame:
    """I19 of a sparse model: the coefficients of a row's columns, looked up per batch."""
    coef, intercept = np.asarray(model.coefficients), model.intercept
    rows = columns.transform(df)
    keep = [c for c in df.columns]

    def run(batches):
        for b in batches:
            idx, val = b.column(len(keep)), b.column(len(keep) + 1)
            at = np.repeat(np.arange(b.num_rows), np.diff(idx.offsets.to_numpy()))
            z = _entries(at, idx.flatten().to_numpy(), val.flatten().to_numpy(), coef, b.num_rows) + intercept
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(keep)], pa.array(p), pa.array((p > 0.5).astype(np.int32))],
                                             names=[*keep, proba_col, pred_col])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(run, f"{schema}, {proba_col} double, {pred_col} int")
