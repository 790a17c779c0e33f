"""Weighted L2 logistic regression, its regularisation search,
a stratified random baseline, and scoring.

Fits are Newton steps. One pass over the data gives the gradient and the Hessian
of all models at once (the whole search: every C in every fold), as sums that are
added up by Spark; a step is then a small linear solve. A search takes as many
passes as its slowest model takes steps (about ten), not a solver run per model.
What reaches the driver has the size of models x features squared.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import balanced_weights, fit_features, fit_features_by_fold
from .rows import hash_key, with_group_rank

# Fixed values of the search: 20 values of C from 1e-8 to 1e4, 5 folds.
CS = [10 ** (-8 + 12 * i / 19) for i in range(20)]
FOLDS = 5
MAX_ITER = 200
TOL = 1e-9                       # largest change of a coefficient in the last step
ROWS = 2048                      # rows taken at a time: what they make for all models stays in a core's cache


@dataclass
class LinearModel:
    coefficients: np.ndarray
    intercept: float


def solver_table(df: DataFrame, features: list[str], label: str, weight_col: str | None = "weight",
                 fold_col: str | None = None) -> DataFrame:
    """The numbers a fit reads once per step (``x`` array, ``y``, ``w``, ``f``),
    written to the checkpoint folder (lineage cut) and cached. Rows with a missing
    feature, label or weight take no part."""
    cols = [*features, label, *([weight_col] if weight_col else [])]
    data = df.na.drop(subset=cols).select(
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col(label).cast("double").alias("y"),
        (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w"),
        (F.col(fold_col) if fold_col else F.lit(-1)).cast("int").alias("f"))
    return _spread(data)


def _spread(data: DataFrame) -> DataFrame:
    """``data`` written and cached, in some parts for every core: a pass is arithmetic, and
    adaptive execution cuts by bytes."""
    data = data.checkpoint(eager=True)
    parts = 3 * data.sparkSession.sparkContext.defaultParallelism
    return (data if data.rdd.getNumPartitions() >= parts else data.repartition(parts)).persist()


def solver_rows(df: DataFrame, label: str) -> DataFrame:
    """As ``solver_table`` for rows that have ``x``, ``weight`` and ``fold`` (features may be missing)."""
    data = df.select("x", F.col(label).cast("double").alias("y"), F.col("weight").cast("double").alias("w"),
                     F.col("fold").cast("int").alias("f")).na.drop(subset=["y", "w"])
    return _spread(data)


def _sums(data: DataFrame, function, size: int) -> np.ndarray:
    """Sum over all rows of ``function(x, y, w, f) -> vector``, batch by batch."""
    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                x, rows = flat.reshape(batch.num_rows, -1), [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)]
                for a in range(0, batch.num_rows, ROWS):
                    total += function(x[a: a + ROWS], *(r[a: a + ROWS] for r in rows))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["s"])
    rows = (data.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v"))
            .groupBy("i").agg(F.sum("v").alias("v")).collect())
    out = np.zeros(size)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def _blocks(x: np.ndarray, folds: int, left_out: np.ndarray, columns: list | None = None):
    """(models, rows, their features, which features) for every block: with ``folds`` blocks a model reads
    the block of the fold it leaves out, with ``columns`` (per model) its own features, else all models
    read the same. Rows with a missing feature there take no part."""
    if columns is not None:
        for own in sorted(set(columns)):
            part = x[:, own]
            there = ~np.isnan(part).any(1)
            yield np.array([i for i, c in enumerate(columns) if c == own]), there, part[there], np.array(own)
        return
    if folds == 1:
        yield np.arange(len(left_out)), slice(None), x, np.arange(x.shape[1])
        return
    parts = x.reshape(len(x), folds, -1)
    for f in range(folds):
        at = np.flatnonzero(left_out == f)
        if len(at):
            there = ~np.isnan(parts[:, f]).any(1)
            yield at, there, parts[there, f], np.arange(parts.shape[2])


def newton(data: DataFrame, n_features: int, specs: list[tuple[float, int | None]],
           max_iter: int = MAX_ITER, folds: int = 1, columns: list[tuple] | None = None,
           start: np.ndarray | None = None) -> list[LinearModel]:
    """One model per ``(C, left-out fold)``: minimise 1/2 |b|^2 + C * sum_i w_i *
    logloss_i over the rows of all other folds (free intercept). ``folds`` > 1: ``x`` holds
    one set of features per left-out fold, and all models still share the passes. ``columns``: the
    features of each model (the others' coefficients are 0), if they differ. ``start``: coefficients (and
    intercept) of each model to begin with."""
    d, m = n_features + 1, len(specs)
    upper = np.triu_indices(d)
    place = np.zeros((d, d), np.int64)
    place[upper] = np.arange(len(upper[0]))
    beta = np.zeros((m, d)) if start is None else np.array(start, float)
    C = np.array([c for c, _ in specs])
    left_out = np.array([-2 if f is None else f for _, f in specs])
    ridge = np.diag([1.0] * n_features + [0.0])
    live = np.ones(m, bool)

    def batch_sums(b, out, columns):
        def run(x, y, w, f):
            total = np.zeros((len(b), d + len(upper[0])))
            for at, rows, part, own in _blocks(x, folds, out, columns):
                own = np.append(own, n_features)
                i, j = np.triu_indices(len(own))
                order = np.argsort(f[rows], kind="stable")       # fold by fold
                y_, w_, f_ = (v[rows][order][:, None] for v in (y, w, f))
                xb = np.column_stack([part, np.ones(len(part))])[order]
                xt = np.ascontiguousarray(xb.T)
                pairs, mine = xt[i] * xt[j], np.zeros((len(at), len(own) + len(i)))
                cuts = np.flatnonzero(np.diff(f_[:, 0], prepend=-3, append=-3))
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    who = np.flatnonzero(out[at] != f_[lo, 0])
                    p = xb[lo:hi] @ b[np.ix_(at[who], own)].T
                    np.clip(p, -35, 35, out=p)
                    np.exp(np.negative(p, out=p), out=p)
                    p += 1
                    np.divide(1, p, out=p)
                    curve = 1 - p
                    curve *= p
                    curve *= w_[lo:hi]
                    p -= y_[lo:hi]
                    p *= w_[lo:hi]
                    mine[who] += np.concatenate([p.T @ xb[lo:hi], curve.T @ pairs[:, lo:hi].T], axis=1)
                total[np.ix_(at, np.concatenate([own, d + place[own[i], own[j]]]))] += mine
            return total.ravel()
        return run
    for _ in range(max_iter):
        at = np.flatnonzero(live)
        sums = batch_sums(beta[at], left_out[at], None if columns is None else [columns[k] for k in at])
        got = _sums(data, sums, len(at) * (d + len(upper[0]))).reshape(len(at), -1)
        for k, row in zip(at, got):
            hess = np.zeros((d, d))
            hess[upper] = row[d:]
            hess = C[k] * (hess + np.triu(hess, 1).T) + ridge + 1e-12 * np.eye(d)
            step = np.linalg.solve(hess, C[k] * row[:d] + ridge @ beta[k])
            beta[k] -= step * min(1.0, 20.0 / max(np.abs(step).max(), 1e-300))
            live[k] = np.abs(step).max() > TOL * max(1.0, np.abs(beta[k]).max())
        if not live.any():
            break
    return [LinearModel(b[:-1].copy(), float(b[-1])) for b in beta]


def fit_logistic(df: DataFrame, features: list[str], label: str, C: float, weight_col: str | None = "weight",
                 max_iter: int = MAX_ITER) -> LinearModel:
    """I16: one weighted L2 logistic fit."""
    data = solver_table(df, features, label, weight_col)
    model = newton(data, len(features), [(C, None)], max_iter)[0]
    data.unpersist()
    return model


def score(model: LinearModel, df: DataFrame, features: list[str],
          pred_col: str = "y_pred", proba_col: str = "proba") -> DataFrame:
    """Predicted label and probability of class 1, as plain expressions; a
    row with a missing feature has neither."""
    z = F.lit(float(model.intercept))
    for c, name in zip(model.coefficients, features):
        z = z + F.lit(float(c)) * F.col(name).cast("double")
    return (df.withColumn(proba_col, 1 / (1 + F.exp(-z)))
            .withColumn(pred_col, (F.col(proba_col) > 0.5).cast("int")))


def _held_out_f1(data: DataFrame, models: list[LinearModel], specs: list[tuple[float, int]], folds: int = 1,
                 columns: list[tuple] | None = None) -> list[float]:
    """F1 of class 1 of every model on its left-out fold, in one pass."""
    b = np.array([[*m.coefficients, m.intercept] for m in models])
    fold = np.array([f for _, f in specs])

    def run(x, y, w, f):
        counts = np.zeros((3, len(b)))
        for at, rows, part, own in _blocks(x, folds, fold, columns):
            pred = (np.column_stack([part, np.ones(len(part))]) @ b[np.ix_(at, np.append(own, -1))].T) > 0
            mine, one = f[rows, None] == fold[None, at], (y[rows] == 1)[:, None]
            counts[:, at] = [(mine & pred & one).sum(0), (mine & pred & ~one).sum(0), (mine & ~pred & one).sum(0)]
        return counts.ravel()
    tp, fp, fn = _sums(data, run, 3 * len(models)).reshape(3, -1)
    return [0.0 if 2 * a + u + v == 0 else float(2 * a / (2 * a + u + v)) for a, u, v in zip(tp, fp, fn)]


def stratified_folds(df: DataFrame, label: str, order: str, folds: int = FOLDS,
                     fold_col: str = "fold") -> DataFrame:
    """Folds as an unshuffled stratified k-fold split: within each class, rows
    in ``order`` are cut into contiguous runs whose sizes spread the classes
    evenly over the folds (class counts are two numbers read by the driver)."""
    counts = dict(df.groupBy(label).count().collect())
    # Classes are numbered in order of first appearance.
    first = df.agg(F.min_by(label, order)).first()[0]
    classes = [first] + sorted(k for k in counts if k != first)
    # Sorted labels; fold i takes every folds-th position starting at i.
    alloc, start = {}, 0
    for k in classes:
        n = counts[k]
        alloc[k] = [len(range((i - start) % folds + start, start + n, folds)) for i in range(folds)]
        start += n
    ranked = with_group_rank(df, [label], [F.col(order)], "_crank", None)
    fold = F.lit(None).cast("int")
    for k in classes:
        cum, expr = 0, F.lit(folds - 1)
        bounds = []
        for i in range(folds):
            cum += alloc[k][i]
            bounds.append((cum, i))
        for cum_i, i in reversed(bounds):
            expr = F.when(F.col("_crank") < cum_i, F.lit(i)).otherwise(expr)
        fold = F.when(F.col(label) == k, expr).otherwise(fold)
    return ranked.withColumn(fold_col, fold).drop("_crank")


@dataclass
class CVResult:
    model: LinearModel
    C: float
    scores: list = field(default_factory=list)  # (C, fold, f1)
    feature_model: object = None  # set when the features were fitted inside the search


def fit_logistic_cv(train: DataFrame, features: list[str], label: str, order: str,
                    Cs: list[float] = CS, folds: int = FOLDS, max_iter: int = MAX_ITER,
                    fold_features=None) -> CVResult:
    """Pick C by mean F1 of class 1 over stratified folds (first best C on
    ties, i.e. the smallest), then refit on all of ``train``. Balanced weights
    come from the whole training table. All (C, fold) models share the passes.

    ``fold_features`` (``train_rows -> model with .transform``) makes the search
    fold-safe: the feature encoders are refitted on each fold's training rows
    and applied to its held-out rows, then once more on all of ``train`` for
    the final model. ``fold_features="subtract"`` does the same for the library's own
    features in one aggregate, with all folds sharing the passes. Without it, ``train`` already carries features fitted on
    all training labels."""
    if fold_features is None:
        return fit_logistic_cvs(train, [features], label, order, Cs, folds, max_iter)[0]
    folded = stratified_folds(balanced_weights(train, label), label, order, folds).checkpoint(eager=True)
    grid = [(C, f) for C in Cs for f in range(folds)]
    if fold_features == "subtract":
        rows = fit_features_by_fold(folded, label, folds).transform(folded)
        data = solver_rows(rows, label)
        models = newton(data, len(features), grid, max_iter, folds)
        f1 = dict(zip(grid, _held_out_f1(data, models, grid, folds)))
        data.unpersist()
        feature_model = fit_features(folded, label)
    else:
        f1 = {}
        for f in range(folds):
            encoder = fold_features(folded.filter(F.col("fold") != f))
            part = solver_table(encoder.transform(folded), features, label, "weight", "fold")
            mine = [g for g in grid if g[1] == f]
            f1.update(zip(mine, _held_out_f1(part, newton(part, len(features), mine, max_iter), mine)))
            part.unpersist()
        feature_model = fold_features(folded)
    data = solver_table(feature_model.transform(folded), features, label, "weight")
    best = _best_c(f1, Cs, folds)
    model = newton(data, len(features), [(best, None)], max_iter)[0]
    data.unpersist()
    return CVResult(model, best, [(C, f, f1[C, f]) for C, f in grid], feature_model)


def _best_c(f1: dict, Cs: list[float], folds: int) -> float:
    mean = {C: sum(f1[C, f] for f in range(folds)) / folds for C in Cs}
    return max(Cs, key=lambda C: (mean[C], -Cs.index(C)))


def fit_logistic_cvs(train: DataFrame, feature_sets: list[list[str]], label: str, order: str,
                     Cs: list[float] = CS, folds: int = FOLDS, max_iter: int = MAX_ITER) -> list[CVResult]:
    """I17 for several sets of features of the same rows (``train`` carries them all): weights and
    folds are made once, and the models of all searches share the passes. A row with a missing feature
    takes no part in the search that uses it. The refits begin at the mean of the best C's folds."""
    names = list(dict.fromkeys(c for s in feature_sets for c in s))
    folded = stratified_folds(balanced_weights(train, label), label, order, folds)
    data = solver_rows(folded.select(F.array(*[F.col(c).cast("double") for c in names]).alias("x"), label, "weight", "fold"), label)
    columns = [tuple(names.index(c) for c in s) for s in feature_sets]
    grid = [(C, f) for C in Cs for f in range(folds)]
    specs, own = grid * len(columns), [c for c in columns for _ in grid]
    models = newton(data, len(names), specs, max_iter, columns=own)
    f1 = _held_out_f1(data, models, specs, columns=own)
    f1 = [dict(zip(grid, f1[k * len(grid):])) for k in range(len(columns))]
    best = [_best_c(x, Cs, folds) for x in f1]
    start = [np.mean([[*m.coefficients, m.intercept] for g, m in zip(grid, models[k * len(grid):]) if g[0] == C], axis=0)
             for k, C in enumerate(best)]
    final = newton(data, len(names), [(C, None) for C in best], max_iter, columns=columns, start=np.array(start))
    data.unpersist()
    return [CVResult(LinearModel(m.coefficients[list(c)], m.intercept), C, [(*g, x[g]) for g in grid])
            for m, c, C, x in zip(final, columns, best, f1)]


@dataclass
class BaselineModel:
    prior: float  # share of class 1 in training
    key: str
    seed: int

    def predict(self, df: DataFrame, pred_col: str = "y_pred", proba_col: str = "proba") -> DataFrame:
        """Stratified random guess: class 1 with the training share, drawn from a
        hash of the key (repeatable, independent of partitioning)."""
        u = F.conv(F.substring(hash_key(self.key, self.seed), 1, 8), 16, 10).cast("double") / float(16 ** 8)
        pred = (u < F.lit(self.prior)).cast("int")
        return df.withColumn(pred_col, pred).withColumn(proba_col, pred.cast("double"))


def fit_baseline(train: DataFrame, label: str, key: str = "listing_id", seed: int = 42) -> BaselineModel:
    """A stratified dummy classifier."""
    return BaselineModel(train.agg(F.avg(F.col(label).cast("double"))).first()[0], key, seed)


def coefficient_table(model: LinearModel, names: list[str]):
    """Coefficients by feature name, largest first, rounded to 4 digits,
    with the intercept (a few rows, built on the driver from the model)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    rows = [(n, round(float(c), 4)) for n, c in zip(names, model.coefficients)]
    rows.append(("intercept", round(float(model.intercept), 4)))
    return spark.createDataFrame(rows, "name string, coef double").orderBy(F.desc("coef"), "name")
