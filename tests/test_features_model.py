import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pricewise.operators import evaluate as EV
from pricewise.operators import features as FT
from pricewise.operators import model as M


def test_mean_encoder_unseen_is_null(spark):
    train = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "c string, y int")
    enc = FT.MeanEncoder(["c"]).fit(train, "y")
    out = {r.id: r.c for r in enc.transform(spark.createDataFrame([(1, "a"), (2, "b"), (3, "z")], "id int, c string"))
           .collect()}
    assert out == {1: 0.5, 2: 1.0, 3: None}


def test_min_max_and_zero_range(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    m = FT.min_max_fit(df, ["a", "b"])
    got = sorted((r.a, r.b) for r in m.transform(df).collect())
    assert got == [(0.0, 0.0), (1.0, 0.0)]


def test_one_hot_binary_keeps_second_level(spark):
    df = spark.createDataFrame([(1, "flat", "x"), (2, "house", "y"), (3, "house", "z")], "id int, t string, u string")
    out = FT.one_hot(df, ["t", "u"])
    assert sorted(out.columns) == ["id", "t_house", "u_x", "u_y", "u_z"]


def test_balanced_weights_sum_to_n(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "id int, y int")
    w = FT.balanced_weights(df, "y").toPandas()
    assert math.isclose(w.weight.sum(), 10) and math.isclose(w[w.y == 1].weight.iloc[0], 10 / (2 * 3))


def newton_logistic(X, y, w, C, iters=50):
    Xb = np.hstack([X, np.ones((len(X), 1))])
    beta = np.zeros(Xb.shape[1])
    reg = np.eye(Xb.shape[1]) / C
    reg[-1, -1] = 0.0
    for _ in range(iters):
        p = 1 / (1 + np.exp(-Xb @ beta))
        grad = Xb.T @ (w * (p - y)) + reg @ beta
        hess = Xb.T @ (Xb * (w * p * (1 - p))[:, None]) + reg
        beta -= np.linalg.solve(hess, grad)
    return beta


def test_weighted_l2_logistic_matches_newton(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(400, 3))
    y = (X @ [1.0, -2.0, 0.5] + rng.normal(size=400) > 0.8).astype(int)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y)
    df = FT.balanced_weights(spark.createDataFrame(pdf), "y")
    w = df.toPandas()
    model = M.fit_logistic(df, ["a", "b", "c"], "y", C=0.1)
    beta = newton_logistic(w[["a", "b", "c"]].values, w.y.values, w.weight.values, 0.1)
    np.testing.assert_allclose(list(model.coefficients) + [model.intercept], beta, atol=1e-8)


def test_search_matches_separate_newton_fits(spark):
    rng = np.random.default_rng(5)
    X = rng.normal(size=(300, 2))
    y = (X @ [1.5, -1.0] + rng.normal(size=300) > 0.5).astype(int)
    pdf = pd.DataFrame(X, columns=["a", "b"]).assign(y=y, idx=np.arange(300))
    df = spark.createDataFrame(pdf)
    res = M.fit_logistic_cv(df, ["a", "b"], "y", "idx", Cs=[1e-3, 0.1, 10.0], folds=4)
    rows = M.stratified_folds(FT.balanced_weights(df, "y"), "y", "idx", 4).toPandas()
    want = {}
    for C in (1e-3, 0.1, 10.0):
        for f in range(4):
            tr, te = rows[rows.fold != f], rows[rows.fold == f]
            b = newton_logistic(tr[["a", "b"]].values, tr.y.values, tr.weight.values, C)
            p = np.hstack([te[["a", "b"]].values, np.ones((len(te), 1))]) @ b > 0
            tp, fp, fn = (p & (te.y == 1)).sum(), (p & (te.y == 0)).sum(), (~p & (te.y == 1)).sum()
            want[C, f] = 2 * tp / (2 * tp + fp + fn)
    assert {(C, f): s for C, f, s in res.scores} == want
    b = newton_logistic(rows[["a", "b"]].values, rows.y.values, rows.weight.values, res.C)
    np.testing.assert_allclose([*res.model.coefficients, res.model.intercept], b, atol=1e-8)


def test_stratified_folds_follow_the_split_rule(spark):
    y = [1, 0, 0, 1, 0, 0, 0, 1, 0, 0, 1, 0, 0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(y)], "idx long, y int")
    got = [r.fold for r in M.stratified_folds(df, "y", "idx", folds=5).orderBy("idx").collect()]
    # Direct rule: classes coded by first appearance, sorted codes dealt round-robin to folds,
    # then each class's rows in order take their folds in runs.
    codes = {1: 0, 0: 1}
    enc = np.array([codes[v] for v in y])
    order = np.sort(enc)
    alloc = np.array([np.bincount(order[i::5], minlength=2) for i in range(5)])
    want = np.empty(len(y), dtype=int)
    for k in range(2):
        want[enc == k] = np.arange(5).repeat(alloc[:, k])
    assert got == list(want)


def test_roc_auc_matches_pairwise_count(spark):
    rng = np.random.default_rng(8)
    s = rng.integers(0, 20, 300) / 20.0
    y = (rng.random(300) < s).astype(int)
    out = EV.roc_points(spark.createDataFrame(pd.DataFrame({"revision": y, "proba": s}))).toPandas()
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert math.isclose(out.auc.iloc[0], auc, rel_tol=1e-12)
    top = out.sort_values("threshold").iloc[0]
    assert top.tpr == 1.0 and top.fpr == 1.0


def test_confusion_has_all_cells(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "revision int, y_pred int")
    got = {(r.label, r.prediction): r["count"] for r in EV.confusion(df).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 0): 0, (1, 1): 2}


def test_fold_safe_search_refits_features_per_fold(spark):
    rng = np.random.default_rng(11)
    n = 400
    cat = rng.choice(["a", "b", "c"], n)
    x = rng.normal(size=n)
    y = ((cat == "a") * 1.0 + x + rng.normal(size=n) > 0.7).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"idx": np.arange(n), "cat": cat, "x": x, "y": y}))
    seen = []

    def fold_features(rows):
        seen.append(rows.count())
        enc = FT.MeanEncoder(["cat"]).fit(rows, "y")
        return enc

    res = M.fit_logistic_cv(df, ["cat", "x"], "y", "idx", Cs=[0.01, 1.0], folds=3,
                            fold_features=fold_features)
    assert len(res.scores) == 6 and res.C in (0.01, 1.0) and res.feature_model is not None
    assert sorted(seen)[:3] == sorted(seen[:3]) and all(s < n for s in seen[:3]) and seen[-1] == n


def test_searches_over_two_feature_sets_share_passes(spark, monkeypatch):
    """Two searches at once give what each gives alone, in the passes of the slower one; a missing
    feature keeps a row out of the search that uses it only."""
    import random
    import numpy as np
    from pyspark.sql import functions as F
    from pricewise.operators import features as FT
    from pricewise.operators import model as M
    rng = random.Random(8)
    rows = []
    for i in range(240):
        a, b = rng.random(), rng.gauss(0, 1)
        rows.append((i, f"{rng.random():.9f}", a, b, None if i % 17 == 0 else a * b, int(a + 0.5 * a * b + 0.3 * rng.gauss(0, 1) > 0.4)))
    df = spark.createDataFrame(rows, "id long, k string, a double, b double, ab double, y int")
    sets, Cs = [["a", "b"], ["a", "b", "ab"]], [0.01, 1.0, 100.0]
    passes, sums = [], M._sums
    monkeypatch.setattr(M, "_sums", lambda *a: (passes.append(1), sums(*a))[1])
    got = M.fit_logistic_cvs(df, sets, "y", "k", Cs, 3)
    shared = len(passes)
    folded = M.stratified_folds(FT.balanced_weights(df, "y"), "y", "k", 3)
    grid, alone = [(C, f) for C in Cs for f in range(3)], 0
    for features, res in zip(sets, got):
        passes.clear()
        data = M.solver_table(folded, features, "y", "weight", "fold")
        models = M.newton(data, len(features), grid)
        f1 = dict(zip(grid, M._held_out_f1(data, models, grid)))
        assert [s for _, _, s in res.scores] == [f1[g] for g in grid]
        want = M.newton(data, len(features), [(res.C, None)])[0]
        assert np.allclose([*res.model.coefficients, res.model.intercept], [*want.coefficients, want.intercept], atol=1e-8)
        alone += len(passes)
        one = M.fit_logistic_cv(df, features, "y", "k", Cs, 3)
        assert one.C == res.C and np.allclose(one.model.coefficients, res.model.coefficients, atol=1e-8)
    assert shared < 0.7 * alone


def test_both_models_read_the_tables_once(spark, monkeypatch):
    from pricewise.plans import catalog_revisions as CR
    from pricewise.plans.catalog import QUERIES
    made, dataset = [], CR.model_dataset
    monkeypatch.setattr(CR, "model_dataset", lambda *a: (made.append(1), dataset(*a))[1])
    assert QUERIES["i25_false_positives_of_both_models"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1
