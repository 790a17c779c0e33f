import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.operators import sparse_model as S


def newton(x, y, w, C):
    xb = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(xb.shape[1])
    ridge = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-xb @ b))
        step = np.linalg.solve(C * (xb * (w * p * (1 - p))[:, None]).T @ xb + ridge, C * xb.T @ (w * (p - y)) + ridge @ b)
        b -= step
    return b


def table(spark, n=700, seed=2):
    rng = np.random.default_rng(seed)
    kind = rng.choice(["flat", "house"], n)
    town = rng.choice([f"t{i:02d}" for i in range(12)], n, p=np.array([30] + [1] * 11) / 41)
    beds, days = rng.integers(0, 9, n), rng.integers(0, 2400, n)
    z = 0.9 * (kind == "flat") - 0.6 * (town == "t03") + 0.2 * beds - 0.001 * days
    y = (rng.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(str(k), str(t), int(b), int(d), int(v)) for k, t, b, d, v in zip(kind, town, beds, days, y)]
    return rows, spark.createDataFrame(rows, "kind string, town string, beds int, days int, y int").repartition(5)


@pytest.mark.parametrize("C", [0.1, 10.0, 1e-4])
def test_equals_newton_on_dense_one_hot_columns(spark, C):
    rows, df = table(spark)
    columns, model = S.fit_one_hot_logistic(df, ["kind", "town"], ["beds", "days"], "y", C)
    towns = sorted({r[1] for r in rows})
    x = np.array([[float(r[0] == "house"), *[float(r[1] == t) for t in towns], r[2], r[3]] for r in rows])
    y = np.array([r[4] for r in rows], float)
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    want = newton(x, y, w, C)
    names = [r.name for r in columns.names().orderBy("idx").collect()]
    assert names == ["kind_house", *[f"town_{t}" for t in towns], "beds", "days"]
    np.testing.assert_allclose([*model.coefficients, model.intercept], want, atol=1e-6)
    scored = S.score_sparse(columns, model, df.withColumn("idx", F.lit(1))).collect()
    p = {r[:4]: 1 / (1 + np.exp(-(a @ want[:-1] + want[-1]))) for r, a in zip(rows, x)}
    assert all(r.proba == pytest.approx(p[r.kind, r.town, r.beds, r.days], abs=1e-6) for r in scored)


def test_nulls_unseen_levels_and_the_bound(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("b", None, 0), (None, 2.0, 1), ("c", 0.0, 0), ("a", 3.0, 0), ("b", 5.0, 1)],
                               "c string, x double, y int")
    columns, model = S.fit_one_hot_logistic(df, ["c"], ["x"], "y", 1.0)
    assert [r.name for r in columns.names().orderBy("idx").collect()] == ["c_a", "c_b", "c_c", "x"]
    other = columns.transform(spark.createDataFrame([("z", 0.0), (None, None), ("c", 7.0)], "c string, x double"))
    assert [(list(r._idx), list(r._val)) for r in other.collect()] == [([], []), ([], []), ([2, 3], [1.0, 7.0])]
    assert S.sparse_coefficients(columns, model).count() == 5
    with pytest.raises(ValueError):
        S.fit_columns(df, ["c"], ["x"], max_width=3)


def test_state_is_vectors_and_a_wide_table_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(f"v{i % 3000}", float(rng.normal()), int(rng.random() < 0.4)) for i in range(6000)]
    df = spark.createDataFrame(rows, "c string, x double, y int")
    columns, model = S.fit_one_hot_logistic(df, ["c"], ["x"], "y", 1.0)
    assert columns.width == 3001 and np.isfinite(model.coefficients).all()
