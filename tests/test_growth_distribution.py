import datetime as dt
import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pricewise.functions.scalar import boxcox_inverse, growth_factor
from pricewise.operators import distribution as D
from pricewise.operators import growth as G


def daily_frame(spark, groups):
    rows = []
    for name, prices in groups.items():
        for i, p in enumerate(prices):
            rows.append((name, "house", dt.date(2020, 1, 1) + dt.timedelta(days=int(i * 3)), float(p)))
    return spark.createDataFrame(rows, "location string, property_type string, listing_dt date, asking_price double")


def llf(x, lam):
    # Box-Cox log-likelihood of x divided by its geometric mean: the same
    # maximiser as for x itself, without underflow at large |lambda|.
    x = x / np.exp(np.log(x).mean())
    y = np.log(x) if lam == 0 else (x ** lam - 1) / lam
    return (lam - 1) * np.log(x).sum() - len(x) / 2 * np.log(y.var())


def test_boxcox_fit_matches_dense_search(spark):
    rng = np.random.default_rng(3)
    groups = {"A": rng.lognormal(12, 0.3, 80), "B": rng.gamma(4, 50000, 60) + 100000,
              "C": [250000.0] * 5, "D": [300000.0]}
    fit = {r.location: r.normalize_lambda for r in
           G.boxcox_fit(daily_frame(spark, groups), ["location", "property_type"]).collect()}
    for g in ("A", "B"):
        grid = np.arange(-5, 5, 1e-4)
        best = grid[np.argmax([llf(np.asarray(groups[g]), l) for l in grid])]
        assert abs(fit[g] - best) < 2e-4, (g, fit[g], best)
    assert fit["C"] is None and fit["D"] is None  # constant price, single day


def test_boxcox_transform_standardises_and_matches_formula(spark):
    rng = np.random.default_rng(4)
    x = rng.lognormal(12, 0.3, 50)
    daily = daily_frame(spark, {"A": x})
    params = G.boxcox_fit(daily, ["location", "property_type"])
    rows, groups = G.boxcox_transform(daily, params, ["location", "property_type"])
    g = groups.first()
    lam = g.normalize_lambda
    y = (x ** lam - 1) / lam
    assert math.isclose(g.normalized_mean, y.mean(), rel_tol=1e-9)
    assert math.isclose(g.normalized_std, y.std(), rel_tol=1e-7)
    t = np.array([r.target for r in rows.orderBy("listing_dt").collect()])
    np.testing.assert_allclose(t, (y - y.mean()) / y.std(), atol=1e-7)


def test_inverse_of_transform_and_limits(spark):
    df = spark.createDataFrame([(250000.0, 0.3), (250000.0, 0.0), (80000.0, -1.2)], "x double, lam double")
    m, s = 2.0, 0.5
    y = F.when(F.col("lam") == 0, F.log("x")).otherwise((F.pow("x", F.col("lam")) - 1) / F.col("lam"))
    out = df.select("x", boxcox_inverse((y - m) / s, F.col("lam"), F.lit(m), F.lit(s)).alias("back")).collect()
    for r in out:
        assert math.isclose(r.x, r.back, rel_tol=1e-9)
    g = spark.createDataFrame([(0.0, 0.5, 0.0, 1.0, 3.0), (0.7, 0.5, 0.0, 1.0, 3.0), (0.0, 0.5, 1e-3, 1.0, 3.0)],
                              "lam double, s double, c double, b double, m double")
    vals = [r[0] for r in g.select(growth_factor("lam", "s", "c", "b", "m", 970)).collect()]
    assert vals[0] == 1.0 and math.isclose(vals[1], 1.0) and math.isclose(vals[2], math.exp(0.5 * 1e-3 * 970))


def test_trend_fit_matches_polyfit(spark):
    rng = np.random.default_rng(5)
    x = np.arange(40.0)
    y = 3 + 0.2 * x + rng.normal(size=40)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x, "y": y}))
    fit = G.trend_fit(df, ["g"], "x", "y").first()
    slope, icpt = np.polyfit(x, y, 1)
    assert math.isclose(fit.coef, slope, rel_tol=1e-9) and math.isclose(fit.intercept, icpt, rel_tol=1e-9)
    r2 = 1 - ((y - (icpt + slope * x)) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert math.isclose(fit.r2, r2, rel_tol=1e-9)


def test_observed_growth_first_and_last_five(spark):
    daily = daily_frame(spark, {"A": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]})
    r = G.observed_growth(daily, ["location", "property_type"]).first()
    assert (r.lower_act, r.upper_act) == (3.0, 10.0)


def test_histogram_edges_and_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]], "x double")
    h = D.histogram(df, "x", bins=10).orderBy("bin").collect()
    counts, _ = np.histogram(np.arange(11.0), bins=10)
    assert [r["count"] for r in h] == list(counts) and sum(counts) == 11  # 10 falls in the last bin
    e = D.histogram(df, "x", edges=[1.0, 5.0, 8.0]).orderBy("bin").collect()
    assert [r["count"] for r in e] == list(np.histogram(np.arange(11.0), bins=[1, 5, 8])[0])
    const = D.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), "x", bins=10).collect()
    assert {r.bin: r["count"] for r in const if r["count"]} == {5: 2}
    dens = D.histogram(df, "x", bins=5, density=True).toPandas()
    assert math.isclose((dens.density * (dens.bin_hi - dens.bin_lo)).sum(), 1.0)


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(10, 2, 200)
    out = D.kde(spark.createDataFrame(pd.DataFrame({"g": 1, "v": x})), "v", ["g"], points=50).orderBy("point").toPandas()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 50)
    want = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    np.testing.assert_allclose(out.density.values, want, rtol=1e-9)


def test_qq_points_match_filliben_and_normal_quantiles(spark):
    x = [5.0, 1.0, 3.0, 2.0, 4.0, 3.0]
    df = spark.createDataFrame([(1, v) for v in x], "g int, v double")
    pts = D.qq_points(df, ["g"], "v").orderBy("rank").collect()
    n = len(x)
    m = [(i + 1 - 0.3175) / (n + 0.365) for i in range(n)]
    m[-1] = 0.5 ** (1 / n)
    m[0] = 1 - m[-1]
    nd = statistics.NormalDist()
    assert [p.sample for p in pts] == sorted(x)
    for p, mi in zip(pts, m):
        assert math.isclose(p.theoretical, nd.inv_cdf(mi), rel_tol=1e-12, abs_tol=1e-15)


def test_qq_plans_agree(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 300), "v": rng.normal(size=300).round(1)})
    df = spark.createDataFrame(pdf)
    a = D.qq_points(df, ["g"], "v", method="ranked").orderBy("g", "rank").toPandas()
    b = D.qq_points(df, ["g"], "v", method="window").orderBy("g", "rank").toPandas()
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False)


def test_daily_price_pluggable_aggregate_and_transform(spark):
    from pricewise.operators import prices as P
    rows = [("A", "house", dt.date(2021, 1, 1), p) for p in (100.0, 200.0, 600.0)] + \
           [("A", "house", dt.date(2021, 1, 2), 50.0)]
    df = spark.createDataFrame(rows, "location string, property_type string, listing_dt date, asking_price double")
    got = {r.listing_dt: r.asking_price for r in P.daily_price(df, agg=lambda c: F.max(c)).collect()}
    assert got == {dt.date(2021, 1, 1): 600.0, dt.date(2021, 1, 2): 50.0}
    med = {r.listing_dt: r.asking_price for r in P.daily_price(df, agg="median").collect()}
    assert med[dt.date(2021, 1, 1)] == 200.0
    scaled = P.daily_price(df, agg="mean", transform=lambda d: d.withColumn("asking_price", F.col("asking_price") / 10))
    assert {r.listing_dt: r.asking_price for r in scaled.collect()} == {dt.date(2021, 1, 1): 30.0,
                                                                        dt.date(2021, 1, 2): 5.0}
