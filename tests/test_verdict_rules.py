"""Rules that must hold at every size: null keys, one answer for every quantile
plan, lambdas outside the first grid, groups that cannot be fitted, NaN, sort and
salt, and CSV columns by name."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricewise.functions.quantiles import group_quantiles
from pricewise.operators import clean as C
from pricewise.operators import distribution as D
from pricewise.operators import features as FT
from pricewise.operators import growth as G
from pricewise.operators import prices as P
from pricewise.operators import rows as RW
from pricewise.sources import read_listings
from pricewise.sources.readers import read_text, rejected_cells
from pricewise.sources.schema import LISTING_SCHEMA

from .conftest import listing_rows

KEYS = ["location", "property_type"]


def towns(spark):
    rows, day = [], dt.date(2021, 1, 1)
    for i in range(90):
        town = ["A", "B", None][i % 3]
        rows.append((town, "house" if i % 2 else None if i % 10 == 0 else "flat", day + dt.timedelta(days=i % 4),
                     None if town == "B" and i % 4 == 2 else 100.0 + 7 * i % 23, None if i % 4 == 1 else float(i % 5)))
    return spark.createDataFrame(rows, "location string, property_type string, listing_dt date, asking_price double, "
                                       "bathroom_count double")


def as_set(df):
    return sorted(str(r.asDict()) for r in df.select(*sorted(df.columns)).collect())


def test_quantile_plans_give_the_same_rows(spark):
    df = towns(spark)
    keys = [*KEYS, "listing_dt"]
    plain = as_set(group_quantiles(df, keys, "asking_price", [0.25, 0.5], method="percentile", count_col="n"))
    assert any("None" in r for r in plain)                       # a group without values keeps its row
    assert not any("'location': None" in r or "'property_type': None" in r for r in plain)
    assert as_set(group_quantiles(df, keys, "asking_price", [0.25, 0.5], method="ranked", count_col="n")) == plain
    for hot in (0, 1, 2, 3, 10 ** 6):
        assert as_set(group_quantiles(df, keys, "asking_price", [0.25, 0.5], count_col="n", hot_rows=hot)) == plain
    whole = as_set(group_quantiles(df, [], "asking_price", [0.5], method="percentile", count_col="n"))
    assert as_set(group_quantiles(df, [], "asking_price", [0.5], hot_rows=5, count_col="n")) == whole


def test_daily_medians_do_not_depend_on_the_group_size(spark, monkeypatch):
    df = towns(spark)
    plain = as_set(P.daily_medians(df, ["bathroom_count", "asking_price"], method="percentile"))
    assert any("'bathroom_count': None" in r for r in plain)
    for hot in (1, 3, 10 ** 6):
        monkeypatch.setattr(P, "HOT_ROWS", hot)
        assert as_set(P.daily_medians(df, ["bathroom_count", "asking_price"])) == plain


def test_null_keys_are_in_no_group(spark):
    df = towns(spark)
    for out in (P.group_mean(df, KEYS, "asking_price"), P.daily_price(df, agg="mean"), D.histogram(df, "asking_price", by=KEYS),
                G.trend_fit(df.withColumn("x", F.lit(1)), KEYS, "x", "asking_price")):
        assert out.filter("location IS NULL OR property_type IS NULL").count() == 0
    rows = P.with_group_median(df)
    assert rows.count() == df.count() and rows.filter("location IS NULL AND median_price IS NOT NULL").count() == 0


def daily(spark, groups):
    rows = [(g, "house", dt.date(2020, 1, 1) + dt.timedelta(days=i), p) for g, ps in groups.items() for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "location string, property_type string, listing_dt date, asking_price double")


def test_lambda_outside_the_first_grid(spark):
    rng = np.random.default_rng(8)
    far = np.exp(1 + 0.03 * np.log1p(rng.gamma(2.0, 2.0, 400)) ** 0.5)
    u = np.log(far) - np.log(far).mean()
    grid = np.arange(-400, 400, 0.01)
    best = grid[np.argmin([np.var(u) if abs(x) < 1e-9 else np.var(np.expm1(x * u) / x) for x in grid])]
    assert abs(best) > 5.2
    fit = {r.location: r.normalize_lambda for r in G.boxcox_fit(daily(spark, {"far": far.tolist(), "near": [1.0, 2.0, 4.5]}),
                                                                 KEYS).collect()}
    assert fit["far"] == pytest.approx(best, abs=0.02) and abs(fit["near"]) < 5


def test_groups_that_cannot_be_fitted_keep_a_row(spark):
    prices = {"ok": [100.0, 120.0, 150.0, 170.0, 240.0], "flat": [5.0] * 4, "single": [7.0], "negative": [10.0, -1.0, 12.0]}
    d = daily(spark, prices)
    out = {r.location: r for r in G.boxcox_growth(d, tuple(KEYS)).collect()}
    assert set(out) == set(prices)
    assert out["ok"].normalize_lambda is not None and out["ok"].n == 5
    for g in ("flat", "single", "negative"):
        assert out[g].normalize_lambda is None and out[g].growth_975_days is None and out[g].n == 0
    rows, _ = G.boxcox_transform(d, G.boxcox_fit(d, KEYS), KEYS)
    assert rows.count() == d.count()
    k = {r.location: r.density for r in D.kde(d, "asking_price", by=KEYS).filter("location IN ('flat', 'single')").collect()}
    assert k == {"flat": None, "single": None}


def test_growth_without_a_value_ranks_last(spark):
    df = spark.createDataFrame([("a", "t", 1.2), ("b", "t", float("nan")), ("c", "t", None), ("d", "t", 0.9)],
                               "location string, property_type string, growth_2_yr double")
    got = [(r.location, r.grew) for r in G.growth_ranking(df).orderBy("rank").collect()]
    assert got == [("a", True), ("d", False), ("b", None), ("c", None)]


def test_log_linear_growth_does_not_depend_on_day_zero(spark):
    d = daily(spark, {"a": [100.0, 130.0, 90.0, 160.0], "b": [5.0, 6.0]})
    one = {r.location: r for r in G.growth_log_linear(d).collect()}
    rows = G.days_since_start(d.withColumn("y", F.log10("asking_price")), KEYS, "listing_dt", "x")
    two = {r.location: r for r in G.trend_fit(rows, KEYS, "x", "y").collect()}
    for g in one:
        assert one[g].coef == pytest.approx(two[g].coef) and one[g].intercept == pytest.approx(two[g].intercept)


def test_sorted_output_of_a_large_town_is_cut(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 6, "big").otherwise(F.concat(F.lit("t"), F.col("id") % 40)).alias("location"),
        F.lit("house").alias("property_type"), (F.col("id") * 37 % 9973).cast("double").alias("asking_price"),
        F.col("id").alias("listing_id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = P.with_group_median(df, method="percentile")
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) <= 2 * sum(sizes) / 8


def test_nothing_random_feeds_a_shuffle():
    import inspect

    from pricewise.plans import joins
    assert "rand()" not in inspect.getsource(joins)
    assert "monotonically_increasing_id" not in inspect.getsource(RW.with_group_rank)


def test_one_hot_transform_of_new_levels(spark):
    fit = FT.one_hot_fit(spark.createDataFrame([("x",), ("y",), ("z",)], "c string"), ["c"])
    out = fit.transform(spark.createDataFrame([("y", 1), ("new", 2), (None, 3)], "c string, k int")).orderBy("k").collect()
    assert [(r.c_x, r.c_y, r.c_z) for r in out] == [(0, 1, 0), (0, 0, 0), (0, 0, 0)] and fit.names() == ["c_x", "c_y", "c_z"]


HEADER = "asking_price,remark,listing_id,location,listing_dt,bathroom_count,tenure,property_type,listing_type,bedroom_count\n"


def test_csv_columns_are_found_by_name(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_text(HEADER + '250000,"x, y",1,A,2021-01-03 10:00:00,NaN,freehold,house,buy,3.0\n'
                          '"250,000",,2,B,not a date,1,leasehold,flat,buy,2.5\n,,3,,,,,,,\n')
    rows = {r.listing_id: r for r in read_listings(spark, str(p)).collect()}
    assert rows[1].asking_price == 250000.0 and rows[1].bedroom_count == 3 and rows[1].bathroom_count is None
    assert rows[1].location == "A" and rows[1].listing_dt == dt.datetime(2021, 1, 3, 10)
    assert rows[2].asking_price is None and rows[2].bedroom_count is None and rows[2].listing_dt is None
    assert rows[3].location is None and rows[3].asking_price is None
    bad = {r.column_name: r.rejected for r in rejected_cells(read_text(spark, str(p)), LISTING_SCHEMA).collect()}
    assert {c for c, n in bad.items() if n} == {"asking_price", "listing_dt", "bedroom_count"}


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "l.csv").write_text("listing_id,location\n1,A\n")
    with pytest.raises(ValueError, match="asking_price"):
        read_listings(spark, str(tmp_path / "l.csv"))


def test_filters_pass_the_parquet_reader(spark, tmp_path):
    df = listing_rows(spark, [(1, "2021-01-01", "buy", "flat", "freehold", "A", 3, 1.0, 400000.0),
                              (2, "2021-01-01", "buy", "house", "freehold", "A", 0, float("nan"), float("nan")),
                              (3, "2021-01-01", "buy", "house", "freehold", "A", 0, 20.0, 300000.0)])
    df.write.parquet(str(tmp_path / "l"))
    listings = read_listings(spark, str(tmp_path / "l"), "parquet")
    kept = C.clean_listings(listings).filter(F.col("listing_dt") > F.lit("2020-01-01").cast("timestamp"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert all(x in pushed for x in ("GreaterThan(listing_dt", "LessThan(bedroom_count", "(asking_price,", "(bathroom_count,"))
    rows = {r.listing_id: r for r in kept.collect()}
    assert set(rows) == {1, 2}                                   # a NaN price matches no rule
    assert rows[2].asking_price is None and rows[2].bathroom_count is None
    assert C.outlier_report(listings).filter("rule = 'no_beds_dear'").count() == 1


def test_growth_factor_is_the_ratio_of_two_prices(spark):
    from pricewise.functions.scalar import growth_factor
    lam, std, coef, b, mean, days = 0.3, 2.0, 0.001, -0.4, 12.0, 970
    want = 1.0
    price = lambda y: ((y * std + mean) * lam + 1) ** (1 / lam)                # noqa: E731
    want = price(coef * days + b) / price(b)
    df = spark.range(1).select(*[F.lit(v).alias(n) for n, v in (("l", lam), ("s", std), ("c", coef), ("b", b), ("m", mean))])
    got = df.select(growth_factor("l", "s", "c", "b", "m", days).alias("g"),
                    growth_factor("l", "s", F.lit(-1.0), "b", "m", days).alias("none")).first()
    assert got.g == pytest.approx(want) and got.none is None and not math.isnan(got.g)
