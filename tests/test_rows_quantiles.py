import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pricewise.functions.quantiles import group_quantiles
from pricewise.operators import rows as RW


def test_row_index_is_a_permutation_in_order(spark):
    df = spark.range(0, 1000).withColumn("k", F.md5(F.col("id").cast("string")))
    idx = RW.with_row_index(df, [F.col("k")], num_partitions=7).orderBy("row_idx").toPandas()
    assert list(idx.row_idx) == list(range(1000))
    assert list(idx.k) == sorted(idx.k)


def test_prefix_sums_match_numpy(spark):
    pdf = pd.DataFrame({"x": np.arange(500) * 1.0, "w": np.arange(500) % 7})
    out = RW.with_prefix_sums(spark.createDataFrame(pdf), [F.col("x")], ["w"], num_partitions=5) \
        .orderBy("x").toPandas()
    assert list(out.w_cum) == list(np.cumsum(pdf.w))


def test_split_sizes(spark):
    df = spark.range(0, 103).withColumnRenamed("id", "listing_id")
    out = RW.train_test_split(df, "listing_id", 0.2, 42)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts["test"] == math.ceil(0.2 * 103) and counts["train"] + counts["test"] == 103


def test_sample_fraction_is_repeatable(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "listing_id")
    a = RW.sample_fraction(df, "listing_id", 0.4).count()
    b = RW.sample_fraction(df.repartition(13), "listing_id", 0.4).count()
    assert a == b and 700 < a < 900


def test_quantiles_with_a_hot_group_match_pandas(spark):
    rng = np.random.default_rng(1)
    g = np.where(rng.random(3000) < 0.34, 0, rng.integers(1, 20, 3000))  # group 0 holds a third
    pdf = pd.DataFrame({"g": g, "x": rng.normal(size=3000).round(2)})
    want = pdf.groupby("g").x.quantile([0.25, 0.5, 0.75]).unstack()
    for method in ("ranked", "percentile", "narrowed"):
        got = group_quantiles(spark.createDataFrame(pdf), ["g"], "x", [0.25, 0.5, 0.75], method=method) \
            .toPandas().set_index("g").sort_index()
        np.testing.assert_allclose(got[["q25", "q50", "q75"]].values, want.values, rtol=1e-12)
    whole = group_quantiles(spark.createDataFrame(pdf), [], "x", [0.5]).first()[0]
    assert abs(whole - pdf.x.median()) < 1e-12


def test_group_rank_unchanged_after_repartition(spark):
    df = spark.range(0, 300).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 101).alias("v"))
    a = RW.with_group_rank(df, ["g"], [F.col("v")], tiebreak=True).select("g", "rank", "v").collect()
    b = RW.with_group_rank(df.repartition(11), ["g"], [F.col("v")], tiebreak=True) \
        .select("g", "rank", "v").collect()
    assert sorted(a) == sorted(b)


def test_auto_quantiles_mix_plans_for_hot_and_small_groups(spark):
    rng = np.random.default_rng(2)
    g = np.where(rng.random(3000) < 0.34, 0, rng.integers(1, 20, 3000))
    pdf = pd.DataFrame({"g": g, "x": rng.normal(size=3000).round(2)})
    want = pdf.groupby("g").x.quantile([0.25, 0.5, 0.75]).unstack()
    got = group_quantiles(spark.createDataFrame(pdf), ["g"], "x", [0.25, 0.5, 0.75], method="auto",
                          hot_rows=500, count_col="n").toPandas().set_index("g").sort_index()
    np.testing.assert_allclose(got[["q25", "q50", "q75"]].values, want.values, rtol=1e-12)
    assert list(got.n) == list(pdf.groupby("g").size())
    whole = group_quantiles(spark.createDataFrame(pdf), [], "x", [0.5], method="auto", hot_rows=500).first()[0]
    assert abs(whole - pdf.x.median()) < 1e-12


def test_narrowing_ties_wide_ranges_and_empty_groups(spark, monkeypatch):
    from pricewise.functions import quantiles as Q
    monkeypatch.setattr(Q, "KEEP", 5)
    rng = np.random.default_rng(6)
    groups = {"ties": [0.0] * 400 + [100.0] * 300 + list(100 + rng.random(99)), "wide": [-1.7e308, 1.7e308, *rng.normal(size=60)],
              "fine": (1 + np.arange(70) * 2.0 ** -52).tolist(), "one": [4.25], "two": [1.0, 2.0], "same": [3.0] * 50,
              "skewed": (10.0 ** rng.uniform(-300, 300, 200)).tolist()}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("none", None)] * 3 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    probs = [0.0, 0.1, 0.5, 0.501, 0.9, 1.0]
    got = {r.g: r for r in group_quantiles(df, ["g"], "x", probs, list("abcdef"), method="narrowed", count_col="n").collect()}
    assert set(got) == {*groups, "none"} and got["none"].n == 0 and got["none"].c is None
    for g, vs in groups.items():
        vs = sorted(vs)
        for p, x in zip(probs, got[g][1:7]):
            k = (len(vs) - 1) * p
            lo, hi = vs[math.floor(k)], vs[math.ceil(k)]
            assert x == (lo if k == math.floor(k) else lo + (hi - lo) * (k - math.floor(k))), (g, p)
    empty = group_quantiles(df.filter("g = 'none'"), [], "x", [0.5], ["m"], method="narrowed", count_col="n").collect()
    assert [tuple(r) for r in empty] == [(None, 0)]


def test_split_by_radix_selection(spark):
    """The marked rows are the last ones of the seeded order, for any share and many digits."""
    df = spark.range(0, 1357).withColumnRenamed("id", "listing_id").repartition(5)
    order = [r.listing_id for r in RW.seeded_shuffle(df, "listing_id", 7).collect()]
    for share in (0.0, 0.2, 0.5, 0.999, 1.0):
        got = {r.listing_id for r in RW.train_test_split(df, "listing_id", share, 7).filter("split = 'test'").collect()}
        n = math.ceil(1357 * share)
        assert got == set(order[1357 - n:] if n else [])
    keyed = df.withColumn("_hk", RW.hash_key("listing_id", 7))
    for digits in (1, 2, 32):
        cut = RW.nth_hash(keyed, lambda n: n - 300, digits=digits)
        assert keyed.filter(F.col("_hk") < cut).count() == 1057
    same = spark.createDataFrame([(None,)] * 5 + [(3,)] * 20, "listing_id long")
    assert {r.split for r in RW.train_test_split(same, "listing_id", 0.2).filter("listing_id = 3").collect()} == {"test"}
    assert RW.train_test_split(df.limit(0), "listing_id").count() == 0


def test_split_neither_sorts_nor_writes_the_table(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "listing_id")
    plan = RW.train_test_split(df, "listing_id")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan and "ExistingRDD" not in plan, plan
    out = RW.train_test_split(df, "listing_id", index_col="i").toPandas()
    assert sorted(out.i) == list(range(500)) and (out[out.split == "test"].i >= 400).all()


def test_value_counts_of_several_columns_read_once(spark):
    from pricewise.operators import profile as PR
    df = spark.createDataFrame([("a", 1, None), ("a", 2, None), (None, 2, None), ("b", 2, None)], "x string, y int, z double")
    out = PR.value_counts_of(df, ["x", "y", "z"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Scan") == 1
    assert sorted(map(tuple, out.collect())) == [("x", "a", 2), ("x", "b", 1), ("y", "1", 1), ("y", "2", 3)]


def test_split_query_gives_every_row_its_place(spark):
    """The registered split keeps the position in the seeded order, as its first SQL did."""
    from pricewise.plans.catalog import QUERIES
    out = QUERIES["f7_train_test_split"](spark, "/root/testdata/sf0.001").toPandas().sort_values(["shuffle_key", "listing_id"])
    n = len(out)
    assert list(out.row_idx) == list(range(n))
    assert list(out.split == "test") == [i >= n - math.ceil(n * 0.2) for i in range(n)]
