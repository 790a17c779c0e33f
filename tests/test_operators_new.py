"""Co-moments, fast Gauss transform, out-of-fold features, pipeline stages, CSV scan, sink."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pricewise.operators import comoments as CM
from pricewise.operators import distribution as D
from pricewise.operators import evaluate as EV
from pricewise.operators import features as FT
from pricewise.operators import ml as ML
from pricewise.operators import model as M
from pricewise.sources import readers as R
from pricewise.sources.schema import LISTING_SCHEMA


def test_comoments_match_pandas_pairwise(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(500, 4)) @ rng.normal(size=(4, 4)), columns=list("abcd"))
    pdf["a"] += 1e9                                          # far from zero: no cancellation
    pdf["flat"] = 7.0
    pdf.loc[rng.random(500) < 0.2, "b"] = np.nan
    pdf.loc[rng.random(500) < 0.3, "c"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).astype(object).values.tolist(),
                               "a double, b double, c double, d double, flat double").repartition(7)
    want = pdf.corr()
    for r in CM.comoments(df, list(pdf.columns)).collect():
        both = pdf[[r.col_a, r.col_b]].dropna() if r.col_a != r.col_b else pdf[[r.col_a]].dropna()
        assert r.n == len(both) and math.isclose(r.mean_a, both[r.col_a].mean(), rel_tol=1e-12)
        if "flat" in (r.col_a, r.col_b):
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - want.loc[r.col_a, r.col_b]) < 1e-6
    empty = CM.comoments(df.limit(0), ["a", "b"]).collect()
    assert len(empty) == 4 and all(r.n == 0 and r["corr"] is None for r in empty)


def test_merging_summaries_in_any_order():
    x = np.random.default_rng(1).normal(size=(90, 3)) + 1e6
    x[::7, 1] = np.nan
    whole = CM.summary(x)
    parts = [CM.summary(x[a:a + 9]) for a in range(0, 90, 9)]
    left = parts[0]
    for p in parts[1:]:
        left = CM.merge(left, p)
    tree = [CM.merge(CM.merge(parts[i], parts[i + 1]), CM.summary(x[:0])) for i in range(0, 10, 2)]
    right = tree[0]
    for p in tree[1:]:
        right = CM.merge(p, right)
    np.testing.assert_allclose(left, whole, rtol=1e-9, atol=1e-7)
    np.testing.assert_allclose(right, whole, rtol=1e-9, atol=1e-7)


def test_density_equals_the_direct_sum(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.lognormal(12, 0.5, 300), "b": np.array([1.0, 2.0]), "c": np.array([0.0, *[1e6] * 40, 1e9])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    out = D.kde(df, "v", by=["g"], points=37).toPandas()
    assert D.kde_error() < 1e-15
    for g, vs in groups.items():
        h = vs.std(ddof=1) * len(vs) ** -0.2
        got = out[out.g == g].sort_values("point")
        grid = np.linspace(vs.min() - 3 * h, vs.max() + 3 * h, 37)
        want = np.exp(-0.5 * ((grid[:, None] - vs) / h) ** 2).sum(1) / (len(vs) * h * math.sqrt(2 * math.pi))
        np.testing.assert_allclose(got.x, grid, rtol=1e-9, atol=1e-6)
        np.testing.assert_allclose(got.density, want, rtol=1e-9, atol=want.max() * 1e-13)
    plan = D.kde(df, "v", by=["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1                       # the grid of a group; values are not exploded


def train_rows(spark, n=360):
    rng = np.random.default_rng(9)
    town = rng.choice(["t1", "t2", "t3", "rare"], n, p=[0.5, 0.3, 0.195, 0.005])
    kind, ten = rng.choice(["flat", "house"], n), rng.choice(["freehold", "leasehold", "unknown"], n)
    beds, days = rng.integers(0, 9, n), rng.integers(0, 2000, n)
    y = (rng.random(n) < 0.25 + 0.3 * (town == "t1") + 0.2 * (kind == "flat")).astype(int)
    rows = [(i, str(kind[i]), str(ten[i]), str(town[i]), int(beds[i]), int(days[i]), float(5 + beds[i] / 7), int(days[i] % 7),
             int(days[i] % 53), int(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "listing_id int, property_type string, tenure string, location string, bedroom_count int, "
                                       "time_listed int, log10_asking_price double, day_listed int, week_listed int, revision int")


def test_out_of_fold_features_by_subtraction_equal_refitting(spark):
    df = train_rows(spark)
    kw = dict(label="revision", order="listing_id", Cs=[0.01, 1.0], folds=3)
    serial = M.fit_logistic_cv(df, FT.EXTENDED, fold_features=FT.fit_features, **kw)
    shared = M.fit_logistic_cv(df, FT.EXTENDED, fold_features="subtract", **kw)
    assert shared.C == serial.C and [s[:2] for s in shared.scores] == [s[:2] for s in serial.scores]
    np.testing.assert_allclose([s[2] for s in shared.scores], [s[2] for s in serial.scores], atol=1e-12)
    np.testing.assert_allclose(shared.model.coefficients, serial.model.coefficients, atol=1e-8)


def test_saved_pipeline_gives_the_same_rows_in_another_session(spark, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    df = train_rows(spark)
    fitted = Pipeline(stages=ML.reference_stages(C=0.5)).fit(df)
    fitted.write().save(str(tmp_path / "m"))
    want = {r.listing_id: (r.proba, r.y_pred, r.location) for r in fitted.transform(df).collect()}
    loaded = PipelineModel.load(str(tmp_path / "m"))
    assert {r.listing_id: (r.proba, r.y_pred, r.location) for r in loaded.transform(df).collect()} == want
    assert [type(s) for s in loaded.stages] == [type(s) for s in fitted.stages]
    estimator = Pipeline(stages=ML.reference_stages(C=0.5))
    estimator.write().save(str(tmp_path / "e"))
    again = Pipeline.load(str(tmp_path / "e")).fit(df).transform(df)
    assert {r.listing_id: r.y_pred for r in again.collect()} == {k: v[1] for k, v in want.items()}


def test_csv_scan_keeps_broken_lines_aside(spark, tmp_path):
    names = [f.name for f in LISTING_SCHEMA.fields]
    good = "1,2020-01-02,buy,flat,freehold,Leeds,2,1.0,250000"
    (tmp_path / "a.csv").write_bytes(b"\xef\xbb\xbf" + "\n".join([",".join(names), good, "2,2020-01-03,buy", good + ",9", ""]).encode())
    cells = dict(zip(names, '3,2020-02-02,buy,house,leasehold,"Wells, next the Sea",3,,99000'.replace(", next", "| next").split(",")))
    order = ["note", *reversed(names)]
    line = ",".join("x" if n == "note" else cells[n] for n in order).replace("|", ",")
    (tmp_path / "b.csv").write_text(",".join(order) + "\n" + line + "\n")
    (tmp_path / "c.csv").write_bytes(",".join(names).encode() + b"\n4,2020-01-02,buy,flat,freehold,L\xffeds,2,1.0,1\n")
    rows, left = R.scan_csv(spark, str(tmp_path), LISTING_SCHEMA)
    got = {r.listing_id: r for r in rows.collect()}
    assert set(got) == {1, 3} and got[3].location == "Wells, next the Sea" and got[3].bathroom_count is None
    assert got[1].listing_dt == dt.datetime(2020, 1, 2)
    assert sorted((r.reason, r.file.rsplit("/")[-1]) for r in left.collect()) == [
        ("cells", "a.csv"), ("cells", "a.csv"), ("not UTF-8", "c.csv")]
    (tmp_path / "d.csv").write_text("listing_id,other\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        R.scan_csv(spark, str(tmp_path), LISTING_SCHEMA)


def test_partitions_written_twice_stay_as_they_are(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", None), (3, "b", 4.0), (4, None, 5.0)], "id int, p string, v double")
    path = str(tmp_path / "t")
    for _ in range(2):
        assert sorted(map(tuple, R.write_partitions(df, path, ["p"]).collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    more = R.write_partitions(df.filter("id = 3").withColumn("v", F.lit(9.0)), path, ["p"])
    assert {r.id: r.v for r in more.collect()} == {1: 2.0, 2: None, 3: 9.0, 4: 5.0}


def test_false_positives_of_two_models_side_by_side(spark):
    a = spark.createDataFrame([("x", 0, 1), ("x", 0, 1), ("y", 0, 1), ("z", 1, 1)], "k string, revision int, y_pred int")
    b = spark.createDataFrame([("x", 0, 1), ("w", 0, 1), ("y", 0, 0)], "k string, revision int, y_pred int")
    got = {r.k: (r.count_a, r.count_b, r.change) for r in EV.compare_false_positives(a, b, ["k"]).collect()}
    assert got == {"x": (2, 1, -1), "y": (1, 0, -1), "w": (0, 1, 1)}


def test_interaction_set_and_level_bound(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, "q")], "i int, a double, b double, c string")
    assert FT.interaction_set(df, "a", "b", ["c", "a", "b"], ["i"]).first().asDict() == {
        "i": 1, "bias": 1.0, "a": 2.0, "b": 3.0, "a_x_b": 6.0, "c": "q"}
    with pytest.raises(ValueError):
        FT.one_hot_fit(spark.createDataFrame([(str(i),) for i in range(6)], "c string"), ["c"], max_levels=5)
