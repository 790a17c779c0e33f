from pyspark.sql import functions as F

from pricewise.operators import clean as C
from tests.conftest import listing_rows


def ids(df):
    return sorted(r.listing_id for r in df.select("listing_id").collect())


def test_null_bathroom_is_kept(spark):
    df = listing_rows(spark, [(1, "2021-01-01", "buy", "house", "freehold", "A", 3, None, 200000.0),
                              (2, "2021-01-01", "buy", "house", "freehold", "A", 3, 20.0, 200000.0)])
    assert ids(C.drop_bathroom_outliers(df)) == [1]


def test_bedroom_and_bathroom_boundaries(spark):
    df = listing_rows(spark, [
        (1, "2021-01-01", "buy", "house", "freehold", "A", 0, 1.0, 300000.0),   # 0 beds at exactly 300k: dropped
        (2, "2021-01-01", "buy", "house", "freehold", "A", 10, 1.0, 500000.0),  # 10 beds at exactly 500k: dropped
        (3, "2021-01-01", "buy", "flat", "freehold", "A", 10, 1.0, 900000.0),   # flat with exactly 10 beds: dropped
        (4, "2021-01-01", "buy", "house", "freehold", "A", 5, 15.0, 900000.0),  # 15 baths, 5 beds: dropped
        (5, "2021-01-01", "buy", "house", "freehold", "A", 0, 1.0, 299999.0),
        (6, "2021-01-01", "buy", "house", "freehold", "A", 10, 1.0, 500001.0),
        (7, "2021-01-01", "buy", "house", "freehold", "A", 6, 15.0, 900000.0),
    ])
    assert ids(C.drop_bathroom_outliers(C.drop_bedroom_outliers(df))) == [5, 6, 7]


def test_null_in_a_rule_never_matches(spark):
    df = listing_rows(spark, [(1, "2021-01-01", "buy", None, "freehold", "A", 12, 1.0, 900000.0),
                              (2, "2021-01-01", "buy", "flat", "freehold", "A", None, 1.0, 100.0)])
    assert ids(C.drop_bedroom_outliers(df)) == [1, 2]


def test_fix_categories_whole_cell_only(spark):
    df = listing_rows(spark, [(1, "2021-01-01", "buy", "house", "freehold", "Newcastle upon Tyne", 1, 1.0, 1.0),
                              (2, "2021-01-01", "buy", "house", "freehold", "Newcastle upon Tyne East", 1, 1.0, 1.0)])
    out = C.fix_categories(df)
    assert "listing_type" not in out.columns
    locs = sorted(r.location for r in out.collect())
    assert locs == ["Newcastle Upon Tyne", "Newcastle upon Tyne East"]


def test_outlier_report_tags_each_rule(spark):
    df = listing_rows(spark, [(1, "2021-01-01", "buy", "flat", "freehold", "A", 12, 1.0, 400000.0),
                              (2, "2021-01-01", "buy", "house", "freehold", "A", 0, 16.0, 350000.0),
                              (3, "2021-01-01", "buy", "house", "freehold", "A", 3, 1.0, 350000.0)])
    got = sorted((r.listing_id, r.rule) for r in C.outlier_report(df).collect())
    assert got == [(1, "beds_over_10"), (1, "beds_over_10_cheap"), (1, "beds_over_10_flat"),
                   (2, "baths_15_plus"), (2, "no_beds"), (2, "no_beds_dear")]


def test_label_and_rises(spark):
    df = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 1.0)], "listing_id long, revision double")
    out = C.label_revision(C.drop_price_rises(df))
    assert sorted((r.listing_id, r.revision) for r in out.collect()) == [(1, 1), (2, 0)]


def test_filters_reach_the_parquet_scan(spark, tmp_path):
    df = listing_rows(spark, [(1, "2021-01-01", "buy", "flat", "freehold", "A", 12, 1.0, 400000.0)])
    df.write.parquet(str(tmp_path / "l"))
    plan = C.drop_bathroom_outliers(spark.read.parquet(str(tmp_path / "l")))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
