import datetime as dt

from pyspark.sql import functions as F

from pricewise.operators import revisions as R
from pricewise.sources.fixtures import REVISION_ORDER
from tests.conftest import listing_rows

SCHEMA = ("listing_id long, price_revision_dt date, revised_purchase_price double, l_linenumber int, "
          "l_partkey long, l_suppkey long")


def revs(spark, rows):
    return spark.createDataFrame(
        [(a, dt.date.fromisoformat(b), c, d, e, f) for a, b, c, d, e, f in rows], SCHEMA)


def test_last_non_null_per_column_and_tie_breaker(spark):
    r = revs(spark, [(1, "2021-01-01", 100.0, 1, 1, 1),
                     (1, "2021-02-01", None, 1, 1, 1),       # last row has no price
                     (2, "2021-03-01", 10.0, 1, 1, 1),
                     (2, "2021-03-01", 20.0, 2, 1, 1)])     # same date: line number decides
    last = {x.listing_id: x for x in R.last_per_key(r, "listing_id", REVISION_ORDER,
                                                    ["price_revision_dt", "revised_purchase_price"]).collect()}
    assert last[1].revised_purchase_price == 100.0 and last[1].price_revision_dt == dt.date(2021, 2, 1)
    assert last[2].revised_purchase_price == 20.0


def test_listing_without_revision(spark):
    listings = listing_rows(spark, [(1, "2021-01-01", "buy", "house", "freehold", "A", 3, 1.0, 200000.0),
                                    (2, "2021-01-02", "buy", "house", "freehold", "A", 3, 1.0, 200000.0)])
    r = revs(spark, [(1, "2021-01-05", 190000.0, 1, 1, 1)])
    c1 = {x.listing_id: x for x in R.with_last_revision(listings, r, REVISION_ORDER).collect()}
    assert c1[2].revised_purchase_price is None
    c2 = {x.listing_id: x for x in R.with_all_revisions(listings, r).collect()}
    assert c2[2].revision_count == 0 and c2[1].revision_count == 1
    feats = {x.listing_id: x for x in R.add_revision_features(
        R.with_last_revision(listings, r, REVISION_ORDER)).collect()}
    assert feats[2].revision == 0.0 and feats[1].revision == -1.0
    assert feats[1].time_listed == 1 and feats[2].time_listed == 0


def test_weekday_and_iso_week(spark):
    listings = listing_rows(spark, [(1, "2021-01-03", "buy", "house", "freehold", "A", 3, 1.0, 1.0),
                                    (2, "2021-01-04", "buy", "house", "freehold", "A", 3, 1.0, 1.0)])
    listings = listings.withColumn("revised_purchase_price", F.lit(None).cast("double"))
    got = {x.listing_id: (x.day_listed, x.week_listed) for x in R.add_revision_features(listings).collect()}
    assert got == {1: (6, 53), 2: (0, 1)}


def test_anti_plus_kept_is_everything(spark):
    rows = [(1, "2021-01-01", 1.0, i, 1, 1) for i in range(5)] + [(2, "2021-01-01", 1.0, 1, 1, 1)]
    r = revs(spark, rows)
    kept = R.drop_revision_outliers(r, max_count=3)
    assert sorted(x.listing_id for x in kept.collect()) == [2]
    top = R.top_reviser_history(r, k=5, min_count=3)
    assert kept.count() + top.count() == r.count()


def test_revision_count_counts_rows(spark):
    r = revs(spark, [(1, "2021-01-01", None, 1, 1, 1), (1, "2021-01-02", 5.0, 2, 1, 1)])
    assert {x.revision_count for x in R.with_revision_count(r).collect()} == {2}
    assert R.revision_counts(r).first().revision_count == 1
