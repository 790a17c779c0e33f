"""A listing holding a third of all revisions: the salted joins must spread
its rows over several tasks and give the same answers as plain joins."""

from collections import Counter

from pyspark.sql import functions as F

from pricewise.operators import revisions as R
from pricewise.plans.joins import hot_keys, salted_join
from pricewise.sources.fixtures import REVISION_ORDER
from tests.conftest import listing_rows


def skewed_revisions(spark, n=30000):
    # listing 0 gets every third row; the rest spread over 5000 listings
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 5000 + 1).alias("listing_id"),
        F.date_add(F.lit("2021-01-01").cast("date"), (F.col("id") % 400).cast("int")).alias("price_revision_dt"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.col("id") * 1.5).alias("revised_purchase_price"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"), F.col("id").alias("l_partkey"),
        F.lit(1).cast("long").alias("l_suppkey"))


def test_hot_key_is_spread_and_results_unchanged(spark):
    revs = skewed_revisions(spark)
    base = dict(revs.groupBy("listing_id").count().collect())
    counted = R.with_revision_count(revs, hot_rows=1000, salts=16)
    got = dict(counted.groupBy("listing_id").agg(F.max("revision_count")).collect())
    assert got == base and base[0] == 10000
    assert counted.count() == 30000
    tasks = counted.filter("listing_id = 0").select(F.spark_partition_id()).distinct().count()
    assert tasks > 1


def test_salted_anti_and_left_joins_match_plain_ones(spark):
    revs = skewed_revisions(spark)
    counts = revs.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(counts, ["listing_id"], "n", 1000)
    small = counts.filter("listing_id % 2 = 0").select("listing_id", F.lit(1).alias("flag"))
    for how in ("inner", "left", "left_anti"):
        a = salted_join(revs, small, ["listing_id"], how, hot, salts=8)
        b = revs.join(small, "listing_id", how)
        assert Counter(map(tuple, a.collect())) == Counter(map(tuple, b.select(*a.columns).collect())), how


def test_drop_outliers_and_all_revisions_under_skew(spark):
    revs = skewed_revisions(spark)
    kept = R.drop_revision_outliers(revs, max_count=5, hot_rows=1000, salts=8)
    plain = revs.join(revs.groupBy("listing_id").agg(F.count("revised_purchase_price").alias("c"))
                      .filter("c > 5").select("listing_id"), "listing_id", "left_anti")
    assert kept.count() == plain.count()
    listings = listing_rows(spark, [(i, "2021-01-01", "buy", "house", "freehold", "A", 3, 1.0, 1000.0)
                                    for i in (0, 1, 2, 999999)])
    allr = R.with_all_revisions(listings, revs, max_count=1000000, hot_rows=1000, salts=8)
    per = dict(allr.groupBy("listing_id").count().collect())
    assert per[0] == 10000 and per[999999] == 1
    assert allr.filter("listing_id = 999999").first().revision_count == 0


def test_last_revision_of_hot_key(spark):
    revs = skewed_revisions(spark)
    last = R.last_per_key(revs, "listing_id", REVISION_ORDER, ["revised_purchase_price"])
    got = last.filter("listing_id = 0").first().revised_purchase_price
    pdf = revs.filter("listing_id = 0 AND revised_purchase_price IS NOT NULL").toPandas()
    assert got == pdf.sort_values(REVISION_ORDER).iloc[-1].revised_purchase_price
