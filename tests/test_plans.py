"""Plan-shape checks: the properties the design relies on at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scans_read_only_needed_columns(spark):
    from pricewise.sources.fixtures import listing_view
    plan = plan_of(listing_view(spark, SF).select("listing_id", "asking_price"))
    # Only the join keys and the price are read from orders.
    assert "o_orderdate" not in plan and "o_orderpriority" not in plan, plan[:1500]


def test_last_revision_aggregates_on_the_join_partitioning(no_auto_broadcast):
    from pricewise.operators import revisions as R
    from pricewise.sources.fixtures import REVISION_ORDER, revision_view
    spark = no_auto_broadcast
    last = R.last_per_key(revision_view(spark, SF), "listing_id", REVISION_ORDER, ["revised_purchase_price"])
    exchanges = re.findall(r"Exchange hashpartitioning", plan_of(last))
    assert len(exchanges) == 2  # lineitem and orders for the join; none for the aggregate


def test_boxcox_rounds_neither_explode_nor_shuffle_the_values(spark):
    from pricewise.operators import growth as G
    from pricewise.plans import catalog_growth as CG
    keys = ["location", "property_type"]
    daily = CG.daily_table(spark, SF).checkpoint(eager=True)
    u, _ = G._scaled(daily, keys, "asking_price")
    u = u.checkpoint(eager=True).repartition(8, *keys)
    plan = plan_of(G.newton_round(u, G.newton_start(u, keys), keys))
    assert "Generate" not in plan
    # Shuffles: the values for the start, the values for the round; none above a join or an aggregate.
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) == 2, plan[:3000]


def test_cleaning_and_views_fuse_into_one_scan_stage(spark):
    from pricewise.plans.queries import cleaned_listings
    plan = plan_of(cleaned_listings(spark, SF))
    assert plan.count("Scan parquet") == 3  # orders, customer, nation; each read once
