"""Listing and revision views over the driver's TPC-H-like tables.

The reference reads two CSV files that are not shipped; these views give the
same columns, types and data quirks (a misspelt town, null bathroom counts,
zero and absurd bedroom counts, revisions without price, several revisions per
day) from ``orders``, ``customer``, ``nation`` and ``lineitem``. The same
definitions are written as SQL in ``pricewise.plans.oracle`` for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table

# Fixed values of the fixture definition (must equal the SQL twin).
FLAT_PRIORITIES = ["1-URGENT", "2-HIGH"]
TENURE_BY_STATUS = {"F": "freehold", "O": "leasehold"}
TOWN_RENAMES = {"NATION_0": "Newcastle Upon Tyne"}
MISSPELT_TOWN = "Newcastle upon Tyne"
MISSPELT_SOURCE = "NATION_1"
NO_TOWN_EVERY = 211              # listings without a town, except in NATION_0


def listing_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    key = F.col("o_orderkey")
    joined = (orders.join(customer, orders.o_custkey == customer.c_custkey)
              .join(nation, F.col("c_nationkey") == nation.n_nationkey))
    tenure = F.lit("unknown")
    for status, name in reversed(list(TENURE_BY_STATUS.items())):
        tenure = F.when(F.col("o_orderstatus") == status, name).otherwise(tenure)
    location = (F.when(F.col("n_name") == "NATION_0", TOWN_RENAMES["NATION_0"])
                .when((F.col("n_name") == MISSPELT_SOURCE) & (key % 100 == 0), MISSPELT_TOWN)
                .when(key % NO_TOWN_EVERY == 0, None)
                .otherwise(F.col("n_name")))
    return joined.select(
        key.alias("listing_id"),
        F.col("o_orderdate").cast("date").alias("listing_dt"),
        F.lit("buy").alias("listing_type"),
        F.when(F.col("o_orderpriority").isin(FLAT_PRIORITIES), "flat").otherwise("house")
        .alias("property_type"),
        tenure.alias("tenure"),
        location.alias("location"),
        (key % 13).cast("int").alias("bedroom_count"),
        F.when(key % 7 == 0, F.lit(None)).otherwise(key % 23).cast("double").alias("bathroom_count"),
        (F.col("o_totalprice") * 2).alias("asking_price"),
    )


def revision_view(spark: SparkSession, sf_dir: str, tie_breakers: bool = True) -> DataFrame:
    """Revisions, one per line item; the last three columns order revisions of
    one listing that share a date."""
    lineitem = (read_table(spark, sf_dir, "lineitem")
                .select("l_orderkey", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
                        "l_discount"))
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    joined = lineitem.join(orders, lineitem.l_orderkey == orders.o_orderkey)
    cols = [
        F.col("l_orderkey").alias("listing_id"),
        F.col("l_shipdate").cast("date").alias("price_revision_dt"),
        F.when(F.col("l_linenumber") == 7, F.lit(None))
        .otherwise(F.col("o_totalprice") * 2 * (F.lit(0.95) + F.col("l_discount")))
        .cast("double").alias("revised_purchase_price"),
    ]
    if tie_breakers:
        cols += [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return joined.select(*cols)


# Order that makes "the last revision of a listing" well defined.
REVISION_ORDER = ["price_revision_dt", "l_linenumber", "l_partkey", "l_suppkey"]
