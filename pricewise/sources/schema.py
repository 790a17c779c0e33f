"""Explicit schemas of the two input tables (no inference at read time)."""

from pyspark.sql import types as T

LISTING_SCHEMA = T.StructType([
    T.StructField("listing_id", T.LongType(), False),
    T.StructField("listing_dt", T.TimestampType(), True),
    T.StructField("listing_type", T.StringType(), True),
    T.StructField("property_type", T.StringType(), True),
    T.StructField("tenure", T.StringType(), True),
    T.StructField("location", T.StringType(), True),
    T.StructField("bedroom_count", T.IntegerType(), True),
    T.StructField("bathroom_count", T.DoubleType(), True),
    T.StructField("asking_price", T.DoubleType(), True),
])

REVISION_SCHEMA = T.StructType([
    T.StructField("listing_id", T.LongType(), False),
    T.StructField("price_revision_dt", T.TimestampType(), True),
    T.StructField("revised_purchase_price", T.DoubleType(), True),
])
