import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ckpt = tempfile.mkdtemp(prefix="pricewise-test-ckpt-")
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", ckpt)
         .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="pricewise-test-wh-"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(ckpt)
    yield s


def listing_rows(spark, rows):
    """Listing table from tuples in LISTING_SCHEMA order (dates as 'YYYY-MM-DD')."""
    import datetime as dt
    from pricewise.sources.schema import LISTING_SCHEMA
    fixed = [(r[0], dt.datetime.fromisoformat(r[1]) if r[1] else None, *r[2:]) for r in rows]
    return spark.createDataFrame(fixed, LISTING_SCHEMA)
