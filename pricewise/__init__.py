"""pricewise: listing and price-revision analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; work is
expressed with built-in Spark functions so Catalyst can push filters and prune
columns, and every per-group loop of a single-machine workflow becomes one
grouped Spark job.
"""

__version__ = "0.1.0"
