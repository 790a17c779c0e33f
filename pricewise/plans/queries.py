"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator
or chain of the inventory, each reading the whole driver tables."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.fixtures import listing_view, revision_view
from ..operators import clean as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def cleaned_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clean_listings(listing_view(spark, sf_dir))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revision_view(spark, sf_dir)


def rounded(df: DataFrame, default: int = 9, **digits: int) -> DataFrame:
    """Round double columns (``default`` decimals, per-column ``digits``) so
    that results computed in a different order compare equal."""
    cols = []
    for name, t in df.dtypes:
        if t in ("double", "float"):
            cols.append(F.round(F.col(name), digits.get(name, default)).alias(name))
        else:
            cols.append(F.col(name))
    return df.select(*cols)
