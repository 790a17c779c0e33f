"""Cleaning rules of the listing table and label rewrites.

All rules are row-local filters/projections, so Catalyst merges them into one
Project/Filter over the scan and pushes the comparisons into Parquet.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import keep_unless, matches_all
from ..sources.readers import nan_to_null

# Fixed values from the reference's cleaning step.
CATEGORY_FIXES = {"Newcastle upon Tyne": "Newcastle Upon Tyne"}
DROPPED_COLUMNS = ("listing_type",)


def fix_categories(df: DataFrame, mapping: dict | None = None,
                   drop: tuple[str, ...] = DROPPED_COLUMNS) -> DataFrame:
    """B1 + B2: drop constant columns and replace whole-cell values in every
    string column (a value inside a longer text is left alone)."""
    mapping = CATEGORY_FIXES if mapping is None else mapping
    out = df.drop(*[c for c in drop if c in df.columns])
    string_cols = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType)]
    if mapping and string_cols:
        out = out.na.replace(mapping, subset=string_cols)
    return out


def drop_bedroom_outliers(df: DataFrame, max_beds: int = 10, cheap: float = 500000,
                          studio_cap: float = 300000) -> DataFrame:
    """Drop flats with >= max_beds bedrooms, >= max_beds bedrooms at <= cheap,
    and 0 bedrooms at >= studio_cap. Missing values never match a rule."""
    return (df
            .filter(keep_unless(("bedroom_count", ">=", max_beds), ("property_type", "==", "flat")))
            .filter(keep_unless(("bedroom_count", ">=", max_beds), ("asking_price", "<=", cheap)))
            .filter(keep_unless(("bedroom_count", "==", 0), ("asking_price", ">=", studio_cap))))


def drop_bathroom_outliers(df: DataFrame, max_baths: float = 15, beds: int = 5) -> DataFrame:
    """Drop >= max_baths bathrooms with <= beds bedrooms; null baths are kept."""
    return df.filter(keep_unless(("bathroom_count", ">=", max_baths), ("bedroom_count", "<=", beds)))


def clean_listings(df: DataFrame) -> DataFrame:
    """The three cleaning functions, piped; what is left has no NaN."""
    return (df.transform(fix_categories).transform(drop_bedroom_outliers).transform(drop_bathroom_outliers)
            .transform(nan_to_null))


# Rules looked at before cleaning: name -> conjunction of comparisons.
# "many_beds_*" are applied to the rows with more than 10 bedrooms, as shown.
OUTLIER_RULES = {
    "beds_over_10": [("bedroom_count", ">", 10)],
    "beds_over_10_flat": [("bedroom_count", ">", 10), ("property_type", "==", "flat")],
    "beds_over_10_cheap": [("bedroom_count", ">", 10), ("asking_price", "<=", 500000)],
    "no_beds": [("bedroom_count", "==", 0)],
    "no_beds_dear": [("bedroom_count", "==", 0), ("asking_price", ">=", 300000)],
    "baths_15_plus": [("bathroom_count", ">=", 15)],
}


def outlier_report(df: DataFrame, rules: dict | None = None) -> DataFrame:
    """Every row matching an inspection rule, tagged with the rule, in one
    scan (a row matching several rules appears once per rule)."""
    rules = OUTLIER_RULES if rules is None else rules
    tags = F.array_compact(F.array(*[F.when(matches_all(*conds), F.lit(name))
                                     for name, conds in rules.items()]))
    # Pushes one disjunction of all rules to the scan before tagging.
    any_rule = reduce(lambda a, b: a | b, [matches_all(*c) for c in rules.values()])
    return (df.filter(any_rule).select(F.explode(tags).alias("rule"), *df.columns))


def sort_report(report: DataFrame) -> DataFrame:
    """B5 ordering: by rule, then bedrooms (price for the 0-bedroom rules)."""
    return report.orderBy("rule", "bedroom_count", "asking_price", "listing_id")


def label_revision(df: DataFrame, col: str = "revision") -> DataFrame:
    """Map {-1: 1, 0: 0}; any other value becomes NULL."""
    c = F.col(col)
    return df.withColumn(col, F.when(c == -1, 1).when(c == 0, 0).cast("int"))


def drop_price_rises(df: DataFrame, col: str = "revision") -> DataFrame:
    """Keep rows whose revision sign is below 1 (drops price rises)."""
    return df.filter(F.col(col) < 1)
