"""Column profile, value frequencies, key check and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import group_quantiles, without_null_keys
from ..plans.joins import attach_scalars
from ..session import ensure_checkpoint_dir


def profile_columns(df: DataFrame) -> DataFrame:
    """A5: one row per column: name, type, non-null and null counts, rows.

    One aggregate pass over the table, then unpivoted with ``stack``."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    aggs += [F.count(F.col(f"`{c}`")).alias(f"__nn_{i}") for i, c in enumerate(df.columns)]
    counted = df.agg(*aggs)
    pieces = []
    for i, f in enumerate(df.schema.fields):
        pieces += [F.lit(i), F.lit(f.name), F.lit(f.dataType.simpleString()), F.col(f"__nn_{i}")]
    stacked = counted.select(
        F.col("__rows").alias("row_count"),
        F.inline(F.array(*[F.struct(pieces[j].alias("position"), pieces[j + 1].alias("column_name"),
                                    pieces[j + 2].alias("data_type"), pieces[j + 3].alias("non_null"))
                           for j in range(0, len(pieces), 4)])))
    return stacked.select("position", "column_name", "data_type", "non_null",
                          (F.col("row_count") - F.col("non_null")).alias("nulls"), "row_count")


def value_counts(df: DataFrame, col: str, by: str = "count") -> DataFrame:
    """Frequency of each non-null value; sorted by count desc (then value),
    or by value when ``by='value'``."""
    counts = (df.filter(F.col(col).isNotNull()).groupBy(col)
              .agg(F.count(F.lit(1)).alias("count")))
    if by == "count":
        return counts.orderBy(F.desc("count"), F.asc(col))
    if by == "value":
        return counts.orderBy(col)
    raise ValueError("by must be 'count' or 'value'")


def value_counts_of(df: DataFrame, cols: list[str]) -> DataFrame:
    """D1 for several columns in one pass: ``column_name, value, count``, nulls excluded. One
    grouping set per column: a row is expanded once a column and counted before the
    shuffle, and the input is read once."""
    texts = df.select(*[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(cols)])
    names = texts.columns
    counts = texts.groupingSets([[c] for c in names], *names).agg(
        F.count(F.lit(1)).alias("count"), *[F.grouping(c).alias(f"_g{c}") for c in names])
    which = F.coalesce(*[F.when(F.col(f"_g{c}") == 0, F.lit(name)) for c, name in zip(names, cols)])
    return counts.select(which.alias("column_name"), F.coalesce(*names).alias("value"), "count").filter("value IS NOT NULL")


def key_check(df: DataFrame, key: str, approx: bool = False) -> DataFrame:
    """Rows, distinct keys and whether the key is unique (one row)."""
    distinct = (F.approx_count_distinct(key) if approx else F.count_distinct(F.col(key)))
    return (df.agg(F.count(F.lit(1)).alias("rows"), distinct.alias("distinct_keys"),
                   F.count(F.col(key)).alias("non_null_keys"))
            .withColumn("is_unique", (F.col("rows") == F.col("distinct_keys"))
                        & (F.col("rows") == F.col("non_null_keys"))))


def describe_column(df: DataFrame, col: str, by: list[str] | None = None,
                    method: str = "auto") -> DataFrame:
    """D3: count, mean, sample std, min, 25/50/75 % (interpolated), max.

    Exact quantiles, not ``df.summary()`` (which is approximate)."""
    by = by or []
    # Moments and quantiles read the stored column: the input is computed once.
    ensure_checkpoint_dir(df.sparkSession)
    df = without_null_keys(df.select(*by, col), by).checkpoint(eager=True)
    moments = df.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"))
    quarts = group_quantiles(df, by, col, [0.25, 0.5, 0.75], ["p25", "p50", "p75"], method=method, stored=True)
    joined = moments.join(quarts, by) if by else attach_scalars(moments, quarts)
    return joined.select(*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max")
