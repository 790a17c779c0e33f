"""Price levels by place, type and day."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import group_quantiles, without_null_keys
from ..plans.joins import HOT_ROWS, join_small
from ..session import ensure_checkpoint_dir

AggSpec = "str | Callable[[Column], Column]"


def _day(df: DataFrame, date_col: str) -> Column:
    t = dict(df.dtypes)[date_col]
    return F.col(date_col) if t == "date" else F.to_date(F.col(date_col))


def daily_price(df: DataFrame, agg="median", group_col: str = "property_type",
                by: tuple[str, ...] = ("location",), value: str = "asking_price",
                date_col: str = "listing_dt", method: str = "auto",
                transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per (by..., group_col, day) with the aggregated price.

    ``agg`` is 'median', 'mean', 'log10_mean' or any Column -> Column aggregate
    builder. The median's default plan (``auto``) uses Spark's ``percentile``
    for groups of bounded size and distributed narrowing for any group
    above the hot-group threshold, so a (town, type, day) holding a large share
    of all listings is spread over many tasks.
    ``transform`` is applied to the aggregated table (keyed by group), e.g. a
    per-group Box-Cox standardisation."""
    keys = [*by, group_col, date_col]
    base = df.select(*by, group_col, _day(df, date_col).alias(date_col), value)
    out = _daily_agg(base, keys, agg, value, method)
    return transform(out) if transform else out


def _daily_agg(base: DataFrame, keys: list[str], agg, value: str, method: str) -> DataFrame:
    if agg == "median":
        return group_quantiles(base, keys, value, [0.5], [value], method=method)
    if agg == "mean":
        expr = F.avg(value)
    elif agg == "log10_mean":
        expr = F.log10(F.avg(value))
    elif callable(agg):
        expr = agg(F.col(value))
    else:
        raise ValueError(f"unknown aggregate {agg!r}")
    return without_null_keys(base, keys).groupBy(*keys).agg(expr.alias(value))


def daily_medians(df: DataFrame, cols: list[str], keys: tuple[str, ...] = ("location", "property_type"),
                  date_col: str = "listing_dt", method: str = "auto") -> DataFrame:
    """Daily median of each numeric column in ``cols`` per (keys, day)."""
    gkeys = [*keys, date_col]
    base = without_null_keys(df.select(*keys, _day(df, date_col).alias(date_col), *cols), gkeys)
    if method == "auto":
        ensure_checkpoint_dir(df.sparkSession)
        base = base.checkpoint(eager=True)
        # Only the groups above the threshold (fewer than rows / HOT_ROWS of them)
        # take the other plan; both give the same rows.
        sizes = base.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_gn"))
        hot = sizes.filter(F.col("_gn") > HOT_ROWS).select(*gkeys)
        if hot.isEmpty():
            return daily_medians(base, cols, keys, date_col, "percentile")
        small = base.join(F.broadcast(hot), gkeys, "left_anti")
        big = base.join(F.broadcast(hot), gkeys, "left_semi")
        return daily_medians(small, cols, keys, date_col, "percentile").unionByName(
            daily_medians(big, cols, keys, date_col, "narrowed"))
    if method == "percentile":
        return base.groupBy(*gkeys).agg(*[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(c)
                                          for c in cols])
    # Long form (one row per cell), quantiles, then back to columns.
    long = base.select(*gkeys, F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols])).alias("_c"))
    long = long.select(*gkeys, "_c._col", "_c._v")
    med = group_quantiles(long, [*gkeys, "_col"], "_v", [0.5], ["_m"], method=method)
    return med.groupBy(*gkeys).pivot("_col", cols).agg(F.first("_m"))


def group_mean(df: DataFrame, keys: list[str], col: str, out: str | None = None) -> DataFrame:
    """Mean of ``col`` per group (partial aggregation, one shuffle)."""
    return without_null_keys(df, keys).groupBy(*keys).agg(F.avg(col).alias(out or col))


def with_group_median(df: DataFrame, keys: tuple[str, ...] = ("property_type", "location"),
                      col: str = "asking_price", out: str = "median_price",
                      method: str = "auto") -> DataFrame:
    """E1 (+B7, C6): every row with log10 price and its group's median price,
    sorted by (first key, median) descending. A row with a null key is in no
    group and has no median. The sort goes on with the price and the listing, so
    that range partitioning can cut a large town's rows into several tasks.

    Not a window: a town's listings may be a large share of the table, so the
    median is an exact distributed aggregate joined back by key."""
    last = [c for c in ("listing_id",) if c in df.columns]
    ensure_checkpoint_dir(df.sparkSession)
    df = df.select(*keys, col, *last).checkpoint(eager=True)     # read by the median, the join and the sort's sampling
    meds = group_quantiles(df, list(keys), col, [0.5], [out], method=method, stored=True)
    rows = df.select(*keys, col, F.log10(col).alias(f"log10_{col}"), *last)
    return (join_small(rows, meds, list(keys), "left")
            .orderBy(F.desc(keys[0]), F.desc(out), *[F.asc(k) for k in keys[1:]], F.desc(col), *last)
            .select(*keys, col, f"log10_{col}", out))


def box_stats(df: DataFrame, keys: tuple[str, ...] = ("location", "property_type"),
              col: str = "log10_asking_price", method: str = "auto") -> DataFrame:
    """Box-plot numbers per group: quartiles, whiskers at the furthest values
    within 1.5 IQR of the box, and the number of values outside them."""
    ensure_checkpoint_dir(df.sparkSession)
    df = df.select(*keys, col).checkpoint(eager=True)            # read by the quartiles and again inside the fences
    quarts = group_quantiles(df, list(keys), col, [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                             method=method, stored=True)
    fences = quarts.select(*keys, "q1", "median", "q3",
                           (F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("_lf"),
                           (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("_uf"))
    x = F.col(col)
    inside = (x >= F.col("_lf")) & (x <= F.col("_uf"))
    # Groups without a value have nothing to draw and are left out.
    return (join_small(df.select(*keys, col).filter(x.isNotNull()), fences, list(keys))
            .groupBy(*keys)
            .agg(F.count(x).alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
                 F.first("q3").alias("q3"),
                 F.min(F.when(inside, x)).alias("whisker_low"),
                 F.max(F.when(inside, x)).alias("whisker_high"),
                 F.count(F.when(~inside, x)).alias("outliers")))
