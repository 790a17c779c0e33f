"""Listings and their price revisions.

Everything is keyed by ``listing_id``: counts are map-side combined aggregates,
"last revision" is a ``max_by`` aggregate (no sort of the history), and counts
are joined back instead of computed in a window, so a listing with a very long
history is never a single task's window partition (adaptive execution splits a
hot key's join partition).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import iso_week, price_sign, weekday_monday0
from ..plans.joins import HOT_ROWS, SALTS, hot_keys, salted_join
from .growth import days_between
from .rows import sample_fraction

KEY = "listing_id"
PRICE = "revised_purchase_price"
DATE = "price_revision_dt"
# Thresholds of the reference.
OUTLIER_REVISIONS = 150
FREQUENT_REVISIONS = 10
TOP_K = 5


def revision_counts(revisions: DataFrame, col: str = PRICE, out: str = "revision_count") -> DataFrame:
    """Revisions per listing with a non-null ``col`` (pandas ``count``)."""
    return revisions.groupBy(KEY).agg(F.count(F.col(col)).alias(out))


def _key_counts(revisions: DataFrame) -> DataFrame:
    """Rows and priced rows per listing, one map-side combined aggregate."""
    return revisions.groupBy(KEY).agg(F.count(F.lit(1)).alias("_rows"),
                                      F.count(F.col(PRICE)).alias("_priced"))


def with_revision_count(revisions: DataFrame, out: str = "revision_count",
                        hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Every revision row with the number of rows of its listing.

    The counts are joined back with a salted join: a listing with a very long
    history (more than ``hot_rows`` rows) is split over ``salts`` tasks."""
    counts = _key_counts(revisions)
    hot = hot_keys(counts, [KEY], "_rows", hot_rows)
    return salted_join(revisions, counts.select(KEY, F.col("_rows").alias(out)), [KEY], "inner", hot, salts)


def drop_revision_outliers(revisions: DataFrame, max_count: int = OUTLIER_REVISIONS,
                           hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Remove all revisions of listings with more than ``max_count``
    priced revisions (an anti join: unlike NOT IN, safe with NULL keys; salted
    for listings with more than ``hot_rows`` rows)."""
    counts = _key_counts(revisions)
    high = counts.filter(F.col("_priced") > max_count).select(KEY)
    hot = hot_keys(counts, [KEY], "_rows", hot_rows)
    return salted_join(revisions, high, [KEY], "left_anti", hot, salts)


def frequent_revisers(listings: DataFrame, revisions: DataFrame,
                      min_count: int = FREQUENT_REVISIONS) -> DataFrame:
    """Listings with more than ``min_count`` priced revisions, with their
    count, most revised first."""
    high = revision_counts(revisions).filter(F.col("revision_count") > min_count)
    return (high.join(listings, KEY, "inner")
            .orderBy(F.desc("revision_count"), F.asc(KEY)))


def top_reviser_history(revisions: DataFrame, k: int = TOP_K,
                        min_count: int = FREQUENT_REVISIONS) -> DataFrame:
    """Full revision history of the ``k`` most revised listings (ties by
    id), in time order per listing. The top-k list has at most k rows, so it is
    broadcast into a semi join."""
    top = (revision_counts(revisions).filter(F.col("revision_count") > min_count)
           .orderBy(F.desc("revision_count"), F.asc(KEY)).limit(k).select(KEY))
    return (revisions.join(F.broadcast(top), KEY, "left_semi")
            .orderBy(KEY, DATE))


def revisions_by_date(revisions: DataFrame) -> DataFrame:
    """Number of priced revisions per revision date."""
    return (revisions.groupBy(DATE).agg(F.count(F.col(PRICE)).alias("revision_count"))
            .orderBy(DATE))


def last_per_key(df: DataFrame, key: str, order_cols: list[str], cols: list[str]) -> DataFrame:
    """Per key, for each column its last non-null value in ``order_cols``
    order (columns may come from different rows, as pandas ``last``)."""
    order = F.struct(*[F.col(c) for c in order_cols])
    return df.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


def with_last_revision(listings: DataFrame, revisions: DataFrame, order_cols: list[str],
                       max_count: int = OUTLIER_REVISIONS, cols: tuple[str, ...] = (DATE, PRICE)) -> DataFrame:
    """Every listing with its last revision; listings with more than
    ``max_count`` priced revisions (outliers) and listings without revisions
    keep NULLs.

    One aggregate per listing gives both the last values and the priced count,
    so the outlier rule is a filter on that one-row-per-listing table and no
    anti join over the revisions is needed."""
    order = F.struct(*[F.col(c) for c in order_cols])
    last = (revisions.groupBy(KEY)
            .agg(F.count(F.col(PRICE)).alias("_priced"),
                 *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])
            .filter(F.col("_priced") <= max_count).drop("_priced"))
    return listings.join(last, KEY, "left")


def with_all_revisions(listings: DataFrame, revisions: DataFrame,
                       max_count: int = OUTLIER_REVISIONS, hot_rows: int = HOT_ROWS,
                       salts: int = SALTS) -> DataFrame:
    """Every listing joined with all its revisions (one row per
    revision; listings without any keep one row), with the listing's revision
    count (all rows, counted before outliers are removed; 0 when none).

    Plan: one aggregate per listing (rows, priced rows); outlier listings are
    dropped from that one-row-per-listing table, which is left-joined to the
    listings (both one row per key); the listings with kept revisions meet
    the revision rows in a single salted join (a listing with more than
    ``hot_rows`` revisions is split over ``salts`` tasks); the others are added
    back as they are."""
    counts = _key_counts(revisions)
    hot = hot_keys(counts, [KEY], "_rows", hot_rows)
    kept = (counts.filter(F.col("_priced") <= max_count)
            .select(KEY, F.col("_rows").alias("revision_count")))
    # One row per listing, with its count when it has kept revisions. Both
    # branches below read this same table (identical exchanges are reused).
    per_listing = listings.join(kept, KEY, "left")
    matched = salted_join(revisions, per_listing.filter(F.col("revision_count").isNotNull()),
                          [KEY], "inner", hot, salts)
    alone = per_listing.filter(F.col("revision_count").isNull()).drop("revision_count")
    rev_cols = [c for c in revisions.columns if c != KEY]
    out = matched.unionByName(alone, allowMissingColumns=True)
    return (out.select(*listings.columns, *rev_cols, "revision_count")
            .na.fill({"revision_count": 0}))


def add_revision_features(df: DataFrame, date_col: str = "listing_dt",
                          newest_from: DataFrame | None = None) -> DataFrame:
    """Revision sign (0 when unknown), whole days to the newest
    listing of the table, weekday (Monday 0) and ISO week of listing.

    The newest date is a scalar subquery over ``df``, or over ``newest_from``
    when given: after a left join from the listings every listing is present,
    so the listings alone give the same date without re-running the join."""
    newest = (newest_from if newest_from is not None else df).select(F.max(date_col)).scalar()
    is_date = dict(df.dtypes)[date_col] == "date"
    return df.withColumns({
        "revision": price_sign(PRICE, "asking_price"),
        "time_listed": days_between(newest, F.col(date_col), is_date),
        "day_listed": weekday_monday0(date_col),
        "week_listed": iso_week(date_col),
    })


def revision_scatter(df: DataFrame, frac: float = 0.4, seed: int = 42) -> DataFrame:
    """A repeatable 40 % sample of rows: (log price, bedrooms, revision
    count). Rows are told apart by listing, date and the tie-breakers they have;
    rows equal in all of these are taken or left together."""
    names = [c for c in (KEY, DATE, "l_linenumber", "l_partkey", "l_suppkey") if c in df.columns]
    row = F.concat_ws("|", *[F.col(c).cast("string") for c in names])
    return (sample_fraction(df, row, frac, seed)
            .select(KEY, "log10_asking_price", "bedroom_count", "revision_count"))
