"""Price trends and growth per place and type.

The reference loops over towns and types, fitting one Box-Cox transform and
one line per group. Here every step is one grouped job over all groups at once:
the Box-Cox search takes Newton steps for every group in a single aggregate a
round; line fits are ``regr_*`` aggregates. All of it runs on the daily table (one row per group and day), so
its size is bounded by the calendar, not by the number of listings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxcox import boxcox_terms
from ..functions.quantiles import without_null_keys
from ..functions.scalar import LAMBDA_EPS, boxcox_inverse, growth_factor
from ..plans.joins import join_small

# Horizons used by the reference (named 975 days, computed as
# 365*2 + 8*30 = 970 for the growth column; 975 for the predicted upper price).
GROWTH_DAYS = 365 * 2 + 8 * 30
CHECK_DAYS = 975
LOG_LINEAR_DAYS = 2 * 365
DAY_ZERO = "2000-01-01"          # day 0 of line fits over dates; any other gives the same lines


def _is_date(df: DataFrame, c: str) -> bool:
    return dict(df.dtypes)[c] == "date"


def days_between(later: Column, earlier: Column, dates: bool) -> Column:
    """Whole elapsed days (floored, like pandas ``.dt.days``)."""
    if dates:
        return F.datediff(later, earlier)
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86_400_000_000)).cast("int")


def days_since_start(df: DataFrame, keys: list[str], date_col: str = "listing_dt",
                     out: str = "days") -> DataFrame:
    """Whole days since the first date of the row's group (aggregate and
    join back, so a big group is never one task's window)."""
    starts = df.groupBy(*keys).agg(F.min(date_col).alias("_start"))
    return (join_small(df, starts, keys)
            .withColumn(out, days_between(F.col(date_col), F.col("_start"), _is_date(df, date_col)))
            .drop("_start"))


def trend_fit(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """I4: least-squares line of y on x per group: slope, intercept, R^2, n."""
    return without_null_keys(df, keys).groupBy(*keys).agg(*_line(x, y))


def _line(x: str, y: str) -> list[Column]:
    return [F.regr_slope(F.col(y), F.col(x)).alias("coef"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
            F.regr_r2(F.col(y), F.col(x)).alias("r2"), F.regr_count(F.col(y), F.col(x)).alias("n")]


def trend_predict(df: DataFrame, fits: DataFrame, keys: list[str], x: str,
                  out: str = "y_pred") -> DataFrame:
    """Fitted value of every row from its group's line."""
    return (join_small(df, fits.select(*keys, "coef", "intercept"), keys)
            .withColumn(out, F.col("intercept") + F.col("coef") * F.col(x))
            .drop("coef", "intercept"))


def growth_log_linear(df: DataFrame, keys: tuple[str, ...] = ("location", "property_type"),
                      value: str = "asking_price", date_col: str = "listing_dt",
                      days: int = LOG_LINEAR_DAYS, out: str = "growth_2_yr") -> DataFrame:
    """Line of log10(price) on days since the group's first listing, over
    the raw rows; growth over ``days`` = 10^(slope * days).

    One aggregate for dates: the slope does not depend on the day that counts as
    0, and the intercept moves along the line to the group's first day."""
    keys = list(keys)
    rows = without_null_keys(df.select(*keys, date_col, F.log10(value).alias("_y")), keys).filter(F.col("_y").isNotNull())
    if _is_date(df, date_col):
        rows = rows.withColumn("_x", F.datediff(F.col(date_col), F.lit(DAY_ZERO).cast("date")))
        fits = rows.groupBy(*keys).agg(*_line("_x", "_y"), F.min("_x").alias("_x0"))
        fits = fits.withColumn("intercept", F.col("intercept") + F.col("coef") * F.col("_x0")).drop("_x0")
    else:
        fits = trend_fit(days_since_start(rows, keys, date_col, "_x"), keys, "_x", "_y")
    return fits.withColumn(out, F.pow(F.lit(10.0), F.col("coef") * days))


def growth_ranking(df: DataFrame, group_col: str = "property_type", growth_col: str = "growth_2_yr",
                   rank_col: str = "rank") -> DataFrame:
    """I8: growth table ranked within each type, fastest first, with whether
    the place grew (growth above 1). Places without a growth (NULL or NaN) come
    last and have no verdict. The input has one row per (place, type)."""
    df = df.withColumn(growth_col, F.when(~F.isnan(growth_col), F.col(growth_col)))
    w = Window.partitionBy(group_col).orderBy(F.desc_nulls_last(growth_col), *[F.asc(c) for c in df.columns
                                                                     if c not in (group_col, growth_col)])
    return (df.withColumn(rank_col, F.row_number().over(w))
            .withColumn("grew", F.col(growth_col) > 1)
            .orderBy(F.desc(group_col), F.col(rank_col)))


def fit_messages(fits: DataFrame, group_col: str = "property_type") -> DataFrame:
    """Per fitted line a capitalised group label and the message
    "<group> - Slope: <coef>, Intercept: <intercept to 2 digits>"."""
    return fits.withColumns({
        "label": F.initcap(F.col(group_col)),
        "message": F.format_string("%s - Slope: %.10f, Intercept: %.2f", F.col(group_col),
                                   F.col("coef"), F.col("intercept")),
    })


# ---------------------------------------------------------------- Box-Cox

def _scaled(daily: DataFrame, keys: list[str], col: str) -> tuple[DataFrame, DataFrame]:
    """Values with u = ln(x) - mean(ln x) of the groups that can be fitted (two
    different values, all positive), and stats of every group. The transform is
    not defined for values <= 0: such a group is not fitted on the rest of them,
    it has ``_bad`` values and no lambda."""
    x = F.col(col)
    data = without_null_keys(daily.select(*keys, col), keys).filter(x.isNotNull())
    stats = data.groupBy(*keys).agg(F.count(F.when(x <= 0, 1)).alias("_bad"), F.count(x).alias("_n"),
                                    F.avg(F.when(x > 0, F.log(x))).alias("_lgm"),
                                    F.min(x).alias("_min"), F.max(x).alias("_max"))
    stats = stats.withColumn("_lgm", F.when(F.col("_bad") == 0, F.col("_lgm")))
    u = (join_small(data, stats, keys)
         .filter((F.col("_n") >= 2) & (F.col("_max") > F.col("_min")) & (F.col("_bad") == 0))
         .select(*keys, (F.log(x) - F.col("_lgm")).alias("_u")))
    return u, stats


def _parallelism(df: DataFrame) -> int:
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")),
               spark.sparkContext.defaultParallelism)


def _z(u: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < LAMBDA_EPS, u).otherwise((F.exp(lam * u) - 1) / lam)


# Fixed values of the search: lambdas are reported to this step.
RESOLUTION = 1e-5
ROUNDS = 60                      # bisection alone narrows any bracket far enough
ROUNDS_PER_JOB = 3
UNIT_STEPS = 4.0                 # longest move, in units of 1 / std(u), while lambda is small
LAST_STEP = 10.0                 # a Newton step this many resolutions long leaves an error far below one


def _moments(z: str, z1: str, z2: str) -> list[Column]:
    return [F.var_pop(z).alias("_v"), F.covar_pop(z, z1).alias("_c1"), F.covar_pop(z, z2).alias("_c2"),
            F.var_pop(z1).alias("_v1")]


def _step(m: DataFrame, keys: list[str], resolution: float) -> DataFrame:
    """The next state of every group from its state and the moments at its lambda.

    The log variance of the transform is convex in lambda. The sign of its slope narrows
    the bracket; a Newton step that leaves it is replaced by a bisection, one
    longer than the trusted length is cut to it. A lambda at which the variance overflows
    is too far out, whatever the slope."""
    lam, lo, hi = F.col("_l"), F.col("_lo"), F.col("_hi")
    fine = F.coalesce((F.col("_v") > 0) & (F.abs("_v") < float("inf")) & (F.abs("_c1") < float("inf")), F.lit(False))
    slope = F.when(fine, 2 * F.col("_c1") / F.col("_v")).otherwise(F.signum(lam))
    m = m.withColumns({"_g": slope, "_h": F.when(fine, 2 * (F.col("_v1") + F.col("_c2")) / F.col("_v") - slope * slope),
                       "_reach": F.greatest(F.lit(UNIT_STEPS) * F.col("_s"), F.abs(lam))})
    m = m.withColumns({"_hi": F.when(F.col("_g") > 0, lam).otherwise(hi), "_lo": F.when(F.col("_g") <= 0, lam).otherwise(lo),
                       "_d": F.when((F.col("_h") > 0) & (F.abs("_h") < float("inf")), -F.col("_g") / F.col("_h"))})
    m = m.withColumn("_d", F.least(F.greatest("_d", -F.col("_reach")), F.col("_reach")))
    newton = F.coalesce((lam + F.col("_d") > F.coalesce(lo, F.lit(float("-inf"))))
                        & (lam + F.col("_d") < F.coalesce(hi, F.lit(float("inf")))) | (F.col("_d") == 0), F.lit(False))
    other = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(
        F.when(F.col("_g") > 0, lam - F.col("_reach")).otherwise(lam + F.col("_reach")))
    m = m.withColumns({"_newton": newton, "_to": F.when(newton, lam + F.col("_d")).otherwise(other)})
    near = F.abs(F.col("_to") - lam)
    end = F.when(F.col("_newton"), near <= LAST_STEP * resolution).otherwise(near <= resolution / 1000)
    return m.select(*keys, F.when(F.col("_done"), lam).otherwise(F.col("_to")).alias("_l"), "_lo", "_hi", "_s",
                    (F.col("_done") | end).alias("_done"))


def newton_start(u: DataFrame, keys: list[str], resolution: float = RESOLUTION) -> DataFrame:
    """State after the step from lambda 0, where z = u, dz/dl = u^2 / 2, d2z/dl2 = u^3 / 3."""
    none = F.lit(None).cast("double")
    x = F.col("_u")
    m = u.select(*keys, "_u", (x * x / 2).alias("_z1"), (x * x * x / 3).alias("_z2"))
    m = m.groupBy(*keys).agg((1 / F.stddev_pop("_u")).alias("_s"), *_moments("_u", "_z1", "_z2"))
    return _step(m.withColumns({"_l": F.lit(0.0), "_lo": none, "_hi": none, "_done": F.lit(False)}), keys, resolution)


def newton_round(u: DataFrame, state: DataFrame, keys: list[str], resolution: float = RESOLUTION) -> DataFrame:
    """One safeguarded Newton step of every group's lambda.

    ``u`` has the centred logs, ``state`` one row per group: ``_l``, the bracket ``_lo`` and
    ``_hi`` (NULL while open), the unit ``_s`` and ``_done``. One aggregate gives slope and
    curvature from the moments of z, dz/dl and d2z/dl2."""
    z, z1, z2 = boxcox_terms(F.col("_u"), F.col("_l"))
    names = ["_l", "_lo", "_hi", "_s", "_done"]
    m = u.join(state, keys).select(*keys, *names, z.alias("_z"), z1.alias("_z1"), z2.alias("_z2"))
    return _step(m.groupBy(*keys).agg(*[F.max(c).alias(c) for c in names], *_moments("_z", "_z1", "_z2")), keys, resolution)


def boxcox_fit(daily: DataFrame, keys: list[str], col: str = "asking_price",
               resolution: float = RESOLUTION) -> DataFrame:
    """Maximum-likelihood Box-Cox lambda per group.

    The log-likelihood (l-1) sum(ln x) - n/2 ln var(y_l) equals, up to a
    constant, -n/2 ln var of the transform of x divided by its geometric mean,
    so each group's best lambda minimises that variance, which is computed
    without cancellation. All groups take Newton steps together: a round is one
    aggregate over the scaled values with one row per group as its state, and most
    groups need three or four. The result is the multiple of ``resolution`` with the
    smallest variance (ties: the smaller) beside the optimum. Groups with fewer than
    two values, a single value or a value <= 0 get NULL. Output: keys,
    ``normalize_lambda``, ``log_gmean``."""
    u, stats = _scaled(daily, keys, col)
    # Partition the scaled values by group once (an explicit count, so adaptive
    # execution does not pack the small table into one partition): the aggregates
    # of all rounds then run without shuffling them again. A group has at most one
    # row per day, so it is bounded by the calendar.
    u = u.checkpoint(eager=True).repartition(_parallelism(daily), *keys)
    state = newton_start(u, keys, resolution)
    for _ in range(0, ROUNDS, ROUNDS_PER_JOB):
        for _ in range(ROUNDS_PER_JOB):
            state = newton_round(u, state, keys, resolution)
        state = state.checkpoint(eager=True)
        if state.filter(~F.col("_done")).isEmpty():
            break
    best = _on_grid(u, state, keys, resolution)
    return (stats.join(best, keys, "left")
            .select(*keys, F.col("_lam").alias("normalize_lambda"), F.col("_lgm").alias("log_gmean"))
            .checkpoint(eager=True))


def _on_grid(u: DataFrame, state: DataFrame, keys: list[str], resolution: float) -> DataFrame:
    """The best of the three multiples of ``resolution`` beside each group's lambda."""
    k = F.round(F.col("_l") / resolution)
    near = [((k + d) * resolution) for d in (-1, 0, 1)]
    cells = u.join(state.select(*keys, *[c.alias(f"_l{i}") for i, c in enumerate(near)]), keys)
    cells = cells.select(*keys, "_l0", "_l1", "_l2", *[_z(F.col("_u"), F.col(f"_l{i}")).alias(f"_z{i}") for i in range(3)])
    per = cells.groupBy(*keys).agg(F.array_min(F.array(*[
        F.struct(F.var_pop(f"_z{i}").alias("v"), F.max(f"_l{i}").alias("l")) for i in range(3)])).alias("_best"))
    return per.select(*keys, F.col("_best.l").alias("_lam"))


def boxcox_transform(daily: DataFrame, params: DataFrame, keys: list[str],
                     col: str = "asking_price", out: str = "target") -> tuple[DataFrame, DataFrame]:
    """Standardised Box-Cox values per row (population std, as the
    reference), and per group the mean and std of the unstandardised values
    (x^l - 1)/l. Returns (rows with ``out``, group table). Groups without a lambda
    keep their rows, with a NULL ``out``."""
    lam = F.col("normalize_lambda")
    rows = (join_small(daily, params, keys)
            .withColumn("_z", _z(F.log(F.col(col)) - F.col("log_gmean"), lam)))
    zstats = rows.groupBy(*keys).agg(F.avg("_z").alias("_zm"), F.stddev_pop("_z").alias("_zs"))
    glam = F.exp(lam * F.col("log_gmean"))
    shift = F.when(F.abs(lam) < LAMBDA_EPS, F.col("log_gmean")).otherwise((glam - 1) / lam)
    groups = (params.join(zstats, keys)
              .select(*keys, "normalize_lambda", "log_gmean", "_zm", "_zs",
                      (glam * F.col("_zm") + shift).alias("normalized_mean"),
                      (glam * F.col("_zs")).alias("normalized_std")))
    out_rows = (join_small(rows.drop("normalize_lambda", "log_gmean"),
                           groups.select(*keys, "_zm", "_zs"), keys)
                .withColumn(out, F.when(F.col("_zs") > 0, (F.col("_z") - F.col("_zm")) / F.col("_zs")))
                .drop("_z", "_zm", "_zs"))
    return out_rows, groups.drop("_zm", "_zs", "log_gmean")


def boxcox_growth(daily: DataFrame, keys: tuple[str, ...] = ("location", "property_type"),
                  col: str = "asking_price", date_col: str = "listing_dt",
                  days: int = GROWTH_DAYS, materialise: bool = True) -> DataFrame:
    """I1 + I2 + E3 + I4 + I6: per group the line through standardised Box-Cox
    daily prices against days since the group's first day, the transform's
    parameters, and the growth factor over ``days``. Groups that cannot be fitted
    keep a row with NULLs (and ``n`` = 0)."""
    keys = list(keys)
    # The daily table is read by the fit, the transform and the line fit:
    # materialise it once (it is bounded by groups x days), unless the caller
    # passes a table that is already materialised.
    if materialise:
        daily = daily.checkpoint(eager=True)
    params = boxcox_fit(daily, keys, col)
    rows, groups = boxcox_transform(daily, params, keys, col)
    rows = days_since_start(rows.filter(F.col("target").isNotNull()), keys, date_col, "_days")
    fits = trend_fit(rows, keys, "_days", "target")
    out = groups.join(fits, keys, "left").select(
        *keys, "coef", "intercept", "r2", F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "normalize_lambda", "normalized_mean", "normalized_std")
    return out.withColumn(f"growth_{CHECK_DAYS}_days", growth_factor(
        "normalize_lambda", "normalized_std", "coef", "intercept", "normalized_mean", days))


def observed_growth(daily: DataFrame, keys: list[str], col: str = "asking_price",
                    date_col: str = "listing_dt", k: int = 5) -> DataFrame:
    """Median of the first k and of the last k daily values of each
    group, and their ratio. The window partitions hold one row per day of a
    group, so they are bounded by the calendar."""
    w = Window.partitionBy(*keys).orderBy(date_col)
    ranked = without_null_keys(daily, keys).select(*keys, date_col, col, F.row_number().over(w).alias("_r"),
                          F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    first = F.col("_r") <= k
    last = F.col("_r") > F.col("_n") - k
    return (ranked.groupBy(*keys)
            .agg(F.percentile(F.when(first, F.col(col)), F.lit(0.5)).alias("lower_act"),
                 F.percentile(F.when(last, F.col(col)), F.lit(0.5)).alias("upper_act"))
            .withColumn("growth_act", F.col("upper_act") / F.col("lower_act")))


def growth_check(coefs: DataFrame, daily: DataFrame, keys: list[str],
                 col: str = "asking_price", date_col: str = "listing_dt",
                 days: int = CHECK_DAYS, k: int = 5) -> DataFrame:
    """Predicted first and last price (inverse transform of the line
    at day 0 and day ``days``) and predicted growth, joined with the observed
    medians of the first and last k days: one grouped pass, no row loop."""
    lam, mean, std = "normalize_lambda", "normalized_mean", "normalized_std"
    pred = coefs.select(
        *keys,
        boxcox_inverse(F.col("intercept"), F.col(lam), F.col(mean), F.col(std)).alias("lower_pred"),
        boxcox_inverse(F.col("coef") * days + F.col("intercept"), F.col(lam), F.col(mean), F.col(std))
        .alias("upper_pred"),
        F.col(f"growth_{CHECK_DAYS}_days").alias("growth_pred"))
    return pred.join(observed_growth(daily, keys, col, date_col, k), keys)
