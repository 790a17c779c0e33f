"""Scalar helpers H1-H11 as Column expressions (no Python UDFs)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Below this |lambda| the Box-Cox family is evaluated in its limit (log/exp) form.
LAMBDA_EPS = 1e-12


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def price_sign(revised="revised_purchase_price", asking="asking_price") -> Column:
    """H3: sign of the revision against the asking price, 0 when unknown."""
    return F.coalesce(F.signum(col_(revised) - col_(asking)), F.lit(0.0))


def weekday_monday0(c) -> Column:
    """H5: day of week, Monday = 0 ... Sunday = 6."""
    return F.weekday(col_(c))


def iso_week(c) -> Column:
    """H6: ISO-8601 week number (1-53)."""
    return F.weekofyear(col_(c))


def cyclic_sin(c, period: float) -> Column:
    """H7: sin(x / period * 2 pi)."""
    return F.sin(col_(c) / F.lit(float(period)) * F.lit(2 * math.pi))


def cyclic_cos(c, period: float) -> Column:
    """H7: cos(x / period * 2 pi)."""
    return F.cos(col_(c) / F.lit(float(period)) * F.lit(2 * math.pi))


def boxcox_inverse(yt, lam, mean, std) -> Column:
    """Price from a standardised Box-Cox value:
    ((yt*std + mean)*l + 1)^(1/l), exp(yt*std + mean) in the limit l -> 0."""
    yt, lam, mean, std = col_(yt), col_(lam), col_(mean), col_(std)
    y = yt * std + mean
    return F.when(F.abs(lam) < LAMBDA_EPS, F.exp(y)).otherwise(F.pow(y * lam + 1, 1 / lam))


def growth_factor(lam, std, coef, intercept, mean, days) -> Column:
    """Growth over ``days`` of a line fitted to standardised Box-Cox values:
    the price the line gives at ``days`` over the price it gives at day 0. NULL
    where the line leaves the range of the transform (no price there)."""
    coef, intercept = col_(coef), col_(intercept)
    d = days if isinstance(days, Column) else F.lit(float(days))
    ratio = (boxcox_inverse(intercept + coef * d, lam, mean, std)
             / boxcox_inverse(intercept, lam, mean, std))
    return F.when(~F.isnan(ratio), ratio)
