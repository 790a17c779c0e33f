"""The Box-Cox family over centred logs ``u``, with its derivatives in lambda.

``z(l) = (exp(l u) - 1) / l = u f(t)`` with ``t = l u`` and ``f(t) = (exp(t) - 1) / t``, so
``dz/dl = u^2 f'(t)`` and ``d2z/dl2 = u^3 f''(t)``. Near ``t = 0`` the closed forms cancel;
there the power series of ``f`` is used, which is exact to rounding below ``SMALL``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 0.05
TERMS = 9                        # SMALL**9 / 10! is far below rounding


def _series(t: Column, derivative: int) -> Column:
    """sum over k of the ``derivative``-th derivative of t^k / (k + 1)!, by Horner's rule."""
    out = F.lit(0.0)
    for k in reversed(range(derivative, TERMS)):
        out = out * t + F.lit(math.perm(k, derivative) / math.factorial(k + 1))
    return out


def boxcox_terms(u: Column, lam: Column) -> tuple[Column, Column, Column]:
    """``z``, ``dz/dl`` and ``d2z/dl2``."""
    t = lam * u
    e, near = F.exp(t), F.abs(t) < SMALL
    f0 = F.when(near, _series(t, 0)).otherwise((e - 1) / t)
    f1 = F.when(near, _series(t, 1)).otherwise((t * e - e + 1) / (t * t))
    f2 = F.when(near, _series(t, 2)).otherwise((t * t * e - 2 * t * e + 2 * e - 2) / (t * t * t))
    return u * f0, u * u * f1, u * u * u * f2
