"""Null-safe predicates (H8).

pandas evaluates a comparison with a missing value as False, so a row removed by
``~(a & b)`` is kept whenever ``a`` or ``b`` is missing. In SQL ``NOT (NULL)`` is
NULL and the row is dropped. ``keep_unless`` writes the negation out as a plain
disjunction of simple comparisons, which keeps pandas' answer and is still pushed
into the Parquet scan (a ``coalesce`` guard would not be). Of the floating-point
columns in ``NAN_COLUMNS`` a NaN is a missing value too; Spark orders NaN above
infinity, so ``> infinity`` tells it in a form that is also pushed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Floating-point columns of the listing and revision tables.
NAN_COLUMNS = ("bathroom_count", "asking_price", "revised_purchase_price")
INFINITY = float("inf")

_NEGATE = {">=": "<", ">": "<=", "<=": ">", "<": ">=", "==": "!=", "!=": "=="}


def compare(col: str, op: str, value) -> Column:
    c = F.col(col)
    v = F.lit(value)
    return {">=": c >= v, ">": c > v, "<=": c <= v, "<": c < v,
            "==": c == v, "!=": c != v}[op]


def matches_all(*conds: tuple[str, str, object]) -> Column:
    """``c1 AND c2 AND ...`` of (column, op, value) comparisons (a missing value
    never matches)."""
    parts = [compare(*c) for c in conds]
    parts += [F.col(col) <= F.lit(INFINITY) for col, op, _ in conds if col in NAN_COLUMNS and op in (">=", ">", "!=")]
    return reduce(lambda a, b: a & b, parts)


def keep_unless(*conds: tuple[str, str, object]) -> Column:
    """Rows to keep for ``NOT (c1 AND c2 ...)`` with pandas' missing-value rule:
    ``c1 IS NULL OR NOT c1 OR c2 IS NULL OR NOT c2 ...``."""
    parts = []
    for col, op, value in conds:
        parts.append(F.col(col).isNull())
        parts.append(compare(col, _NEGATE[op], value))
        if col in NAN_COLUMNS and op in (">=", ">", "!="):
            parts.append(F.col(col) > F.lit(INFINITY))
    return reduce(lambda a, b: a | b, parts)
