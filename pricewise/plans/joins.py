"""Join helpers.

* ``attach_scalars``: add the columns of a one-row aggregate to every row as a
  scalar subquery (planned once, shipped as a value; no cross join).
* ``join_small``: join a side that is usually small (an encoder map, a table of
  group statistics); adaptive execution broadcasts it if its measured size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def attach_scalars(df: DataFrame, one_row: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``df`` plus the columns of the single-row DataFrame ``one_row``."""
    cols = cols or one_row.columns
    packed = one_row.select(F.struct(*cols).alias("_s")).scalar()
    return df.select("*", *[packed.getField(c).alias(c) for c in cols])


def join_small(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join a side that is usually small.

    The choice is left to adaptive execution, which broadcasts the side only
    when its measured shuffle output is under
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise keeps a
    sort-merge join."""
    return left.join(right, on, how)


# A key with more rows than this on the many-rows side is split into SALTS
# sub-keys. The hot-key list therefore has fewer than rows / HOT_ROWS entries,
# which bounds what is broadcast.
HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(counts: DataFrame, keys: list[str], count_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, flagged ``_hot`` (small by construction)."""
    return counts.filter(F.col(count_col) > hot_rows).select(*keys, F.lit(True).alias("_hot"))


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str, hot: DataFrame,
                salts: int = SALTS) -> DataFrame:
    """Join ``big`` (many rows per key) with ``small`` (at most one row per key)
    so that no key's rows meet in one task.

    ``hot`` lists the heavy keys (``hot_keys``). Their rows in ``big`` get a
    salt in [0, salts) from a hash of the row (the same after a recomputation);
    their row in ``small`` is repeated once per salt;
    every other key keeps salt 0. ``how`` is 'inner', 'left' (keep every row of
    ``big``) or 'left_anti' (rows of ``big`` whose key is not in ``small``);
    each row of ``big`` meets exactly the copy with its salt, so results equal
    the plain join's."""
    if how not in ("inner", "left", "left_anti"):
        raise ValueError("how must be 'inner', 'left' or 'left_anti'")
    flag = F.broadcast(hot)
    b = (big.join(flag, keys, "left")
         .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
         .drop("_hot"))
    s = (small.join(flag, keys, "left")
         .withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                                        .otherwise(F.array(F.lit(0)))))
         .drop("_hot"))
    return b.join(s, [*keys, "_salt"], how).drop("_salt")
