"""Exact, linearly interpolated quantiles per group (as pandas ``quantile``,
Spark ``percentile`` and SQL ``quantile_cont``): value at position (n-1)p.

Rows whose key has a null are dropped; a group without any value keeps its row
with NULL quantiles. The plans below give the same rows and the same numbers;
``auto``, the default, reads the input once (keys and value are stored) and picks
per group (tests compare them on every case):

* ``"percentile"``: Spark's ``percentile`` aggregate. It combines map-side, but
  the final merge of a group keeps one entry per distinct value of that group in
  one task. Right for many small groups (a town's prices on one day).
* ``"narrowed"``: fully distributed selection. Every wanted order statistic has a
  bracket of values that starts as the group's range; a round counts the values of the
  bracket in ``CELLS`` parts (added up before the shuffle) and keeps the part that
  holds the rank, with the actual least and greatest value in it. All groups and
  probabilities share the rounds. It ends when a bracket is one value or holds at most
  ``KEEP`` of them, which are then sorted. Nothing is sorted globally, and no task holds
  more of a group than its cells. Right for the whole table or coarse groups.
* ``"ranked"``: the same by a global sort. Rows are first reduced to (group, value,
  count), then ranked by a global range-partitioned prefix sum of the counts,
  and only the rows covering ranks floor/ceil((n-1)p) are kept. No group, however
  large, is held by one task. Right for the whole table or coarse groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rows import with_prefix_sums
from ..plans.joins import HOT_ROWS, hot_keys, salted_join
from ..session import ensure_checkpoint_dir


CELLS = 256                      # parts of a bracket in a round
KEEP = 10_000                    # values of a bracket that are sorted at the end


def _name(p: float) -> str:
    return f"q{int(round(p * 100)):02d}" if abs(p * 100 - round(p * 100)) < 1e-9 else f"q{p}"


def without_null_keys(df: DataFrame, keys) -> DataFrame:
    """Rows whose keys are all present: a null key names no group."""
    return df.na.drop(subset=list(keys)) if keys else df


def group_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float],
                    names: list[str] | None = None, method: str = "auto",
                    count_col: str | None = None, hot_rows: int = HOT_ROWS, stored: bool = False) -> DataFrame:
    """One row per group: ``keys``, the quantiles (named by ``names``) and,
    when ``count_col`` is set, the number of non-null values.

    ``method='auto'`` stores keys and value, so the input is computed once, and counts
    values per group: groups with at most ``hot_rows`` values use ``percentile``
    (its per-group map then holds at most ``hot_rows`` entries), larger groups are
    narrowed (``stored``: the input is a stored table already); the two are unioned. When no group is that large (the common
    case) only the cheap plan runs."""
    names = names or [_name(p) for p in probs]
    v = F.col(value)
    df = without_null_keys(df.select(*keys, value), keys)
    if method == "auto":
        ensure_checkpoint_dir(df.sparkSession)
        data = df if stored else df.checkpoint(eager=True)
        sizes = data.groupBy(*keys).agg(F.count(v).alias("_gn"))
        hot = sizes.filter(F.col("_gn") > hot_rows).select(*keys)
        if hot.isEmpty():
            return group_quantiles(data, keys, value, probs, names, "percentile", count_col)
        if not keys:
            return group_quantiles(data, keys, value, probs, names, "narrowed", count_col)
        # The hot list has fewer than rows / hot_rows entries: a bounded broadcast.
        small = group_quantiles(data.join(F.broadcast(hot), keys, "left_anti"), keys, value, probs,
                                names, "percentile", count_col)
        big = group_quantiles(data.join(F.broadcast(hot), keys, "left_semi"), keys, value, probs,
                              names, "narrowed", count_col)
        return small.unionByName(big)
    if method == "percentile":
        aggs = [F.percentile(v, F.lit(float(p))).alias(n) for p, n in zip(probs, names)]
        if count_col:
            aggs.append(F.count(v).alias(count_col))
        return df.groupBy(*keys).agg(*aggs)
    if method == "narrowed":
        return _narrowed(df, keys, value, probs, names, count_col)
    if method != "ranked":
        raise ValueError(f"unknown quantile method {method!r}")

    groups = df.groupBy(*keys).agg(F.count(v).alias("_all"))
    # 1. (group, value) -> count: map-side combined, so a hot value is one row.
    counted = (df.filter(v.isNotNull()).groupBy(*keys, value)
               .agg(F.count(F.lit(1)).alias("_w")))
    # 2. Global running count in (group, value) order.
    ranked = with_prefix_sums(counted, [F.col(k) for k in keys] + [v], ["_w"])
    # 3. Where each group starts, and its size.
    start_aggs = [F.min(F.col("_w_cum") - F.col("_w")).alias("_start"),
                  F.sum("_w").alias("_n")]
    if keys:
        # One row per group, joined back to the group's distinct values with a
        # salted join, so a group with very many distinct values is split.
        starts = ranked.groupBy(*keys).agg(*start_aggs, F.count(F.lit(1)).alias("_d"))
        spans = salted_join(ranked, starts.drop("_d"), keys, "inner", hot_keys(starts, keys, "_d"))
    else:
        # The whole table is one group: its start and size are scalar subqueries.
        spans = ranked.select("*", *[ranked.select(a).scalar().alias(a_name)
                                     for a, a_name in zip(start_aggs, ("_start", "_n"))])
    spans = spans.select(*keys, v, "_n",
                         (F.col("_w_cum") - F.col("_w") - F.col("_start")).alias("_lo"),
                         (F.col("_w_cum") - F.col("_start") - 1).alias("_hi"))
    # 4. Pick the values at floor and ceil of (n-1)p, then interpolate.
    aggs = [F.first("_n").alias("_n")]
    for i, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for tag, r in (("f", F.floor(pos)), ("c", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("_lo") <= r) & (r <= F.col("_hi")), v))
                        .alias(f"_{tag}{i}"))
    picked = spans.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys]
    for i, (p, n) in enumerate(zip(probs, names)):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"_f{i}"), F.col(f"_c{i}")
        out.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(n))
    if not keys:                 # a global aggregate always has its row
        if count_col:
            out.append(F.coalesce("_n", F.lit(0)).cast("long").alias(count_col))
        return picked.select(*out)
    if count_col:
        out.append(F.col("_n").alias(count_col))
    # Groups without values keep a row of NULLs.
    bare = groups.filter("_all = 0").select(*keys, *[F.lit(None).cast("double").alias(n) for n in names],
                                            *([F.lit(0).cast("long").alias(count_col)] if count_col else []))
    return picked.select(*out).unionByName(bare)


def _narrowed(df: DataFrame, keys: list[str], value: str, probs: list[float], names: list[str],
              count_col: str | None) -> DataFrame:
    """The ``narrowed`` plan. For large groups: their number, and with it the table of
    brackets that meets the rows in each round, is below rows / group size."""
    ensure_checkpoint_dir(df.sparkSession)
    whole = not keys
    by = ["_whole"] if whole else list(keys)
    vals = df.select(*([F.lit(0).alias("_whole")] if whole else keys), F.col(value).cast("double").alias("_v"))
    groups = vals.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = groups.checkpoint(eager=True)
    pos = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + k).alias("t"), f(x).cast("long").alias("r"))
                      for i, x in enumerate(pos) for k, f in enumerate((F.floor, F.ceil))])
    open_ = groups.filter("_n > 0").select(*by, F.explode(ranks).alias("_x"), "_lo", "_hi", F.lit(0).cast("long").alias("_b"),
                                           F.col("_n").alias("_m"))
    open_ = open_.select(*by, F.col("_x.t").alias("_t"), F.col("_x.r").alias("_r"), "_lo", "_hi", "_b", "_m")
    wide = (F.col("_m") > KEEP) & (F.col("_lo") < F.col("_hi"))
    closed = open_.filter(~wide)
    open_ = open_.filter(wide)
    held = vals.filter("_v IS NOT NULL")
    inside = F.col("_v").between(F.col("_lo"), F.col("_hi"))
    while not open_.isEmpty():
        # Cells are equal in logarithms (signed, for all doubles but zero at least 5 from zero)
        # while the bracket spans more than a factor of e, else equal in width; so a
        # bracket of any two doubles is down to one value after some nine rounds.
        v, lo, hi = (F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 750)) for c in ("_v", "_lo", "_hi"))
        share = F.when(hi - lo > 1, (v - lo) / (hi - lo)).otherwise(
            (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
        cells = (held.join(F.broadcast(open_), by).filter(inside).groupBy(*by, "_t", cell.alias("_j"))
                 .agg(F.count("_v").alias("_m"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
                      F.max("_r").alias("_r"), F.max("_b").alias("_b")))
        before = Window.partitionBy(*by, "_t").orderBy("_j").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_b", F.col("_b") + F.coalesce(F.sum("_m").over(before), F.lit(0)))
        found = (cells.filter((F.col("_b") <= F.col("_r")) & (F.col("_r") < F.col("_b") + F.col("_m"))).drop("_j")
                 .checkpoint(eager=True))
        closed = closed.unionByName(found.filter(~wide))
        open_ = found.filter(wide)
    # What is left of a bracket is sorted; a bracket of one value needs no rows.
    rest = (held.join(F.broadcast(closed.filter("_lo < _hi")), by).filter(inside)
            .groupBy(*by, "_t").agg(F.array_sort(F.collect_list("_v")).alias("_s"), F.max("_r").alias("_r"), F.max("_b").alias("_b"))
            .select(*by, "_t", F.get("_s", (F.col("_r") - F.col("_b")).cast("int")).alias("_x")))
    picked = closed.filter("_lo = _hi").select(*by, "_t", F.col("_lo").alias("_x")).unionByName(rest)
    picked = picked.groupBy(*by).agg(*[F.max(F.when(F.col("_t") == t, F.col("_x"))).alias(f"_q{t}") for t in range(2 * len(probs))])
    out = groups.select(*by, "_n").join(picked, by, "left")
    cols = [F.col(k) for k in keys]
    for i, (x, name) in enumerate(zip(pos, names)):
        frac, lo, hi = x - F.floor(x), F.col(f"_q{2 * i}"), F.col(f"_q{2 * i + 1}")
        cols.append(F.when(frac == 0, lo).otherwise(lo + (hi - lo) * frac).alias(name))
    if count_col:
        cols.append(F.coalesce("_n", F.lit(0)).cast("long").alias(count_col))
    if whole:                    # a global aggregate always has its row
        spark = df.sparkSession
        out = spark.createDataFrame([(0,)], "_whole int").join(out, "_whole", "left")
    return out.select(*cols)
