"""Histograms, kernel density and normal Q-Q points."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal import with_norm_ppf
from ..functions.quantiles import without_null_keys
from ..plans.joins import attach_scalars, join_small
from .rows import with_group_rank


def _group_stats(df: DataFrame, by: list[str], aggs) -> DataFrame:
    return df.groupBy(*by).agg(*aggs)


def _join_stats(df: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    return join_small(df, stats, by) if by else attach_scalars(df, stats)


def histogram(df: DataFrame, col: str, bins: int = 10, by: list[str] | None = None,
              edges: list[float] | None = None, density: bool = False) -> DataFrame:
    """Bin counts per group, empty bins included.

    Without ``edges``: ``bins`` equal-width bins over each group's [min, max],
    the last bin closed (a constant group gets the range value +- 0.5). With
    ``edges``: the given bins; values outside [edges[0], edges[-1]] are not
    counted. ``density`` adds count / (n * width)."""
    by = list(by or [])
    x = F.col(col)
    data = without_null_keys(df.select(*by, col).filter(x.isNotNull()), by)
    if edges is None:
        stats = _group_stats(data, by, [F.min(x).alias("_lo0"), F.max(x).alias("_hi0")])
        stats = stats.select(
            *by,
            F.when(F.col("_lo0") == F.col("_hi0"), F.col("_lo0") - 0.5).otherwise(F.col("_lo0")).alias("_lo"),
            F.when(F.col("_lo0") == F.col("_hi0"), F.col("_hi0") + 0.5).otherwise(F.col("_hi0")).alias("_hi"))
        lo, hi = F.col("_lo"), F.col("_hi")
        width = (hi - lo) / bins
        idx = F.least(F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))), F.lit(bins - 1)).cast("int")
        counted = _join_stats(data, stats, by).groupBy(*by, idx.alias("bin")).agg(
            F.count(F.lit(1)).alias("count"))
        grid = stats.select(*by, "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
        grid = grid.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_lo"),
                           F.when(F.col("bin") == bins - 1, F.col("_hi"))
                           .otherwise(F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_hi"))
    else:
        if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
            raise ValueError("edges must be increasing, at least two")
        nb = len(edges) - 1
        idx = F.lit(None).cast("int")
        for i in reversed(range(nb)):
            cond = x < F.lit(float(edges[i + 1])) if i < nb - 1 else x <= F.lit(float(edges[-1]))
            idx = F.when(cond, F.lit(i)).otherwise(idx)
        idx = F.when(x >= F.lit(float(edges[0])), idx)
        counted = (data.select(*by, idx.alias("bin")).filter(F.col("bin").isNotNull())
                   .groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count")))
        keys = data.select(*by).distinct() if by else None
        edge_rows = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("bin_lo"),
                                       F.lit(float(edges[i + 1])).alias("bin_hi")) for i in range(nb)])
        if keys is not None:
            grid = keys.select(*by, F.inline(edge_rows))
        else:
            grid = data.sparkSession.range(1).select(F.inline(edge_rows))
    out = grid.join(counted, [*by, "bin"], "left").select(
        *by, "bin", "bin_lo", "bin_hi", F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
    if density:
        totals = out.groupBy(*by).agg(F.sum("count").alias("_n"))
        out = (_join_stats(out, totals, by)
               .withColumn("density", F.when(F.col("_n") > 0, F.col("count") / (
                   F.col("_n") * (F.col("bin_hi") - F.col("bin_lo")))))
               .drop("_n"))
    return out


TERMS = 28                       # of the Hermite expansion
BOX = 1.0                        # box width, in units of sqrt(2) * bandwidth


def kde_error(terms: int = TERMS, box: float = BOX) -> float:
    """Bound on what the expansion leaves out of one kernel (whose peak is 1): the terms from
    ``terms`` on, by Cramer's inequality |h_k(x)| <= 1.09 * 2^(k/2) * sqrt(k!)."""
    q = box / math.sqrt(2)
    return 1.09 * sum(q ** k / math.sqrt(math.factorial(k)) for k in range(terms, terms + 60))


def kde(df: DataFrame, col: str, by: list[str] | None = None, points: int = 100,
        cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density of ``col`` per group on ``points`` grid
    points spanning [min - cut*h, max + cut*h]; bandwidth h = sample std *
    n^(-1/5) (Scott's rule). A group with one value, or equal ones, has no
    bandwidth and keeps one row with NULLs.

    A fast Gauss transform: values fall into boxes of ``BOX`` * sqrt(2) * h, and a box is
    the sums of (s - c)^k / k! of its values about its centre, added up before the
    shuffle. The density at a point is the sum over boxes of the Hermite expansion,
    so what moves per group is its boxes (the range over the bandwidth), not
    values times points. ``kde_error`` bounds what ``TERMS`` terms leave out of a
    kernel: below 1e-16 of its peak."""
    by = list(by or [])
    x = F.col(col)
    data = without_null_keys(df.select(*by, x.cast("double").alias("_x")).filter(x.isNotNull()), by)
    v = F.col("_x")
    stats = _group_stats(data, by, [F.count(v).alias("_n"), F.stddev_samp(v).alias("_sd"),
                                    F.min(v).alias("_min"), F.max(v).alias("_max")])
    stats = stats.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    flat = stats.filter(~F.coalesce(F.col("_bw") > 0, F.lit(False)))
    stats = stats.filter(F.col("_bw") > 0).select(
        *by, "_n", "_bw", "_min", (F.col("_min") - cut * F.col("_bw")).alias("_glo"),
        (F.col("_max") + cut * F.col("_bw")).alias("_ghi"))
    s = (v - F.col("_min")) / (F.col("_bw") * math.sqrt(2))            # place, in units of the kernel
    placed = _join_stats(data, stats, by).select(*by, s.alias("_s"), F.floor(s / BOX).alias("_box"))
    d = F.col("_s") - (F.col("_box") + 0.5) * BOX
    placed = placed.select(*by, "_box", d.alias("_d"))
    sums = [F.sum(F.pow("_d", F.lit(float(k))) / float(math.factorial(k))).alias(f"_m{k}") for k in range(TERMS)]
    boxes = placed.groupBy(*by, "_box").agg(*sums)
    boxes = boxes.select(*by, ((F.col("_box") + 0.5) * BOX).alias("_c"), F.array(*[f"_m{k}" for k in range(TERMS)]).alias("_m"))
    step = (F.col("_ghi") - F.col("_glo")) / (points - 1)
    grid = stats.select(*by, "_n", "_bw", "_min", "_glo", step.alias("_step"),
                        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    grid = grid.withColumn("x", F.col("_glo") + F.col("point") * F.col("_step"))
    pairs = grid.join(boxes, by) if by else grid.crossJoin(boxes)     # of one group: points x boxes
    t = (F.col("x") - F.col("_min")) / (F.col("_bw") * math.sqrt(2)) - F.col("_c")

    def term(a, m):              # h_{k+1} = 2 t h_k - 2 k h_{k-1}
        nxt = 2 * a["t"] * a["h"] - 2 * a["k"] * a["g"]
        return F.struct(a["t"].alias("t"), (a["k"] + 1).alias("k"), a["h"].alias("g"), nxt.alias("h"),
                        (a["sum"] + m * a["h"]).alias("sum"))
    start = F.struct(t.alias("t"), F.lit(0.0).alias("k"), F.lit(0.0).alias("g"), F.exp(-t * t).alias("h"), F.lit(0.0).alias("sum"))
    part = F.aggregate("_m", start, term, lambda a: a["sum"])
    curve = (pairs.select(*by, "point", "x", "_n", "_bw", part.alias("_k")).groupBy(*by, "point")
             .agg(F.first("x").alias("x"), F.sum("_k").alias("_k"), F.first("_n").alias("_n"), F.first("_bw").alias("_bw"))
             .select(*by, "point", "x", (F.greatest(F.col("_k"), F.lit(0.0)) / (F.col("_n") * F.col("_bw") * math.sqrt(2 * math.pi)))
                     .alias("density")))
    return curve.unionByName(flat.select(*by, F.lit(None).cast("int").alias("point"),
                                         F.lit(None).cast("double").alias("x"),
                                         F.lit(None).cast("double").alias("density")))


def qq_points(df: DataFrame, keys: list[str], col: str, method: str = "ranked") -> DataFrame:
    """Normal Q-Q points per group: sorted values against the normal
    quantiles of Filliben's order-statistic medians, and the two-point guide
    line from (min x, min y) to (max x, max y) as group columns.

    ``method='ranked'`` ranks with the distributed row index (any group size);
    ``'window'`` uses a per-group window and is meant for tables whose groups
    are bounded by construction, such as one row per group and day."""
    data = without_null_keys(df.select(*keys, col).filter(F.col(col).isNotNull()), keys)
    if method == "window":
        ranked = data.select(*keys, col,
                             (F.row_number().over(Window.partitionBy(*keys).orderBy(col)) - 1)
                             .cast("long").alias("rank"),
                             F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("n"))
    elif method == "ranked":
        ranked = with_group_rank(data, keys, [F.col(col)], "rank", "n", tiebreak=True)
    else:
        raise ValueError(f"unknown method {method!r}")
    n = F.col("n").cast("double")
    i = F.col("rank")
    last = F.pow(F.lit(0.5), 1 / n)
    m = (F.when(i == 0, 1 - last).when(i == F.col("n") - 1, last)
         .otherwise((i + 1 - 0.3175) / (n + 0.365)))
    pts = with_norm_ppf(ranked.select(*keys, "rank", "n", m.alias("_m"), F.col(col).alias("sample")),
                        "_m", "theoretical").select(*keys, "rank", "n", "theoretical", "sample")
    line = pts.groupBy(*keys).agg(F.min("theoretical").alias("line_x0"), F.max("theoretical").alias("line_x1"),
                                  F.min("sample").alias("line_y0"), F.max("sample").alias("line_y1"))
    return _join_stats(pts, line, keys) if keys else attach_scalars(pts, line)
