"""How good a scored table is, and where it errs.

Inputs are scored tables (label, predicted label, probability); every output
is an aggregate. The ROC curve needs running totals over the score order,
computed with the distributed prefix sum of ``rows`` (no single-partition
window over the table).
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import attach_scalars
from .distribution import histogram
from .rows import with_prefix_sums

CELLS = [(0, 0, "true_negative"), (0, 1, "false_positive"), (1, 0, "false_negative"),
         (1, 1, "true_positive")]


def _cell(label: str, pred: str):
    c = F.lit(None).cast("string")
    for y, p, name in reversed(CELLS):
        c = F.when((F.col(label) == y) & (F.col(pred) == p), F.lit(name)).otherwise(c)
    return c


def confusion(scored: DataFrame, label: str = "revision", pred: str = "y_pred") -> DataFrame:
    """Counts of the four (label, prediction) cells, empty cells as 0."""
    counts = scored.groupBy(F.col(label).cast("int").alias("label"),
                            F.col(pred).cast("int").alias("prediction")).agg(F.count(F.lit(1)).alias("count"))
    cells = F.inline(F.array(*[F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"),
                                        F.lit(n).alias("cell")) for y, p, n in CELLS]))
    grid = scored.sparkSession.range(1).select(cells)
    return (grid.join(counts, ["label", "prediction"], "left")
            .select("label", "prediction", "cell", F.coalesce("count", F.lit(0)).alias("count")))


def confusion_proba_histograms(scored: DataFrame, label: str = "revision", pred: str = "y_pred",
                               proba: str = "proba", bins: int = 10) -> DataFrame:
    """Histogram of the probability within each confusion cell."""
    tagged = scored.select(_cell(label, pred).alias("cell"), proba)
    return histogram(tagged, proba, bins=bins, by=["cell"])


def roc_points(scored: DataFrame, label: str = "revision", proba: str = "proba") -> DataFrame:
    """The origin (no threshold: nothing is predicted 1), then one ROC point
    per distinct score, highest first: the true and false positive rates when
    predicting 1 at that score and above, and the area
    under the curve (trapezoids, ties handled as in the Mann-Whitney form)."""
    per_score = scored.groupBy(F.col(proba).alias("threshold")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"))
    cum = with_prefix_sums(per_score, [F.desc("threshold")], ["pos", "neg"])
    totals = per_score.agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    pts = attach_scalars(cum, totals)
    pts = pts.select("threshold", "pos", "neg",
                     (F.col("pos_cum") / F.col("_P")).alias("tpr"),
                     (F.col("neg_cum") / F.col("_N")).alias("fpr"),
                     (F.col("neg") * (F.col("pos_cum") - F.col("pos") + F.col("pos") / 2.0)
                      / (F.col("_P") * F.col("_N"))).alias("_auc_part"))
    auc = pts.agg(F.sum("_auc_part").alias("auc"))
    zero = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("neg"), F.lit(0.0).alias("tpr"), F.lit(0.0).alias("fpr"))
    return attach_scalars(zero.unionByName(pts.drop("_auc_part")), auc)


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, in one aggregate
    (long form: col_a, col_b, corr; both orders and the diagonal)."""
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    one = df.agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double")).alias(f"_c{i}_{j}")
                   for i, j in pairs])
    entries = []
    for i, j in pairs:
        entries.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                F.col(f"_c{i}_{j}").alias("corr")))
        if i != j:
            entries.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"),
                                    F.col(f"_c{i}_{j}").alias("corr")))
    return one.select(F.inline(F.array(*entries)))


def class_balance(df: DataFrame, label: str = "revision", split_col: str = "split") -> DataFrame:
    """Rows per class in each split."""
    return df.groupBy(split_col, label).agg(F.count(F.lit(1)).alias("count"))


def segment_contrast(scored: DataFrame, segment: dict, keys: list[str], cols: list[str],
                     label: str = "revision", pred: str = "y_pred", label_value: int = 0) -> DataFrame:
    """Within one segment (e.g. a town, type and tenure) and one true
    class, the mean of each column for predicted 1 against predicted 0."""
    cond = F.col(label) == label_value
    for c, v in segment.items():
        cond = cond & (F.col(c) == F.lit(v))
    return (scored.filter(cond).groupBy(*keys, pred)
            .agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]))


def false_positive_breakdown(scored: DataFrame, keys: list[str], k: int = 10,
                             label: str = "revision", pred: str = "y_pred") -> DataFrame:
    """The k (type, tenure, town) groups with most false positives; ties
    by the keys, descending. The limit is the report."""
    return (scored.filter((F.col(label) == 0) & (F.col(pred) == 1))
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("false_positive_count"))
            .orderBy(F.desc("false_positive_count"), *[F.desc(c) for c in keys]).limit(k))


def compare_models(scored_a: DataFrame, scored_b: DataFrame, label: str = "revision",
                   pred: str = "y_pred") -> DataFrame:
    """Confusion cells of two models side by side."""
    a = confusion(scored_a, label, pred).withColumnRenamed("count", "count_a")
    b = confusion(scored_b, label, pred).select("label", "prediction", F.col("count").alias("count_b"))
    return a.join(b, ["label", "prediction"]).withColumn("change", F.col("count_b") - F.col("count_a"))


def compare_false_positives(scored_a: DataFrame, scored_b: DataFrame, keys: list[str], k: int = 10,
                            label: str = "revision", pred: str = "y_pred") -> DataFrame:
    """The groups among the ``k`` with most false positives of either model, with both
    models' counts (0 if a model has none there) and their difference."""
    # One count of each table, stored: a row per group
    counts = [s.filter((F.col(label) == 0) & (F.col(pred) == 1)).groupBy(*keys).agg(F.count(F.lit(1)).alias(f"count_{m}"))
              .checkpoint(eager=True) for m, s in (("a", scored_a), ("b", scored_b))]
    top = [c.orderBy(F.desc(c.columns[-1]), *[F.desc(x) for x in keys]).limit(k).select(*keys) for c in counts]
    both = top[0].unionByName(top[1]).distinct()
    for c in counts:
        both = both.join(c, keys, "left")
    return (both.na.fill(0, ["count_a", "count_b"])
            .withColumn("change", F.col("count_b") - F.col("count_a")))
