"""Feature encoders fitted on one table, applied to any.

Fitted state is itself a small DataFrame (category -> mean, column -> min/max),
kept in the checkpoint folder; applying it is a join or a scalar subquery, never a driver-side dictionary of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import cyclic_cos, cyclic_sin
from ..plans.joins import attach_scalars

# Fixed values of the reference's feature set.
CATEGORICAL = ["property_type", "tenure", "location"]
FEATURES = ["property_type", "tenure", "bedroom_count", "location", "time_listed",
            "log10_asking_price", "day_listed", "week_listed"]
EXTENDED = ["property_type", "tenure", "location", "sin_day", "cos_day", "sin_week", "cos_week",
            "bedroom_count", "time_listed", "log10_asking_price"]
SCALED = ["bedroom_count", "time_listed", "log10_asking_price"]
DAY_PERIOD = 6
WEEK_PERIOD = 53


# ---------------------------------------------------------------- I11 mean encoder

@dataclass
class MeanEncoderModel:
    cols: list[str]
    mapping: DataFrame  # column_name, value, mean

    def transform(self, df: DataFrame) -> DataFrame:
        """Replace each category by its fitted mean target; unseen -> NULL. Adaptive execution
        broadcasts a column's map if its measured bytes allow."""
        out = df
        for c in self.cols:
            m = (self.mapping.filter(F.col("column_name") == c)
                 .select(F.col("value").alias(f"_v_{c}"), F.col("mean").alias(f"_m_{c}")))
            out = (out.join(m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
                   .withColumn(c, F.col(f"_m_{c}")).drop(f"_v_{c}", f"_m_{c}"))
        return out

    def table(self, column: str) -> DataFrame:
        """The encoding of one column, sorted by mean."""
        return (self.mapping.filter(F.col("column_name") == column)
                .select(F.col("value").alias(column), "mean").orderBy("mean", column))


class MeanEncoder:
    """Mean of the label per category value, for several columns in
    one aggregate (values of all columns are unpivoted into one key)."""

    def __init__(self, cols: list[str]):
        self.cols = list(cols)

    def fit(self, df: DataFrame, label: str) -> MeanEncoderModel:
        cells = df.select(F.col(label).cast("double").alias("_y"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"))
            for c in self.cols])).alias("_c"))
        mapping = (cells.select("_c.column_name", "_c.value", "_y").filter(F.col("value").isNotNull())
                   .groupBy("column_name", "value").agg(F.avg("_y").alias("mean"))
                   .checkpoint(eager=True))
        return MeanEncoderModel(self.cols, mapping)


# ---------------------------------------------------------------- I12, I13, I14

def cyclic(df: DataFrame, col: str, period: float, name: str | None = None) -> DataFrame:
    """Sin and cos of ``col`` / period * 2 pi as ``sin_<name>``, ``cos_<name>``."""
    name = name or col
    return df.withColumns({f"sin_{name}": cyclic_sin(col, period), f"cos_{name}": cyclic_cos(col, period)})


@dataclass
class MinMaxModel:
    cols: list[str]
    stats: DataFrame  # one row: <c>_min, <c>_max

    def transform(self, df: DataFrame) -> DataFrame:
        """(x - min) / (max - min), with a zero range treated as 1 (as sklearn)."""
        withs = attach_scalars(df, self.stats)
        for c in self.cols:
            lo, hi = F.col(f"__{c}_min"), F.col(f"__{c}_max")
            rng = F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo)
            withs = withs.withColumn(c, (F.col(c) - lo) / rng)
        return withs.drop(*[f"__{c}_{s}" for c in self.cols for s in ("min", "max")])


def min_max_fit(df: DataFrame, cols: list[str]) -> MinMaxModel:
    """Fit min-max scaling on ``df`` (one aggregate row)."""
    aggs = []
    for c in cols:
        aggs += [F.min(F.col(c).cast("double")).alias(f"__{c}_min"),
                 F.max(F.col(c).cast("double")).alias(f"__{c}_max")]
    return MinMaxModel(list(cols), df.agg(*aggs))


def interactions(df: DataFrame, a: str, b: str, out: str | None = None) -> DataFrame:
    """Pairwise interaction term a*b (the bias and the two terms
    themselves are kept as they are; no squares)."""
    return df.withColumn(out or f"{a}_x_{b}", F.col(a) * F.col(b))


def interaction_set(df: DataFrame, a: str, b: str, rest: list[str], keep: list[str] = ()) -> DataFrame:
    """I14 as the refit uses it: bias, ``a``, ``b``, ``a * b``, then ``rest`` untouched (and ``keep``,
    columns that are no features, in front)."""
    return interactions(df, a, b).select(*keep, F.lit(1.0).alias("bias"), a, b, f"{a}_x_{b}",
                                         *[c for c in rest if c not in (a, b)])


# ---------------------------------------------------------------- I10

@dataclass
class OneHotModel:
    levels: dict[str, list]  # column -> levels that get a column

    def names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.levels.items() for v in vs]

    def transform(self, df: DataFrame) -> DataFrame:
        """One 0/1 column per fitted level; a level not seen in fitting and a
        null give 0 in all of them. Other columns pass through."""
        out = df
        for c, vs in self.levels.items():
            out = out.withColumns({f"{c}_{v}": F.coalesce((F.col(c) == F.lit(v)).cast("double"), F.lit(0.0))
                                   for v in vs}).drop(c)
        return out


MAX_LEVELS = 2_000               # output columns of one category


def one_hot_fit(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> OneHotModel:
    """Levels of each column, sorted (``<col>_<level>``); a column with exactly
    two levels keeps only the second. The levels become columns of the result,
    so the driver has to know them: their number is the width of the output. More than
    ``max_levels`` are an error (``sparse_model`` has no such bound)."""
    levels = {}
    for c in cols:
        vals = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_levels + 1).collect()
        if len(vals) > max_levels:
            raise ValueError(f"{c}: more than {max_levels} levels")
        vals = sorted(r[0] for r in vals)
        levels[c] = vals[1:] if len(vals) == 2 else vals
    return OneHotModel(levels)


def one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fit and transform the same table."""
    return one_hot_fit(df, cols).transform(df)


# ---------------------------------------------------------------- D19

def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Weight n / (k * n_class) per row; the class table has one row per
    class and is broadcast."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    totals = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = attach_scalars(counts, totals).select(
        label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label, "left")


# ---------------------------------------------------------------- the reference's feature set

@dataclass
class FeatureModel:
    encoder: MeanEncoderModel
    scaler: MinMaxModel

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.encoder.transform(df)
        out = cyclic(out, "day_listed", DAY_PERIOD, "day")
        out = cyclic(out, "week_listed", WEEK_PERIOD, "week")
        return self.scaler.transform(out)


def fit_features(train: DataFrame, label: str = "revision") -> FeatureModel:
    """Mean-encode the three categories, sin/cos of weekday (period 6) and week
    (period 53), min-max scale the rest; all fitted on ``train``."""
    return FeatureModel(MeanEncoder(CATEGORICAL).fit(train, label), min_max_fit(train, SCALED))


# ---------------------------------------------------------------- features of every fold at once

@dataclass
class FoldFeatureModel:
    """For every fold, the features fitted on the rows outside it."""
    mapping: DataFrame           # column_name, value, m0 .. m{folds - 1}
    stats: DataFrame             # one row: per fold and scaled column its least and greatest value
    folds: int

    def transform(self, df: DataFrame, out: str = "x") -> DataFrame:
        """``df`` with ``out``: for each fold the columns of ``EXTENDED``, one fold after the other
        (NULL where a category does not occur outside the fold)."""
        rows = df
        for c in CATEGORICAL:
            m = self.mapping.filter(F.col("column_name") == c).select(
                F.col("value").alias(f"_v_{c}"), *[F.col(f"m{f}").alias(f"_{c}{f}") for f in range(self.folds)])
            rows = rows.join(m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left")
        rows = cyclic(cyclic(rows, "day_listed", DAY_PERIOD, "day"), "week_listed", WEEK_PERIOD, "week")
        rows = attach_scalars(rows, self.stats)
        cells = []
        for f in range(self.folds):
            for c in EXTENDED:
                if c in CATEGORICAL:
                    cells.append(F.col(f"_{c}{f}"))
                elif c in SCALED:
                    lo, hi = F.col(f"__lo{f}_{c}"), F.col(f"__hi{f}_{c}")
                    cells.append((F.col(c) - lo) / F.when(hi - lo == 0, F.lit(1.0)).otherwise(hi - lo))
                else:
                    cells.append(F.col(c))
        return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != out],
                           F.array(*[c.cast("double") for c in cells]).alias(out))


def fit_features_by_fold(train: DataFrame, label: str, folds: int, fold_col: str = "fold") -> FoldFeatureModel:
    """I11/I13 for every fold in one aggregate each: a category's mean outside fold f is its sum
    and count minus those of f; ranges outside f are conditional extremes."""
    y = F.col(label).cast("double")
    cells = train.select(y.alias("_y"), F.col(fold_col).alias("_f"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in CATEGORICAL])).alias("_c"))
    cells = cells.select("_c.column_name", "_c.value", "_y", "_f").filter("value IS NOT NULL")
    mine = [F.col("_f") == f for f in range(folds)]
    sums = cells.groupBy("column_name", "value").agg(
        F.sum("_y").alias("_s"), F.count("_y").alias("_n"),
        *[F.sum(F.when(m, F.col("_y")).otherwise(0.0)).alias(f"_s{f}") for f, m in enumerate(mine)],
        *[F.count(F.when(m, F.col("_y"))).alias(f"_n{f}") for f, m in enumerate(mine)])
    mapping = sums.select("column_name", "value", *[
        F.when(F.col("_n") > F.col(f"_n{f}"), (F.col("_s") - F.col(f"_s{f}")) / (F.col("_n") - F.col(f"_n{f}"))).alias(f"m{f}")
        for f in range(folds)]).checkpoint(eager=True)
    out = [F.col(fold_col) != f for f in range(folds)]
    stats = train.agg(*[agg(F.when(o, F.col(c).cast("double"))).alias(f"__{name}{f}_{c}")
                        for f, o in enumerate(out) for c in SCALED for name, agg in (("lo", F.min), ("hi", F.max))])
    return FoldFeatureModel(mapping, stats.checkpoint(eager=True), folds)
