"""Seeded order, samples and splits; distributed row index and prefix sums.

Nothing here sorts the whole table into one task. A global position is found the
way a distributed system has to: range-partition on a unique sort key, sort each
partition, count rows per partition (one small row per partition), turn the
counts into offsets, and add the offset back. The partitioned, sorted table is
checkpointed into the session's checkpoint folder before it is read twice, so
both reads see the same partitions even if an executor is lost and a stage is
recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import hot_keys, salted_join
from ..session import ensure_checkpoint_dir


# ---------------------------------------------------------------- F4, F5, F6

def hash_key(key, seed: int = 42) -> Column:
    """Repeatable pseudo-random sort key of a row: md5 of ``"<key>-<seed>"``.

    Unlike ``rand()`` it does not depend on partitioning, and any SQL engine with
    ``md5`` computes the same value."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(k.cast("string"), F.lit(f"-{seed}")))


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42, out: str = "shuffle_key",
                   index_col: str | None = None) -> DataFrame:
    """the table in a repeatable random order (sort key kept as a column), with the
    position in it if ``index_col`` is given."""
    keyed = df.withColumn(out, hash_key(key, seed))
    if index_col:
        keyed = with_row_index(keyed, [F.col(out), F.col(key)], index_col, materialise_input=True)
    return keyed.orderBy(out, key)


def _fraction_threshold(frac: float) -> str:
    if not 0.0 <= frac <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return format(min(int(round(frac * 16 ** 8)), 16 ** 8), "08x") if frac < 1 else "g"


def sample_fraction(df: DataFrame, key, frac: float, seed: int = 42) -> DataFrame:
    """about ``frac`` of the rows, chosen by a hash of the key.

    The first 8 hex digits of the md5 key are compared with ``frac * 16^8``; a
    row's membership does not depend on partitioning or on other rows."""
    return df.filter(F.substring(hash_key(key, seed), 1, 8) < F.lit(_fraction_threshold(frac)))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """exactly ``min(n, rows)`` rows: the ``n`` smallest hash keys.

    ``orderBy().limit(n)`` plans as a top-n per partition plus one merge of at
    most ``n`` rows per partition; the limit is the feature."""
    return (df.withColumn("_hk", hash_key(key, seed))
            .orderBy("_hk", key).limit(n).drop("_hk"))


# ---------------------------------------------------------------- row index

def _range_sorted(df: DataFrame, order: list, num_partitions: int | None,
                  materialise_input: bool = False) -> DataFrame:
    """Range-partitioned and sorted, with partition id and in-partition position,
    checkpointed so that every later read sees the same rows in each partition.

    Range partitioning reads its input twice (a sampling pass for the bounds,
    then the shuffle); ``materialise_input`` writes an expensive input (joins,
    aggregates) once first so that both passes read the stored copy."""
    ensure_checkpoint_dir(df.sparkSession)
    if materialise_input:
        df = df.checkpoint(eager=True)
    # Without an explicit count, adaptive execution may merge adjacent range
    # partitions into fewer, larger ones; the order is kept, and the partition
    # ids below are fixed by the checkpoint.
    ranged = (df.repartitionByRange(num_partitions, *order) if num_partitions
              else df.repartitionByRange(*order))
    ordered = (ranged.sortWithinPartitions(*order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id()))
    return ordered.checkpoint(eager=True)


def _partition_offsets(ordered: DataFrame, value_cols: list[str]) -> DataFrame:
    """One row per partition with the totals of all earlier partitions."""
    aggs = [F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_first")]
    aggs += [F.sum(c).alias(f"_tot_{c}") for c in value_cols]
    stats = ordered.groupBy("_pid").agg(*aggs)
    # A window over the partition table: as many rows as partitions, no more.
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off")]
    cols += [F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}")
             for c in value_cols]
    return stats.select("_pid", "_first", *cols)


def with_row_index(df: DataFrame, order: list, index_col: str = "row_idx",
                   num_partitions: int | None = None, materialise_input: bool = False) -> DataFrame:
    """0-based position of every row in ``order`` (which must be unique).

    Never a ``row_number()`` over the whole table: see module docstring."""
    ordered = _range_sorted(df, order, num_partitions, materialise_input)
    offsets = _partition_offsets(ordered, [])
    return (ordered.join(F.broadcast(offsets), "_pid")
            .withColumn(index_col, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_first", "_off"))


def with_prefix_sums(df: DataFrame, order: list, value_cols: list[str], suffix: str = "_cum",
                     index_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Inclusive running totals of ``value_cols`` in ``order`` (unique) over the
    whole table, plus the row index when ``index_col`` is given."""
    ordered = _range_sorted(df, order, num_partitions)
    offsets = _partition_offsets(ordered, value_cols)
    # Running totals inside one range partition: the window's partition is one
    # range chunk, so its size is bounded by the range partitioning.
    within = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = ordered.join(F.broadcast(offsets), "_pid")
    out = out.select("*", *[(F.col(f"_off_{c}") + F.sum(c).over(within)).alias(f"{c}{suffix}")
                            for c in value_cols])
    if index_col:
        out = out.withColumn(index_col, F.col("_off") + F.col("_mid") - F.col("_first"))
    return out.drop("_pid", "_mid", "_first", "_off", *[f"_off_{c}" for c in value_cols])


def with_group_rank(df: DataFrame, keys: list[str], order: list, rank_col: str = "rank",
                    count_col: str | None = "group_rows", num_partitions: int | None = None,
                    tiebreak: bool = False) -> DataFrame:
    """0-based rank of each row inside its group, in ``order``, and the group
    size. A hot group is spread over many range partitions instead of landing
    in one task. ``order`` must be unique within a group unless ``tiebreak``
    is set: then tied rows (equal in every order column, so interchangeable
    for the output) are told apart by a hash of the whole row, which is the same
    after a recomputation; rows that are equal in every column follow each other."""
    order = list(order)
    if tiebreak:
        df = df.withColumn("_tb", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
        order.append(F.col("_tb"))
    idx = with_row_index(df, [F.col(k) for k in keys] + order, "_gidx", num_partitions)
    if tiebreak:
        idx = idx.drop("_tb")
    starts = idx.groupBy(*keys).agg(F.min("_gidx").alias("_gstart"), F.count(F.lit(1)).alias("_gn"))
    hot = hot_keys(starts, keys, "_gn")
    if count_col:
        starts = starts.withColumnRenamed("_gn", count_col)
    else:
        starts = starts.drop("_gn")
    # A salted join: a very large group's rows meet its start in many tasks.
    return (salted_join(idx, starts, keys, "inner", hot)
            .withColumn(rank_col, F.col("_gidx") - F.col("_gstart"))
            .drop("_gidx", "_gstart"))


# ---------------------------------------------------------------- F7

DIGITS = 4                       # hex digits looked at in a round: 65,536 counts at most


def nth_hash(keyed: DataFrame, rank, hash_col: str = "_hk", digits: int = DIGITS, length: int = 32) -> str | None:
    """Radix selection: the shortest prefix ``c`` such that exactly the rows with
    ``hash_col < c`` are the first ``rank(n)`` of the ``n`` rows in hash order; None if all
    are. Rows of one hash stay together, on the far side.

    A round counts rows by the next ``digits`` hex digits among those that share the prefix
    found so far, so it is one aggregate of at most 16**digits rows; two rounds tell
    billions of rows apart. One row reaches the driver."""
    prefix, want = "", None
    while True:
        here = keyed.filter(F.col(hash_col).startswith(prefix)) if prefix else keyed
        counts = here.groupBy(F.substring(hash_col, 1, len(prefix) + digits).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        # Windows over the table of counts: no more than 16**digits rows.
        upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.select("_p", "_c", F.sum("_c").over(upto).alias("_upto"),
                               F.sum("_c").over(Window.partitionBy()).alias("_n"))
        k = rank(F.col("_n")) if want is None else F.lit(want)
        hit = counts.withColumn("_k", k).filter((F.col("_upto") > F.col("_k")) & (F.col("_upto") - F.col("_c") <= F.col("_k"))).first()
        if hit is None:
            return None
        before, prefix, want = prefix, hit["_p"], hit["_k"] - (hit["_upto"] - hit["_c"])
        if want == 0 or len(prefix) >= length or len(prefix) == len(before):
            return prefix


def train_test_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     split_col: str = "split", index_col: str | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """the last ``ceil(test_size * n)`` rows of the seeded order are 'test', the rest 'train'
    (the reference splits without a second shuffle). ``key`` is unique; rows that
    share a key stay on one side.

    The cut-off hash is found by radix selection and a comparison marks the rows:
    the table is neither sorted nor written. ``index_col`` asks for the position in
    the seeded order as well, which takes a range shuffle; the cut-off is then found
    over the stored result."""
    keyed = df.withColumn("_hk", F.coalesce(hash_key(key, seed), F.lit("")))       # null keys come first
    if index_col:
        keyed = with_row_index(keyed, [F.col("_hk"), F.col(key)], index_col, num_partitions, materialise_input=True)
    cut = nth_hash(keyed, lambda n: n - F.ceil(n * F.lit(float(test_size))))
    train = F.lit(True) if cut is None else F.col("_hk") < F.lit(cut)
    return keyed.withColumn(split_col, F.when(train, "train").otherwise("test")).drop("_hk")
