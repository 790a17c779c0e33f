"""Operator 9: mixing sources to target weights along a time-varying curriculum.

Targets. Sources in code point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
and share the words of the whole corpus; a target stops at ``CAP`` times its
source's size and the excess is shared again by weight until none is above.

Curriculum. Over training time t in [0, 1] a source delivers words at the rate
``target * (1 + s * (2t - 1))``; the slope s depends on its weight class, so
high-weight sources lead and low-weight ones gather at the end. The integral of
the rate up to t is the cumulative demand ``target * ((1 - s) t + s t**2)``. A
source's documents stand in a seeded hash order, over and over; the copy that
begins ``c`` words into that sequence is due when the demand reaches ``c``, so its
position is the inverse of the demand at ``c``. ``sequence`` range-sorts copies by
position; the query counts the words of every document in that sequence.

A source of ``n`` words with target ``m`` gives ``floor(m / n)`` whole passes and
one partial pass. The document on the end of the partial pass gives only its
first words (``cut=True``), so every source's words equal its target to within
one; with ``cut=False`` copies stay whole and the last is taken if its middle is
inside the target.

Defined cases: a null text has size 0; null sources are one source, ordered last;
documents of size 0 take nothing; repeated rows (also of one ``doc_id``) count as
often as they come and follow each other in the order; an empty table gives no
rows; other columns are ignored by ``plan``. Reruns agree: the order is an md5 of
``doc_id`` (without one: of a hash of the text) and a seed, ties by id, size and text hash;
texts of any length are read whole.

Scale: texts are read for sizes and again for the sequence. The running totals inside a source come
from totals of hash buckets (about ``BUCKET_ROWS`` rows each, also in a source
that holds most rows), so no source is handled in one task. Only one-row totals
reach the driver.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.rows import with_row_index
from .common import read_table, slices, stored

WEIGHTS = (5, 2, 1)
SLOPES = (-0.5, 0.0, 0.5)        # by weight class: falling, level, rising rate
CAP = 3
SEED = 42
BUCKET_ROWS = 2_000
SLICE = 8 << 20                  # bytes of text unpacked at a time
WORD = r"[^\x20\x09-\x0D]+"


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").isNull().alias("_no_source"),
                       F.coalesce("source", F.lit("")).alias("_source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                       F.xxhash64("text").alias("_hash"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """``_no_source, _source, source_size, _class, target``: one row per source."""
    per = sizes.groupBy("_no_source", "_source").agg(F.sum("size").alias("source_size"))
    idx = with_row_index(per, [F.col("_no_source"), F.col("_source")], "_idx")
    k = len(weights)
    cls = (F.col("_idx") % k).cast("int")
    table = stored(idx.select("_no_source", "_source", "source_size", cls.alias("_class"),
                              F.get(F.array(*[F.lit(float(w)) for w in weights]), cls).alias("_w"),
                              (F.col("source_size") * cap).cast("double").alias("_cap")))
    # Each round caps every source whose share passes its cap; shares only grow.
    level, n_capped = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("_cap") <= F.col("_w") * level
        r = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"),
                      F.coalesce(F.sum(F.when(capped, F.col("_cap"))), F.lit(0.0)).alias("used"),
                      F.coalesce(F.sum(F.when(~capped, F.col("_w"))), F.lit(0.0)).alias("w"),
                      F.count(F.when(capped, 1)).alias("n")).first()
        if r["w"] == 0 or r["n"] == n_capped:
            break
        level, n_capped = (r["total"] - r["used"]) / r["w"], r["n"]
    share = F.lit(0.0) if level is None else F.col("_w") * level
    return table.select("_no_source", "_source", "source_size", "_class",
                        F.least("_cap", share).alias("target"))


def plan(sizes: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, rows: DataFrame | None = None) -> DataFrame:
    """Adds to every row of ``_sized`` documents: ``source_size, target, _class,
    _start`` (words of the source before it in one pass). ``rows`` are the same documents
    with more columns, which are kept."""
    n = sizes.count()
    buckets = 16
    while buckets * BUCKET_ROWS < n:
        buckets *= 2
    # Rows without an id are told apart by their text, so they spread over the buckets as well.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("_hash").cast("string")))
    key = F.md5(F.concat(name, F.lit(f"-{seed}")))
    bucket = F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32))
    src = ["_no_source", "_source"]
    before = Window.partitionBy(*src).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (sizes.withColumn("_key", key).groupBy(*src, bucket.cast("long").alias("_bucket")).agg(F.sum("size").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    offsets = stored(offsets.join(source_targets(sizes, weights, cap), src))
    rows = (sizes if rows is None else rows).withColumn("_key", key).withColumn("_bucket", bucket.cast("long"))
    inside = (Window.partitionBy(*src, "_bucket").orderBy("_key", "doc_id", "size", "_hash")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (rows.withColumn("_upto", F.sum("size").over(inside))
            .join(offsets, [*src, "_bucket"])
            .withColumn("_start", F.col("_before") + F.col("_upto") - F.col("size"))
            .drop("_key", "_bucket", "_before", "_upto"))


def position(words_before, target, cls, slopes=SLOPES):
    """Training time at which a source's demand reaches ``words_before``."""
    s = F.get(F.array(*[F.lit(float(x)) for x in slopes]), cls)
    y = F.least(words_before / target, F.lit(1.0))
    root = (F.sqrt((1 - s) * (1 - s) + 4 * s * y) - (1 - s)) / (2 * s)
    return F.when(s == 0, y).otherwise(root)


def with_taken(planned: DataFrame, cut: bool = True, cap: int = CAP) -> DataFrame:
    """Adds ``_copies``: array of (copy, words, position) of every document."""
    goal = F.floor(F.col("target") + 0.5).cast("long")

    def one(e):
        begin = F.col("_start") + F.lit(e) * F.col("source_size")
        left = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_goal") - begin))
        if not cut:
            left = F.when(begin * 2 + F.col("size") <= F.col("_goal") * 2, F.col("size")).otherwise(F.lit(0))
        return F.struct(F.lit(e).alias("copy"), left.cast("long").alias("words"),
                        F.when(left > 0, position(begin, F.col("target"), F.col("_class"))).alias("position"))
    copies = F.array(*[one(e) for e in range(cap)])
    return planned.withColumn("_goal", goal).withColumn("_copies", F.filter(copies, lambda x: x["words"] > 0))


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` as zstandard bytes: what the shuffles of ``sequence`` move."""
    at = docs.columns.index("text")
    kinds = [f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema]

    def run(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column(at).cast(pa.large_binary()).to_pylist()
                z = pa.array([None if t is None else pack(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], z, *part.columns[at + 1:]], names=part.schema.names)
    return docs.mapInArrow(run, ", ".join(kinds))


def _head(text: bytes, n: int) -> bytes:
    """The text up to the end of its ``n``-th word."""
    for k, m in enumerate(re.finditer(WORD.encode(), text), 1):
        if k == n:
            return text[:m.end()]
    return text


def _unpacked(rows: DataFrame) -> DataFrame:
    """``rows`` with their texts again; ``_m_cut`` is the number of words kept (null: all)."""
    at, cut_at = rows.columns.index("text"), rows.columns.index("_m_cut")
    kinds = [f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in rows.schema]

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            z, cuts, size = batch.column(at).to_pylist(), batch.column(cut_at).to_pylist(), 0
            a = 0
            for b in range(len(z)):          # slices of some MB of text
                z[b] = None if z[b] is None else unpack(z[b])
                if cuts[b] is not None:
                    z[b] = _head(z[b], cuts[b])
                size += len(z[b] or b"")
                if size >= SLICE or b == len(z) - 1:
                    part = batch.slice(a, b + 1 - a)
                    text = pa.array(z[a: b + 1], pa.large_binary()).cast(pa.large_string()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*part.columns[:at], text, *part.columns[at + 1:]],
                                                     names=part.schema.names)
                    z[a: b + 1] = [None] * (b + 1 - a)
                    a, size = b + 1, 0
    return rows.mapInArrow(run, ", ".join(kinds))


def sequence(docs: DataFrame, sizes: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED,
             cut: bool = True) -> DataFrame:
    """The training sequence: the rows of ``docs``, one per copy, range-sorted by position, a
    cut copy with its first words only. Behind the columns of ``docs``: ``_m_no_source,
    _m_source, _m_start`` (which tell rows with words apart), ``_m_position, _m_cut``.
    ``sizes``: ``_sized`` of ``docs``, stored. Texts cross two shuffles (to their place in the
    source, and to their positions) compressed."""
    cols = docs.columns
    packed = _packed(docs.withColumns({
        "_m_size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "_m_hash": F.xxhash64("text")}))
    rows = packed.select("doc_id", F.col("source").isNull().alias("_no_source"), F.coalesce("source", F.lit("")).alias("_source"),
                         F.col("_m_size").alias("size"), F.col("_m_hash").alias("_hash"),
                         F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_row"))
    chosen = with_taken(plan(sizes, weights, cap, seed, rows), cut=cut, cap=cap)
    out = chosen.select("_row", "doc_id", "size", "_no_source", "_source", "_start", F.explode("_copies").alias("_c"))
    out = out.select("_row", F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("_no_source").alias("_m_no_source"),
                     F.col("_source").alias("_m_source"), F.col("_start").alias("_m_start"),
                     F.col("_c.position").alias("_m_position"),
                     F.when(F.col("_c.words") < F.col("size"), F.col("_c.words")).alias("_m_cut"))
    out = out.repartitionByRange("_m_position", "_id").sortWithinPartitions("_m_position", "_id")
    return _unpacked(out.select("_row.*", "_m_no_source", "_m_source", "_m_start", "_m_position", "_m_cut"))


def mixture(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The training sequence of whole copies, with the columns of ``docs``."""
    out = sequence(docs, stored(_sized(docs)), weights, cap, seed, cut=False)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: words of every document in the training sequence, counted in the texts
    that stand there, and its source's target; ``position`` is the training time of its
    first copy (null: not taken)."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = stored(_sized(docs))
    # Rows with words have different starts; rows without any meet nothing.
    place = F.when(F.col("size") > 0, F.col("_start")).otherwise(-1 - F.monotonically_increasing_id())
    planned = plan(sizes).select("doc_id", "size", "source_size", "target", F.col("_no_source").alias("_m_no_source"),
                                 F.col("_source").alias("_m_source"), place.alias("_m_start"))
    key = ["_m_no_source", "_m_source", "_m_start"]
    there = sequence(docs, sizes).groupBy(*key).agg(
        F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("taken"), F.min("_m_position").alias("position"))
    return planned.join(there, key, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "position")


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i
    FROM d GROUP BY source
), c AS (
    SELECT source, source_size, i % 3 AS cls, [5.0, 2.0, 1.0][i % 3 + 1]::DOUBLE AS w,
           3.0::DOUBLE * source_size AS cap FROM s
), o AS (   -- by the level at which a source reaches its cap
    SELECT *, coalesce(sum(cap) OVER p, 0) AS used, (SELECT sum(w) FROM c) - coalesce(sum(w) OVER p, 0) AS rest
    FROM c WINDOW p AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (   -- the first source below its cap sets the level
    SELECT ((SELECT sum(source_size) FROM c) - used) / rest AS level FROM o
    WHERE ((SELECT sum(source_size) FROM c) - used) / rest * w < cap ORDER BY cap / w LIMIT 1
), t AS (
    SELECT source, source_size, cls, least(cap, w * coalesce((SELECT level FROM l), 1e300)) AS target FROM c
), r AS (
    SELECT d.doc_id, d.size, t.source_size, t.cls, t.target, floor(t.target + 0.5)::BIGINT AS goal,
           sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR || '-42'), d.doc_id, d.size
                             ROWS UNBOUNDED PRECEDING) - d.size AS start
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
    SELECT *, greatest(0, least(size, goal - start)) AS k0, greatest(0, least(size, goal - start - source_size)) AS k1,
           greatest(0, least(size, goal - start - 2 * source_size)) AS k2, least(start / target, 1.0) AS y,
           [-0.5, 0.0, 0.5][cls + 1]::DOUBLE AS sl FROM r
)
SELECT doc_id, size, source_size, target, (k0 + k1 + k2)::BIGINT AS taken,
       CASE WHEN k0 = 0 THEN NULL WHEN sl = 0 THEN y
            ELSE (sqrt((1 - sl) * (1 - sl) + 4 * sl * y) - (1 - sl)) / (2 * sl) END AS position
FROM k
"""
