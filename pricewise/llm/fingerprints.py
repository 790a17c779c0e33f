"""Operator 8: document fingerprints as bottom-k sketches of shingle hashes.

A document's fingerprint holds the ``K`` smallest 64-bit hashes of its distinct
five-word shingles, ascending. Sketches of parts merge into the sketch of their
union (keep the ``K`` smallest of all), and from two sketches follow estimates of
resemblance, containment and distinct shingle counts; with fewer than ``K``
shingles all of them are exact. Texts with the same shingle set have the same
fingerprint.

``with_next`` pairs every document with the next one in descending ``doc_id``
order without a global sort in one task: ids alone are range-partitioned to get
the bounds of buckets, texts are dealt to buckets once, and the first document
of each bucket is copied to the bucket before it, so that neighbours always meet.

Defined cases: a null text is empty; a text with 1 to 4 words has one shingle, one
without words none; two empty sketches have likeness 1, an empty and another 0;
null ids come last; rows with the same id follow each other by text; repeated
rows are each paired with the row after them; a single row is its own next; an
empty table gives no rows; other columns are ignored.

Scale: the texts are shuffled once, compressed. Buckets hold about
``BUCKET_DOCS`` documents; a bucket streams through its task in slices.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shingles, stored, utf8, words

K = 128
BUCKET_DOCS = 2_000
SLICE = 4 << 20                  # bytes of text handled at a time


# ---------------------------------------------------------------- sketches

def sketches(texts: list[str], k: int = K) -> list[np.ndarray]:
    """Bottom-k sketch (ascending uint64) of every text."""
    w, _, _, woff = words(*utf8(pa.array(texts, pa.large_string())))
    sh, off = shingles(w, woff)
    return [np.unique(sh[a:b])[:k] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def merge_two(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    same = both[1:] == both[:-1]
    if len(a) < k and len(b) < k:
        m = int(same.sum())
        return m / (len(both) - m)
    # the k smallest of the union, and how many of them are in both
    first = np.concatenate([[True], ~same])
    rank = np.cumsum(first)
    size = min(k, int(rank[-1]))
    return float((same & (rank[1:] <= size)).sum()) / size


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles behind a sketch."""
    return float(len(a)) if len(a) < k else (k - 1) / (float(a[k - 1]) / 2.0 ** 64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A|."""
    if len(a) == 0:
        return 1.0
    j = resemblance(a, b, k)
    na, nb = distinct_count(a, k), distinct_count(b, k)
    return min(1.0, j / (1.0 + j) * (na + nb) / na)


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``id_col, fingerprint, n_shingles`` (estimated) of every row; a plain map."""
    def run(batches):
        for batch in batches:
            sk = sketches(batch.column(1).to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([to_text(s) for s in sk], pa.string()),
                 pa.array([distinct_count(s, k) for s in sk], pa.float64())],
                names=["_id", "fingerprint", "n_shingles"])
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, fingerprint string, n_shingles double").withColumnRenamed("_id", id_col)


def merge(prints: DataFrame, by: str, k: int = K) -> DataFrame:
    """``by, fingerprint``: the sketch of all documents of each group. Sketches are
    merged within input partitions first, so a group that holds most rows
    reaches the second step as one sketch per partition."""
    kind = prints.schema[by].dataType.simpleString()
    schema = f"_by {kind}, fingerprint string"

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for key, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = from_text(s or "")
                held[key] = merge_two(held[key], a, k) if key in held else a
                if len(held) >= 100_000:
                    yield _merged(held, batch.schema)
                    held = {}
        if held:
            yield _merged(held, batch.schema)

    def _merged(held, out_schema):
        return pa.RecordBatch.from_arrays([pa.array(list(held), out_schema.field(0).type),
                                           pa.array([to_text(a) for a in held.values()], pa.string())],
                                          names=["_by", "fingerprint"])

    def final(batches):
        current, key, seen = None, None, False
        for batch in batches:
            keys, values = [], []
            for g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if seen and g == key:
                    current = merge_two(current, from_text(s), k)
                    continue
                if seen:
                    keys.append(key)
                    values.append(to_text(current))
                current, key, seen = from_text(s), g, True
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type),
                                              pa.array(values, pa.string())], names=["_by", "fingerprint"])
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([key], batch.schema.field(0).type),
                                              pa.array([to_text(current)], pa.string())],
                                             names=["_by", "fingerprint"])
    part = prints.select(F.col(by).alias("_by"), "fingerprint").mapInArrow(partial, schema)
    return (part.repartition("_by").sortWithinPartitions("_by").mapInArrow(final, schema)
            .withColumnRenamed("_by", by))


# ---------------------------------------------------------------- neighbours

def with_next(docs: DataFrame, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Texts dealt to buckets of neighbouring ids: ``_bucket, _copy, _no_id, _id,
    _text`` (zstd), sorted within partitions by bucket, originals before the
    copy, descending id. The row after an original is its next document."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                      F.col("doc_id").isNull().alias("_no_id"))
    n = ids.count()
    buckets = max(1, -(-n // bucket_docs))
    ranged = ids.filter(~F.col("_no_id")).repartitionByRange(buckets, "_id")
    bounds = stored(ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("_id").alias("lo"),
                                                                          F.max("_id").alias("hi")))
    # One row per bucket: two longs for some thousands of documents.
    edges = sorted((r["lo"], r["hi"]) for r in bounds.collect())
    lows, highs = [e[0] for e in edges], [e[1] for e in edges]
    schema = "_bucket long, _copy boolean, _no_id boolean, _id long, _text binary"

    def deal(batches):
        import zstandard
        pack = zstandard.ZstdCompressor(level=1).compress
        low, high = np.array(lows, np.int64), np.array(highs, np.int64)
        for batch in batches:
            no_id = batch.column(1).to_numpy(zero_copy_only=False)
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            # Null ids make bucket -1, below all others.
            bucket = np.where(no_id, -1, np.maximum(np.searchsorted(low, doc, "right") - 1, 0) if len(low) else -1)
            text = pa.array([pack(t) for t in batch.column(2).cast(pa.large_binary()).to_pylist()], pa.binary())
            out = [pa.array(bucket, pa.int64()), pa.array(np.zeros(len(doc), bool)), batch.column(1), batch.column(0), text]
            yield pa.RecordBatch.from_arrays(out, names=["_bucket", "_copy", "_no_id", "_id", "_text"])
            # The first document of a bucket also goes to the bucket above it;
            # the very first one goes to the lowest bucket.
            if len(high):
                at = np.flatnonzero(~no_id & (doc == high[np.maximum(bucket, 0)]))
                to = bucket[at] + 1
                lowest = -1 if has_null else 0
                to[to == len(high)] = lowest
            else:
                at, to = np.arange(len(doc)), np.full(len(doc), -1)
            if has_null and len(high):           # null ids follow the lowest id: they go to bucket 0
                more = np.flatnonzero(no_id)
                at, to = np.concatenate([at, more]), np.concatenate([to, np.zeros(len(more), np.int64)])
            if len(at):
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to, pa.int64()), pa.array(np.ones(len(at), bool)), batch.column(1).take(take),
                     batch.column(0).take(take), text.take(take)],
                    names=["_bucket", "_copy", "_no_id", "_id", "_text"])
    has_null = bool(ids.filter("_no_id").limit(1).count())
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"),
                      F.col("doc_id").isNull().alias("_no_id"), F.coalesce("text", F.lit("")).alias("_text"))
    return (src.mapInArrow(deal, schema).repartition(buckets, "_bucket")
            .sortWithinPartitions("_bucket", "_copy", "_no_id", F.desc("_id"), "_text"))


def edited_text(text: str, following: str) -> str:
    m = len(text) // 3
    return text[:len(text) - m] + following[:m]


def compare_with_next(docs: DataFrame, k: int = K, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """For every document: its fingerprint, that of its edited text (the last third
    replaced by the beginning of the next document), and likenesses."""
    schema = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double, n_shingles double")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "n_shingles"]

    def emit(rows):
        """Results of all rows but the last, which is only somebody's next."""
        texts = [r[3] for r in rows]
        own = sketches(texts, k)
        at = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        edited = [edited_text(texts[i], texts[i + 1]) for i in at]
        changed = sketches(edited, k)
        cols = [[rows[i][2] for i in at], [len(texts[i]) for i in at],
                [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                [to_text(own[i]) for i in at], [to_text(s) for s in changed],
                [resemblance(own[i], s, k) for i, s in zip(at, changed)],
                [resemblance(own[i], own[i + 1], k) for i in at], [distinct_count(own[i], k) for i in at]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        rows, held = [], 0
        for batch in batches:
            for b, copy, no_id, i, z in zip(*[c.to_pylist() for c in batch.columns]):
                text = unpack(z).decode()
                rows.append((b, copy, None if no_id else i, text))
                held += len(text)
                if held > SLICE:
                    yield emit(rows)
                    rows, held = rows[-1:], len(text)
        if rows:
            yield emit(rows)
    return with_next(docs, bucket_docs).mapInArrow(run, schema)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: fingerprints of documents and of their edited texts."""
    return compare_with_next(read_table(spark, sf_dir, "documents"))
