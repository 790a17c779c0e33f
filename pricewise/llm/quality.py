"""Operator 3: quality classifier by co-training of two views.

Content view, from the whole text alone: frequencies (square roots) of hashed byte
3-grams, and layout (size, lines, words, shares of upper case, digits, punctuation and
space). Metadata view, without the text: language, source (both hashed as whole strings)
and the recorded length. Each view has a logistic
classifier. In every round each classifier, trained on the labelled sample and on
what the other has handed over, labels the unlabelled documents it is surest of
(at least ``SURE``, at most ``PER_ROUND`` of each class) and hands them to the
other. After the rounds both are calibrated, and the calibrated views combined,
by a logistic fit on labelled documents that neither has been trained on.

Labels come only from documents outside the held-out fold (crc32 of the id modulo
4 is 2): a sample of at most ``N_LABELLED`` documents of each class, with
``N_POOL`` unlabelled ones (smallest hashes of ``doc_id`` first). Every document
is scored over its whole text.

Defined cases: null text, language, source and length are empty, a class of their
own, a class of their own, and 0; an empty text has zero content features; a text of any
length is read whole; a row with a null id is scored, never learnt from, and not held out;
repeated rows are scored each; equal confidences go by the order of the sample's hashes; a document labelled both ways counts as good;
without labels of both classes every score is the smoothed share of good labels
(nothing is learnt, and nothing rejected); an empty table gives no rows.

Scale: two small sampling jobs, then one map over the table without a shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, utf8
from .toxicity import fit_logistic, held_out

N_LABELLED, N_POOL = 3_000, 6_000
ROUNDS, PER_ROUND, SURE = 4, 300, 0.95
CONTENT, SOURCES = 256, 16       # hashed dimensions
LANGS = 8
LAYOUT = 10                      # byte class shares, size, line and word lengths
THRESHOLD = 0.4                  # rejected below this probability of good quality
_IDS = ["doc_id", "text", "lang", "source", "n_chars"]


# ---------------------------------------------------------------- features

def content_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, CONTENT): square roots of hashed byte 3-gram frequencies."""
    n = len(off) - 1
    if len(data) < 3:
        return np.zeros((n, CONTENT), np.float32)
    a = data.astype(np.uint32)
    h = ((a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D))
         * np.uint32(0x27D4EB2F)) >> np.uint32(24)
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    inside = np.arange(len(data)) < np.repeat(off[1:] - 2, size)         # no gram across two texts
    key = doc[:-2] * CONTENT + h
    count = np.bincount(key[inside[:-2]], minlength=n * CONTENT).reshape(n, CONTENT)
    return np.sqrt(count / np.maximum(size - 2, 1)[:, None]).astype(np.float32)


def _kinds() -> np.ndarray:
    """Byte classes: upper, lower, digit, punctuation, space, line feed, other."""
    k = np.full(256, 6)
    k[33:127] = 3
    k[65:91], k[97:123], k[48:58] = 0, 1, 2
    k[[9, 11, 12, 13, 32]] = 4
    k[10] = 5
    return k


_KIND = _kinds()


def _bucket(column: pa.Array, n: int) -> np.ndarray:
    """One-hot of a hash of the whole strings of a column; nulls are a class of their own."""
    values = column.to_pylist()
    names = {v: n if v is None else int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") % n
             for v in set(values)}
    out = np.zeros((len(values), n + 1), np.float32)
    out[np.arange(len(values)), [names[v] for v in values]] = 1
    return out


def layout_features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of the byte classes, size, and lengths of lines and words of each text."""
    n, size = len(off) - 1, np.diff(off)
    kind = np.bincount(np.repeat(np.arange(n), size) * 7 + _KIND[data], minlength=n * 7).reshape(n, 7)
    share = kind / np.maximum(size, 1)[:, None]
    lines, gaps = kind[:, 5] + 1, kind[:, 4] + kind[:, 5] + 1
    return np.column_stack([share, np.log1p(size), np.log1p(size / lines), np.log1p(size / gaps)]).astype(np.float32)


def metadata_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """What is known of a page without its text."""
    chars = pc.fill_null(n_chars.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    size = np.log1p(np.maximum(chars, 0))
    return np.column_stack([size, size * size, _bucket(lang, LANGS), _bucket(source, SOURCES)]).astype(np.float32)


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = lambda c: batch.column(batch.schema.get_field_index(c))        # noqa: E731
    data, off = utf8(col("text"))
    content = np.column_stack([content_features(data, off), layout_features(data, off)])
    return content, metadata_features(col("lang"), col("source"), col("n_chars"))


def _sampled_views(docs: DataFrame, picked: DataFrame) -> list[tuple]:
    """Sorted (key, label or -1, content, metadata) of the sampled documents, one row
    (of the smallest hash) an id."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                a, b = _views(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("_k")), part.column(part.schema.get_field_index("_y")),
                     pa.array([r.tobytes() for r in a], pa.binary()), pa.array([r.tobytes() for r in b], pa.binary())],
                    names=["_k", "_y", "a", "b"])
    rows = docs.select(*_IDS).join(F.broadcast(picked), "doc_id") \
        .withColumn("_h", F.xxhash64(*[F.col(c) for c in _IDS if c != "doc_id"]))
    least = rows.groupBy("_k").agg(F.min("_h").alias("_h"))
    rows = (rows.join(F.broadcast(least), ["_k", "_h"]).dropDuplicates(["_k"])
            .mapInArrow(run, "_k long, _y int, a binary, b binary")
            .collect())                      # as many rows as the sample bounds allow
    return sorted((r["_k"], r["_y"], bytes(r["a"]), bytes(r["b"])) for r in rows)


# ---------------------------------------------------------------- training

def _p(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS,
             per_round: int = PER_ROUND, sure: float = SURE) -> list[tuple]:
    """A logistic model for each of two views; ``views`` and ``pool`` hold one matrix
    a view, of the labelled and of the unlabelled documents."""
    handed = [(np.zeros(0, np.int64), np.zeros(0)) for _ in views]        # what each view was given
    free = np.ones(len(pool[0]), bool)
    models = []
    for r in range(rounds + 1):
        models = [fit_logistic(np.concatenate([v, u[idx]]), np.concatenate([y, lab]), ridge=5.0, steps=8)
                  for v, u, (idx, lab) in zip(views, pool, handed)]
        if r == rounds or not free.any():
            break
        for k in (0, 1):
            p = _p(models[k], pool[k]) if len(pool[k]) else np.zeros(0)
            for label, conf in ((1.0, p), (0.0, 1 - p)):
                best = np.flatnonzero(free & (conf >= sure))
                best = best[np.argsort(-conf[best], kind="stable")][:per_round]
                free[best] = False
                idx, lab = handed[1 - k]
                handed[1 - k] = np.concatenate([idx, best]), np.concatenate([lab, np.full(len(best), label)])
    return models


def train(docs: DataFrame, labels: DataFrame) -> dict:
    lab = (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
           .groupBy("doc_id").agg(F.max("quality").cast("int").alias("_y")))
    key = F.xxhash64("doc_id", F.lit(3))
    share = lab.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("g"), F.count(F.lit(1)).alias("n")).first()
    prior = (share["g"] + 1) / (share["n"] + 2)
    good, bad = (lab.filter(F.col("_y") == y).withColumn("_k", key).orderBy("_k").limit(N_LABELLED) for y in (1, 0))
    pool = (docs.select("doc_id").filter("doc_id IS NOT NULL").join(labels.select("doc_id"), "doc_id", "left_anti")
            .distinct().withColumn("_y", F.lit(-1)).withColumn("_k", key).orderBy("_k").limit(N_POOL))
    rows = _sampled_views(docs, good.unionByName(bad).unionByName(pool))
    known = [r for r in rows if r[1] >= 0]
    if len({r[1] for r in known}) < 2:
        return {"prior": prior}
    matrix = lambda rs, c: np.array([np.frombuffer(r[c], np.float32) for r in rs], np.float32)
    # Two thirds of the labelled sample train the views, the rest calibrate them.
    fit, cal = [r for r in known if r[0] % 3], [r for r in known if r[0] % 3 == 0]
    if len({r[1] for r in fit}) < 2 or len({r[1] for r in cal}) < 2:
        fit = cal = known
    unlabelled = [r for r in rows if r[1] < 0]
    pools = [matrix(unlabelled, c).reshape(len(unlabelled), -1 if unlabelled else matrix(fit, c).shape[1]) for c in (2, 3)]
    models = co_train([matrix(fit, 2), matrix(fit, 3)], np.array([float(r[1]) for r in fit]), pools)
    y = np.array([float(r[1]) for r in cal])
    z = np.column_stack([_logit(_p(m, matrix(cal, c))) for m, c in zip(models, (2, 3))])
    calibrations = [fit_logistic(z[:, [k]], y) for k in (0, 1)]
    both = fit_logistic(np.column_stack([_logit(_p(c, z[:, [k]])) for k, c in enumerate(calibrations)]), y)
    shift = np.log(prior / (1 - prior)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for m in (*calibrations, both):          # the sample has its own share of good documents
        m[2][-1] += shift
    return {"prior": prior, "views": models, "calibrations": calibrations, "both": both,
            "unshift": shift}


def predict(model: dict, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(content score, metadata score, combined score): probabilities of good quality."""
    if "views" not in model:
        p = np.full(batch.num_rows, model["prior"])
        return p, p, p
    views = _views(batch)
    each = [_p(c, _logit(_p(m, v))[:, None]) for m, c, v in zip(model["views"], model["calibrations"], views)]
    z = np.column_stack([_logit(e) - model["unshift"] for e in each])
    return each[0], each[1], _p(model["both"], z)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``content_score, metadata_score, quality_score`` added."""
    new = ["content_score", "metadata_score", "quality_score"]
    keep = [c for c in docs.columns if c not in new]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(p, pa.float64()) for p in predict(model, part)]],
                                                 names=[*keep, *new])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema + "".join(f", {c} double" for c in new))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of ``docs`` that the classifier doesn't reject."""
    cols = docs.columns
    model = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    if "views" not in model:
        return docs
    return score(docs, model).filter(F.col("quality_score") >= THRESHOLD).select(*[F.col(f"`{c}`") for c in cols])


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; ``kept`` is false for rejected ones."""
    docs = read_table(spark, sf_dir, "documents").select(*_IDS)
    model = train(docs, read_table(spark, sf_dir, "labels"))
    out = score(docs, model)
    kept = F.col("quality_score") >= THRESHOLD if "views" in model else F.lit(True)
    return out.select("doc_id", held_out().alias("held_out"), "content_score", "metadata_score",
                      F.col("quality_score").alias("score"), kept.alias("kept"))
