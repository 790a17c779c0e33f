"""Operator 4: toxicity by compression distance.

Two zstandard dictionaries, one for ordinary and one for toxic text, compress
every window of a text; a window whose compressed length is smaller with the
toxic dictionary holds toxic passages. Differences of all windows give the
features of a document (bytes saved a kilobyte, the best window, shares of
windows beyond thresholds), and a logistic calibration on labelled documents
that these dictionaries have not seen turns them into a score from 0 to 1.

Dictionaries. Both hold the same ordinary base, segments chosen from all ordinary
training texts to cover the byte 5-grams that most of them share, so that ordinary
windows compress alike; the toxic one also holds the byte runs that toxic training documents use
far more often than ordinary ones (by a z-score of document frequencies of byte
5-grams), most common first. Near copies among the training documents count
once, else a much-copied document would look like a pattern.

Labels are learnt only from documents outside the held-out fold, from a sample
of at most ``N_TOXIC`` toxic and ``N_ORDINARY`` ordinary documents and
``SAMPLE_BYTES`` of text, half of them for each label (smallest hashes of doc_id
first; texts over ``LONG_BYTES`` after all others, and a text that no longer fits
is passed over; of rows that repeat an id, the text of the smallest hash; for
training only); calibration is cross-fitted, each half of it
measured with dictionaries of the other half. A score depends on the text alone.

Defined cases: a null text is empty; an empty text has no windows and scores as
a text without any toxic passage; texts of any length are read whole; equal texts
score alike; repeated rows are scored each; a row with a null id is scored, never learnt from, and
not held out; a document labelled both ways counts as toxic; without labels of both kinds the score is the smoothed share of toxic
labels, no row is predicted toxic and the pipeline's stage keeps all; an empty table gives no rows; other columns are ignored.

Scale: one small sampling job, then one map over the table without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, read_table, slices, utf8

N_TOXIC, N_ORDINARY, SAMPLE_BYTES = 2_000, 4_000, 24 << 20
LONG_BYTES = 192 << 10           # a text that others of its label go before
WINDOW = 256                     # bytes
GRAM = 5                         # bytes of a pattern
BASE_BYTES, TOXIC_BYTES = 2_048, 32 << 10
SEGMENT = 64                     # bytes of ordinary text taken at a time
Z_MAX, TIMES_MIN = 8.0, 5.0      # a pattern's z-score (less if there are few texts) and frequency ratio
THRESHOLD = 0.3                  # predicted toxic from this score on
STEPS = (1, 2, 3, 4, 6)          # bytes saved in a window

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def held_out(id_col: str = "doc_id"):
    """Whether an id is in the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- training

def _grams(doc: bytes, n: int) -> np.ndarray:
    a = np.frombuffer(doc, np.uint8).astype(np.uint64)
    if len(a) < n:
        return np.zeros(0, np.uint64)
    g = np.zeros(len(a) - n + 1, np.uint64)
    for j in range(n):
        g = (g << np.uint64(8)) | a[j: j + len(g)]
    return g


def _without_copies(docs: list[bytes]) -> list[bytes]:
    """Leaves out documents that share one of four min-hashes with an earlier one."""
    seen, out = set(), []
    for d in docs:
        g = _grams(d, 8)
        if len(g):
            keys = {(i, int(mix64(g ^ np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)).min())) for i in range(4)}
            if not keys & seen:
                out.append(d)
            seen |= keys
    return out


def _frequencies(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not docs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.unique(_grams(d, GRAM)) for d in docs]), return_counts=True)


def _covering(docs: list[bytes], grams: np.ndarray, counts: np.ndarray) -> bytes:
    """``BASE_BYTES`` that cover the patterns most texts share: all texts are dealt into as
    many parts as there are segments, and each part gives the segment of ``SEGMENT`` bytes
    with the most texts behind its patterns, those covered already counting nothing."""
    weight = counts.astype(float)
    n = BASE_BYTES // SEGMENT
    out = []
    for part in range(n):
        best, found, where = 0.0, None, None
        for d in docs[part::n]:
            g = _grams(d, GRAM)
            if len(g) < SEGMENT - GRAM + 1:
                continue
            at = np.searchsorted(grams, g)
            total = np.concatenate([[0], np.cumsum(weight[at])])
            sums = total[SEGMENT - GRAM + 1:] - total[:-(SEGMENT - GRAM + 1)]
            i = int(sums.argmax())
            if sums[i] > best:
                best, found, where = float(sums[i]), d[i: i + SEGMENT], at[i: i + SEGMENT - GRAM + 1]
        if found is not None:
            out.append((best, found))
            weight[where] = 0.0
    # The segment that stands for most texts comes last, nearest to the window.
    return b"".join(f for _, f in sorted(out)) or b"        "


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """Contents of the (ordinary, toxic) dictionary from lower-cased training texts."""
    toxic, ordinary = _without_copies(toxic), _without_copies(ordinary)
    gt, ct = _frequencies(toxic)
    go, co = _frequencies(ordinary)
    base = _covering(ordinary, go, co)
    if not len(gt) or not len(go):
        return base, base
    at = np.searchsorted(go, gt).clip(max=len(go) - 1)
    expected = (np.where(go[at] == gt, co[at], 0) + 0.5) / len(ordinary) * len(toxic)
    z_min = min(Z_MAX, max(3.0, 0.8 * len(toxic) ** 0.5))
    marked = gt[((ct - expected) / np.sqrt(expected + 1) >= z_min) & (ct >= TIMES_MIN * expected)]
    runs: dict[bytes, int] = {}
    for d in toxic:
        g = _grams(d, GRAM)
        if not len(g) or not len(marked):
            continue
        hit = marked[np.searchsorted(marked, g).clip(max=len(marked) - 1)] == g
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        for run in {d[a: b + GRAM - 1] for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))}:
            runs[run] = runs.get(run, 0) + 1
    text, covered = b"", set()
    for run, n in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        own = set(_grams(run, GRAM).tolist())
        if n < 2:
            break
        if len(text) + len(run) <= TOXIC_BYTES and 2 * len(own - covered) >= len(own):       # mostly new
            text = run + text
            covered |= own
    return base, text + base


class Distance:
    """Windows' compressed lengths under both dictionaries, and features of texts."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        import zstandard as z
        params = z.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=3, min_match=3,
                                             target_length=64, strategy=z.STRATEGY_BTULTRA, write_content_size=0,
                                             write_checksum=0, write_dict_id=0)
        self._ordinary, self._toxic = (
            z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT),
                             compression_params=params).compress for d in (ordinary, toxic))

    def features(self, text: bytes) -> list[float]:
        text = text.translate(_LOWER)
        a, b = self._ordinary, self._toxic
        parts = [text[i: i + WINDOW] for i in range(0, len(text), WINDOW)]
        if not parts:
            return [0.0] * (3 + len(STEPS))
        saved = np.array([len(a(p)) - len(b(p)) for p in parts])
        kb = max(len(text), WINDOW) / 1024
        return [saved.sum() / kb, min(saved.max(), 12.0), min(np.maximum(saved, 0).sum() / kb, 40.0),
                *[float((saved >= s).mean()) for s in STEPS]]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, ...]:
    """(mean, scale, weights with the intercept last) by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step = np.linalg.solve(h, z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


def _by_label(rows: list[tuple[int, bytes]]) -> tuple[list[bytes], list[bytes]]:
    return [t for y, t in rows if y == 1], [t for y, t in rows if y == 0]


def sampled(rows: list[tuple[int, int, int]]) -> list[int]:
    """Keys of the sample from (label, key, bytes): each label has half of ``SAMPLE_BYTES``."""
    left, keep = {}, set()
    for y, _, k, n in sorted((y, n > LONG_BYTES, k, n) for y, k, n in rows):
        if n <= left.setdefault(y, SAMPLE_BYTES // 2):
            left[y] -= n
            keep.add(k)
    return sorted(keep)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Model (plain numbers and bytes) from labelled documents outside the held-out fold."""
    lab = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("_y")))
    key = F.xxhash64("doc_id", F.lit(4))
    share = lab.agg(F.coalesce(F.sum("_y"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    picked = None
    for y, n in ((1, N_TOXIC), (0, N_ORDINARY)):     # the bounds are the feature
        part = lab.filter(F.col("_y") == y).withColumn("_k", key).orderBy("_k").limit(n)
        picked = part if picked is None else picked.unionByName(part)
    rows = (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select("_k", "_y", F.coalesce("text", F.lit("")).alias("t")))
    # One text an id (of the smallest hash): an id may repeat over any number of rows.
    rows = rows.withColumn("_h", F.xxhash64("t"))
    size = rows.groupBy("_k", "_y").agg(F.min(F.struct("_h", F.octet_length("t").alias("n"))).alias("s")).collect()
    text_of = {r["_k"]: r["s"]["_h"] for r in size}
    keep = sampled([(r["_y"], r["_k"], r["s"]["n"]) for r in size])
    chosen = docs.sparkSession.createDataFrame([(k, text_of[k]) for k in keep], "_k long, _h long")
    sample = sorted((r["_k"], r["_y"], r["t"].encode().translate(_LOWER))
                    for r in rows.join(F.broadcast(chosen), ["_k", "_h"]).dropDuplicates(["_k"]).collect())
    prior = (share["t"] + 1) / (share["n"] + 2)
    fold = [[(y, t) for k, y, t in sample if k % 2 == f] for f in (0, 1)]
    if any({y for y, _ in f} != {0, 1} for f in fold):
        return {"prior": prior}
    x, y = [], []
    for f in (0, 1):                 # every document is measured by the other half's dictionaries
        d = Distance(*train_dictionaries(*_by_label(fold[f])))
        x += [d.features(t) for _, t in fold[1 - f]]
        y += [float(label) for label, _ in fold[1 - f]]
    x, y = np.array(x), np.array(y)
    mean, scale, w = fit_logistic(x, y)
    ordinary, toxic = train_dictionaries(*_by_label(fold[0] + fold[1]))
    # The sample has another share of toxic documents than the labels have.
    shift = np.log(prior / (1 - prior)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    w[-1] += shift
    return {"prior": prior, "ordinary": ordinary, "toxic": toxic, "mean": mean, "scale": scale, "w": w}


def scores(model: dict, texts: list[bytes], distance: Distance | None) -> np.ndarray:
    if distance is None or not texts:
        return np.full(len(texts), model["prior"])
    x = (np.array([distance.features(t) for t in texts]) - model["mean"]) / model["scale"]
    return 1 / (1 + np.exp(-np.clip(x @ model["w"][:-1] + model["w"][-1], -30, 30)))


def score(docs: DataFrame, model: dict, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added."""
    keep = [c for c in docs.columns if c != out]

    def run(batches):
        d = Distance(model["ordinary"], model["toxic"]) if "w" in model else None
        for batch in batches:
            for part in slices(batch, text_col):
                data, off = utf8(part.column(part.schema.get_field_index(text_col)))
                data = data.tobytes()
                texts = [data[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores(model, texts, d), pa.float64())],
                                                 names=[*keep, out])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, f"{schema}, `{out}` double")


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows of ``docs`` whose score is below the threshold."""
    cols = docs.columns
    model = train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    if "w" not in model:
        return docs
    return score(docs, model, out="_toxicity").filter(F.col("_toxicity") < THRESHOLD).select(*[F.col(f"`{c}`") for c in cols])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, read_table(spark, sf_dir, "labels"))
    predicted = (F.col("score") >= THRESHOLD).cast("int") if "w" in model else F.lit(0)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", predicted.alias("predicted"))
