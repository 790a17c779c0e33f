"""Helpers shared by the operators: tables, checkpoints, and vectorised words.

A *word* is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; ``A-Z``
are lower-cased for hashing and every other byte is kept, so words agree with
the pattern ``[^\\x20\\x09-\\x0D]+`` on the text's code points. Words are hashed
straight from Arrow's UTF-8 buffer with numpy (a polynomial hash from prefix sums
modulo 2**64, then a mixing step), so no Python string is made per word. Work
goes through the buffer in windows cut at white space; memory does not grow with
the length of a text unless one single word is that long.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

SHINGLE = 5                      # words in a shingle
WINDOW = 1 << 20                 # bytes hashed at a time

_BASE = 0x9E3779B97F4A7C15       # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder (reliable; survives
    the loss of an executor), with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over a uint64 array."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256)
    lower[65:91] += 32
    value = mix64((lower + 1).astype(_U) * _U(0xD6E8FEB86659FD93)) | _U(1)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


BYTE_VALUE, IS_SPACE = _byte_tables()
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, WINDOW + 4096)
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=_U)
    return _powers["up"], _powers["down"]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset: column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word and the word offsets of the texts."""
    hashes, firsts, ends = [], [], []
    a, total = 0, len(data)
    while a < total:
        b = min(a + WINDOW, total)
        while b < total:          # on to the next white space or start of a text
            stop = int(off[np.searchsorted(off, b)])
            more = np.flatnonzero(IS_SPACE[data[b: min(stop, b + WINDOW)]])
            if len(more):
                b += int(more[0])
                break
            if stop <= b + WINDOW:
                b = stop
                break
            b += WINDOW
        part = data[a:b]
        inside = ~IS_SPACE[part]
        cut = np.zeros(b - a + 1, bool)     # a text starts here
        edges = off[np.searchsorted(off, a): np.searchsorted(off, b, "right")] - a
        cut[edges] = True
        cut[0] = cut[-1] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | cut[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | cut[1:-1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if len(s):
            up, down = _power_tables(b - a + 1)
            sums = np.empty(b - a + 1, _U)
            sums[0] = 0
            np.cumsum(BYTE_VALUE[part] * up[: b - a], out=sums[1:])
            hashes.append(mix64((sums[e] - sums[s]) * down[s]))
            firsts.append(s + a)
            ends.append(e + a)
        a = b
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(off), np.int64)
    firsts = np.concatenate(firsts)
    return np.concatenate(hashes), firsts, np.concatenate(ends), np.searchsorted(firsts, off).astype(np.int64)


def shingles(w: np.ndarray, woff: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k``-word shingles of each text (repeats kept) and their
    offsets; a text with 1 to ``k - 1`` words has one shingle, its whole word
    sequence, one without words has none."""
    n = np.diff(woff)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(off[-1], _U)
    mult = mix64(np.arange(1, k + 1).astype(_U)) | _U(1)
    full = n >= k
    if full.any():
        every = np.zeros(len(w) - k + 1, _U)
        for j in range(k):
            every += w[j: j + len(every)] * mult[j]
        shift = np.repeat((woff[:-1] - off[:-1])[full], count[full])
        at = _ranges(off[:-1][full], count[full])
        out[at] = mix64(every[at + shift])
    for m in range(1, k):
        docs = np.flatnonzero(n == m)
        if len(docs):
            acc = np.full(len(docs), m, _U) * _U(0xA24BAED4963EE407)
            for j in range(m):
                acc += w[woff[docs] + j] * mult[j]
            out[off[docs]] = mix64(acc)
    return out, off


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of ``arange(start, start + count)``."""
    total = int(counts.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    base = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    base += np.arange(total)
    return base


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20):
    """The batch in row slices whose ``column`` holds about ``limit`` bytes at
    most (one longer text makes a slice of its own)."""
    _, off = utf8(batch.column(batch.schema.get_field_index(column)))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read again.

    For steps that build on each other in a loop: a checkpointed table keeps the
    size estimate of the plan behind it, and the estimate of a join is the product
    of its sides, so after some rounds of joins planning itself would take minutes.
    A table read from files has its real size. The files go when the application
    ends (or with the checkpoint folder)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)
