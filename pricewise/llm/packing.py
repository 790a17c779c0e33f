"""Operator 11: best-fit packing by large-item matching.

Documents become pieces of at most ``capacity`` tokens (only longer documents are
cut), and pieces are packed into as few sequences as possible:

1. Pieces above a third of the capacity are *large*; a bin holds two of them at
   most. Greedy matching, longest first: each is paired with the longest large
   piece that still fits beside it, or stands alone.
2. The others go, longest first, to the bin with the smallest gap that holds them
   (best fit); where none does, a bin is opened.

A packing only depends on how many pieces there are of each length, so the matching
runs on that histogram: ``capacity`` counts, whatever the size of the corpus. Whole
classes are placed at once as *slots*: ranks ``first, first + 1, ...`` of a length
go to ``bin0, bin0 + 1, ...``, ``per_bin`` to a bin, from ``offset`` on. Spark ranks
the pieces within their length and every piece looks its slot up.

Bounds. Matching makes at most one range of bins per large class and partner step,
best fit splits at most two ranges a class, and the gap of a range shrinks by a
smaller length each time, so there are at most some tens of slots a range: a table
bounded by the capacity (``plan_bins`` for 2,048 tokens: at most about 6,000 ranges),
never by the documents.

Ids are those of the tokenizers library. Merges of the vocabulary never cross white
space and its normaliser works within words (checked on loading; otherwise whole
texts go to the library), so ids are looked up by word, and the words a worker does
not remember go to the library's own merge model.

Defined cases: a null or empty text has the closing id alone (one piece of length
1); rows sharing an id, null ids and repeated rows are packed as often as they come;
a text of any length is cut into full pieces and one last piece; an empty table gives no
rows; other columns are ignored. Ranks follow the order of the table's partitions,
which is fixed by writing the pieces once, so numbers survive lost executors; a rerun
may number equal lengths differently.

Scale: one map over the texts; what is shuffled is 40 bytes a piece. Counts are kept
per (input partition, length), so a length that most pieces have is split over all
partitions.
"""

from __future__ import annotations

import gc
import json
import struct
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, slices, stored, written
from .units import Units

CAPACITY = 2048
CLOSING_ID = 0
TOKENIZER = "word_bpe_49k.json"
PUNCTUATION = b".,;:!?%$&*#|\")("
SLICE = 8 << 20                  # bytes of text handled at a time
KEEP = 250_000                   # remembered words


# ---------------------------------------------------------------- ids

class WordIds:
    """Packed little-endian 32-bit ids of texts, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        with open(path) as f:
            spec = json.load(f)
        self.by_word = self._word_local(spec)
        self.word = Units(self._words, KEEP)
        self.core = Units(self._cores, KEEP)
        self.tail = Units(lambda ts: self._library([t.decode() for t in ts]))
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = sorted(set(range(256)) - set(plain))
        # The printable stand-ins of bytes in byte-level vocabularies.
        self.shown = {b: chr(256 + i) for i, b in enumerate(rest)}

    @staticmethod
    def _word_local(spec: dict) -> bool:
        """Lower-casing word vocabulary: NFC, white space made one space, lower case;
        letters, single digits and other runs cut apart, white space removed."""
        norm = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return (norm == ["NFC", "Replace", "Lowercase"] and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
                and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
                and cuts[0]["pattern"] == {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
                and spec["post_processor"] is None and spec["model"]["type"] == "BPE")

    def _library(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids)
                for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _cores(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case letter runs: one cut each, so one call of the merge model."""
        out = []
        for w in words:
            if not w.isascii():
                w = w.encode().decode("latin-1").translate(self.shown)
            ids = [t.id for t in self.model.tokenize(w)]
            out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def _words(self, words: list[bytes]) -> list[bytes]:
        """A word of Latin-1 letters (which NFC leaves alone and which are lower-cased one
        by one) with punctuation behind it is its letters and one more cut; any other
        word goes to the library as it is."""
        plain, cores, tails, other = [], [], [], []
        for i, w in enumerate(words):
            c = w.rstrip(PUNCTUATION)
            t = c.lower().decode() if c.isalpha() else c.decode()      # of bytes: ASCII letters only
            if t.isascii():
                good = t.isalpha()
            else:
                good = t.isalpha() and max(t) < "\u0100"
                t = t.lower()
            if good:
                plain.append(i)
                cores.append(t)
                tails.append(w[len(c):])
            else:
                other.append(i)
        out: list = [None] * len(words)
        for i, a, b in zip(plain, self.core.rows(cores), self.tail.rows(tails)):
            out[i] = a + b
        for i, ids in zip(other, self._library([words[i].decode() for i in other])):
            out[i] = ids
        return out

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column, one after the other, and where each begins."""
        if not self.by_word:
            packed = self._library(texts.to_pylist())
            return (np.frombuffer(b"".join(packed), "<u4"),
                    np.cumsum([0, *(len(p) // 4 for p in packed)]))
        split = pc.ascii_split_whitespace(texts)             # at \x20 and \x09-\x0D; edges give empty words
        coded = split.flatten().dictionary_encode()
        rows = self.word.rows(coded.dictionary.cast(pa.binary()).to_pylist())
        which = coded.indices.to_numpy()
        size = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        begin, n = np.cumsum(size) - size, size[which]
        end = np.cumsum(n)
        blob = np.frombuffer(b"".join(rows), "<u4")
        ids = blob[np.repeat(begin[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        return ids, np.concatenate([[0], end])[split.offsets.to_numpy()]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path(TOKENIZER)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int | None = CLOSING_ID,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], _part, _nth`` of every document's
    pieces; ``_nth`` counts the pieces of a length within the input partition ``_part``."""
    end = b"" if closing is None else struct.pack("<I", closing)

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        gc.disable()                 # remembered words are many small objects, none in cycles
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        coder = word_ids(tokenizer)
        used = np.zeros(capacity + 1, np.int64)          # pieces of each length so far
        for batch in batches:
            for rows in slices(batch, "_text", SLICE):
                flat, at = coder.texts(rows.column(1).fill_null(""))
                packed_all, at = flat.tobytes(), (4 * at).tolist()
                doc, piece, start, length, crc, ids = [], [], [], [], [], []
                for d in range(rows.num_rows):
                    packed = packed_all[at[d]: at[d + 1]] + end
                    for j, a in enumerate(range(0, len(packed), 4 * capacity)):
                        cut = packed[a: a + 4 * capacity]
                        doc.append(d)
                        piece.append(j)
                        start.append(a // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            ids.append(np.frombuffer(cut, "<u4").astype(np.int32))
                length = np.array(length, np.int64)
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                first = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
                begin = np.flatnonzero(first)
                nth = np.empty(len(length), np.int64)
                runs = np.diff(np.append(begin, len(ranked)))
                nth[order] = np.arange(len(ranked)) - np.repeat(begin, runs) + used[ranked]
                used[ranked[begin]] += runs
                cols = [rows.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                cols += [pa.array(np.full(len(length), part), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    fields = ["doc_id " + kind, "piece int", "start long", "length long", "ids_crc32 long",
              *(["ids array<int>"] if with_ids else []), "_part int", "_nth long"]
    names = [f.split()[0] for f in fields]
    return src.mapInArrow(run, ", ".join(fields))


# ---------------------------------------------------------------- matching

def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Slots ``(length, first, bin0, per_bin, offset)`` of a histogram of lengths, ordered
    by (length, first), and the number of bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("lengths must be in 1..capacity")
    used = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int]] = []
    ranges: dict[int, list[tuple[int, int]]] = {}        # gap -> [(bin0, bins)]
    gaps: list[int] = []                                 # its keys, ascending
    n_bins = 0

    def place(length, many, bin0, per_bin, offset):
        slots.append((length, used[length], bin0, per_bin, offset))
        used[length] += many
        left[length] -= many

    def keep(gap, bin0, bins):
        if gap and bins:
            if gap not in ranges:
                ranges[gap] = []
                insort(gaps, gap)
            ranges[gap].append((bin0, bins))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        while left[a]:
            at = bisect_left(large, capacity - a + 1) - 1      # the longest that fits beside a
            while at >= 0 and left[large[at]] - (large[at] == a) <= 0:
                at -= 1
            b = large[at] if at >= 0 else None
            bins = left[a] if b is None else left[a] // 2 if b == a else min(left[a], left[b])
            place(a, 2 * bins if b == a else bins, n_bins, 2 if b == a else 1, 0)
            if b is not None and b != a:
                place(b, bins, n_bins, 1, a)
            keep(capacity - a - (b or 0), n_bins, bins)
            n_bins += bins
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                fresh = -(-left[n] // (capacity // n))
                keep(capacity, n_bins, fresh)
                n_bins += fresh
                continue
            gap = gaps[at]
            bin0, bins = ranges[gap].pop()
            if not ranges[gap]:
                del ranges[gap], gaps[at]
            per_bin = gap // n
            full = min(bins, left[n] // per_bin)
            if full:
                place(n, full * per_bin, bin0, per_bin, capacity - gap)
                keep(gap - per_bin * n, bin0, full)
            if full < bins and left[n]:                  # the last, fewer than a bin takes
                some = left[n]
                place(n, some, bin0 + full, per_bin, capacity - gap)
                keep(gap - some * n, bin0 + full, 1)
                full += 1
            keep(gap, bin0 + full, bins - full)
    return np.array(sorted(slots), np.int64).reshape(-1, 5), n_bins


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (written pieces: see ``pieces``) with ``sequence_id`` and ``offset``."""
    counts = cut.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    # One row per length, at most ``capacity`` of them.
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, _ = plan_bins(hist, capacity)
    keep = [c for c in cut.columns if c not in ("_part", "_nth")]

    def run(batches):
        keys = slots[:, 0] << 48 | slots[:, 1]
        for batch in batches:
            length = batch.column(keep.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(len(keep)).to_numpy(zero_copy_only=False)
            s = slots[np.searchsorted(keys, length << 48 | rank, "right") - 1]
            i = rank - s[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(s[:, 2] + i // s[:, 3]), pa.array(s[:, 4] + i % s[:, 3] * length)],
                names=[*keep, "sequence_id", "offset"])
    ranked = (cut.join(counts.select("length", "_part", "_before"), ["length", "_part"])
              .select(*keep, (F.col("_before") + F.col("_nth")).alias("_rank")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in keep)
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, closing: int | None = CLOSING_ID,
         with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset`` of every piece.
    Pieces are written once: their numbers within a partition must stay as they are."""
    return assign(written(pieces(docs, tokenizer, capacity, closing, with_ids=with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids`` from ``pack(..., with_ids=True)``: the training
    sequences, each of at most ``capacity`` tokens."""
    parts = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id"))).alias("_p"))
    return parts.select("sequence_id", F.aggregate("_p", F.lit(0), lambda n, p: n + F.size(p["ids"])).alias("n_tokens"),
                        F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"),
                        F.transform("_p", lambda p: p["doc_id"]).alias("doc_ids"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: where every piece of every document lies."""
    return pack(read_table(spark, sf_dir, "documents"), default_tokenizer())
