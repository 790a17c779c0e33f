"""Operator 5: encoding and decoding with a merge-type piece vocabulary.

Encoding keeps a score-ordered agenda of adjacent symbol pairs: a heap holds
every pair whose concatenation is a piece, best score first and leftmost on
ties; popping merges the pair and pushes its two new neighbours, until the
agenda is empty. Symbols outside the vocabulary become byte pieces. The result
is the one the sentencepiece library gives (``compare_with_library`` runs both
over Arrow batches and returns every difference).

If no piece has a space mark after another character (checked on loading), no
merge crosses from one word into the next, so words are encoded on their own
and remembered in a bounded cache; a text is then a sequence of lookups.
Otherwise a whole text is one unit of the same agenda.

Defined cases: a null or empty text has no ids and decodes to the empty text;
repeated rows and ids are encoded as often as they come; a null id is passed on; other columns are
ignored; an empty table gives no rows. Texts of any length work: the agenda is
O(n log n) in the longest word.

Scale: one map over the table, no shuffle; per worker the vocabulary and at most
``CACHE_WORDS`` remembered words.
"""

from __future__ import annotations

import gc
import heapq
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

MARK = "▁"                  # stands for a space
CACHE_WORDS = 160_000            # remembered words per worker
PUNCTUATION = ".,;:!?%$&*#|\"')("
MODEL = "piece_bpe_32k.model"


_NONE = float("inf")


class Remembered(dict):
    """Values of ``make(key)`` for the keys seen lately: two generations of at
    most ``CACHE_WORDS / 2`` keys; the older is dropped when the newer is full."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > 64:
                return value
        if len(self) >= CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class PieceCodec:
    """Vocabulary of a merge-type model with byte pieces."""

    def __init__(self, path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.rank, self.id_of = {}, {}
        self.byte_id = [0] * 256
        self.plain: list[bytes | None] = [None] * n      # None: not an ordinary piece
        self.raw: list[int] = [-1] * n                   # byte value of byte pieces
        self.unknown = lib.unk_id()
        for i in range(n):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_id[int(p[1:-1], 16)] = i
                self.raw[i] = int(p[1:-1], 16)
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.id_of[p] = i
                self.rank[p] = -lib.get_score(i)
                self.plain[i] = p.replace(MARK, " ").encode()
        text = [p if p is not None else bytes([r]) if r >= 0 else b"" for p, r in zip(self.plain, self.raw)]
        self.blob = np.frombuffer(b"".join(text), np.uint8)
        self.piece_len = np.array([len(t) for t in text], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.lead_space = np.array([p is not None and p[:1] == b" " for p in self.plain])
        self.special = np.array([p is None and r < 0 for p, r in zip(self.plain, self.raw)])
        long = [p for p in self.id_of if len(p) > 1]
        self.by_word = not any(a != MARK and b == MARK for p in long for a, b in zip(p, p[1:]))
        self.inside = {p[i:i + 2] for p in long for i in range(len(p) - 1)}   # pairs that can merge at all
        self.word, self.part = Remembered(self._unit), Remembered(lambda t: array("i", self._merge(t)).tobytes())

    def _merge(self, unit: str) -> list[int]:
        """Ids of one unit (space marks in place) by the agenda."""
        rank, sym = self.rank.get, list(unit)
        if len(sym) > 48:
            sym = self._merge_long(sym)
        elif len(sym) > 1:
            # A short unit's agenda is a list beside the symbols: entry i is the
            # rank of the pair (i, i + 1); its minimum, leftmost, is merged next.
            agenda = [rank(a + b, _NONE) for a, b in zip(sym, sym[1:])]
            while agenda:
                best = min(agenda)
                if best == _NONE:
                    break
                i = agenda.index(best)
                sym[i] += sym[i + 1]
                del sym[i + 1], agenda[i]
                if i < len(agenda):
                    agenda[i] = rank(sym[i] + sym[i + 1], _NONE)
                if i:
                    agenda[i - 1] = rank(sym[i - 1] + sym[i], _NONE)
        ids: list[int] = []
        for s in sym:
            i = self.id_of.get(s)
            if i is not None:
                ids.append(i)
            else:
                ids.extend([self.byte_id[b] for b in s.encode()])
        return ids

    def _merge_long(self, sym: list) -> list[str]:
        """The same agenda as a heap over linked symbols, for long units."""
        rank = self.rank.get
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = [(r, i, sym[i] + sym[i + 1]) for i in range(n - 1)
                  if (r := rank(sym[i] + sym[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = right[i] if sym[i] is not None else n
            if j >= n or sym[i] + sym[j] != piece:
                continue                                 # one side has merged since
            sym[i], sym[j] = piece, None
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank(piece + sym[k])) is not None:
                    heapq.heappush(agenda, (r, i, piece + sym[k]))
            h = left[i]
            if h >= 0 and (r := rank(sym[h] + piece)) is not None:
                heapq.heappush(agenda, (r, h, sym[h] + piece))
        return [s for s in sym if s is not None]

    def _unit(self, word: str) -> bytes:
        """Packed ids of ``" " + word``. Punctuation at the end is encoded apart
        where no piece holds both neighbours of the cut."""
        text = MARK + (word.replace(" ", MARK) if " " in word else word)
        m = len(text.rstrip(PUNCTUATION))
        if 0 < m < len(text) and text[m - 1:m + 1] not in self.inside:
            return self.part[text[:m]] + self.part[text[m:]]
        return self.part[text]

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as packed int32."""
        if not text:
            return b""
        if MARK in text:
            text = text.replace(MARK, " ")
        if not self.by_word:
            return self._unit(text)
        if text[0] != " " and text[-1] != " " and "  " not in text:
            units = text.split(" ")
        else:                        # runs of spaces stay with the word after them
            units = [u[1:] for u in re.findall(" +[^ ]*", " " + text)]
        return b"".join(map(self.word.__getitem__, units))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of any id sequence, as the library's ``decode`` gives it."""
        plain = self.plain
        try:
            out = b"".join([plain[i] for i in ids]).decode()
        except TypeError:            # byte, control or unknown pieces
            parts, run = [], bytearray()
            for i in [*ids, None]:
                if i is not None and self.raw[i] >= 0:
                    run.append(self.raw[i])
                    continue
                if run:
                    parts.append(_decode_bytes(bytes(run)))
                    run.clear()
                if i is not None and i == self.unknown:
                    parts.append(" ⁇ ")
                elif i is not None and plain[i] is not None:
                    parts.append(plain[i].decode())
            out = "".join(parts)
            # The dropped space must come from the first piece that is text.
            first = next((i for i in ids if plain[i] is not None or self.raw[i] >= 0 or i == self.unknown), None)
            return out[1:] if first is not None and plain[first] is not None and out[:1] == " " else out
        return out[1:] if out[:1] == " " else out


def _decode_batch(c: PieceCodec, ids: np.ndarray, off: np.ndarray) -> pa.Array:
    """Texts of the id lists ``ids[off[i]:off[i + 1]]``, gathered byte-wise."""
    size, at = c.piece_len[ids], c.piece_at[ids]
    first = off[:-1][np.diff(off) > 0]
    strip = first[c.lead_space[ids[first]]]
    size[strip] -= 1                     # the space put before every text
    at[strip] += 1
    end = np.cumsum(size)
    data = c.blob[np.repeat(at - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
    text_off = np.concatenate([[0], end])[off]
    inner = text_off[text_off < len(data)]
    whole = not ((data[inner] & 0xC0) == 0x80).any() and not c.special[ids].any()
    if whole:
        try:
            data.tobytes().decode()
        except UnicodeDecodeError:
            whole = False
    if not whole:                        # bytes that are no text, control or unknown pieces
        v = ids.tolist()
        return pa.array([c.decode(v[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.large_string())
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(text_off.astype(np.int64).tobytes()),
                                            pa.py_buffer(data.tobytes()))


def _decode_bytes(run: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that is part of no character."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):
            for n in (1, 2, 3, 4):
                try:
                    out.append(run[i:i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return batch.column(batch.schema.get_field_index(column)).fill_null("").to_pylist()


def _encode_batch(c: PieceCodec, batch: pa.RecordBatch, column: str) -> pa.Array:
    packed = [c.encode_packed(t) for t in _texts(batch, column)]
    off = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids`` (array of int) of every row."""
    def run(batches):
        c = codec(model_path)
        gc.disable()                 # remembered words are many small objects, none in cycles
        for batch in batches:
            for part in slices(batch, "_text"):
                yield pa.RecordBatch.from_arrays([part.column(0), _encode_batch(c, part, "_text")],
                                                 names=["_id", "ids"])
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` (any columns, with ``ids``) with the column ``decoded`` added."""
    keep = encoded.columns

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            off = ids.offsets.to_numpy().astype(np.int64)    # a null list holds no ids
            values = ids.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]]
            texts = _decode_batch(c, values, off - off[0]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*keep, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, schema + ", decoded string")


def compare_with_library(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """Rows (``id_col, what``) on which the library's ids or decoded text differ."""
    def run(batches):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=model_path)
        c = codec(model_path)
        for batch in batches:
            texts = _texts(batch, "_text")
            bad, what = [], []
            for i, (t, want) in enumerate(zip(texts, lib.encode(texts, num_threads=1))):
                got = c.encode(t)
                wrong = "ids" if got != want else "text" if c.decode(got) != lib.decode(want) else None
                if wrong:
                    bad.append(i)
                    what.append(wrong)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(bad, pa.int64())),
                                              pa.array(what, pa.string())], names=["_id", "what"])
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, what string").withColumnRenamed("_id", id_col)


def with_ids(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids``, encoded on the way (no join back)."""
    keep = [c for c in docs.columns if c != "ids"]

    def run(batches):
        c = codec(model_path)
        gc.disable()
        for batch in batches:
            for part in slices(batch, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, _encode_batch(c, part, text_col)],
                                                 names=[*keep, "ids"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep]).mapInArrow(run, schema + ", ids array<int>")


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids, decoded``: both directions in one pass over a batch, for callers
    that need both (one Python worker per task instead of two)."""
    def run(batches):
        c = codec(model_path)
        gc.disable()
        for batch in batches:
            for part in slices(batch, "_text", 2 << 20):
                ids = _encode_batch(c, part, "_text")
                texts = _decode_batch(c, ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, texts.cast(pa.string())],
                                                 names=["_id", "ids", "decoded"])
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids array<int>, decoded string").withColumnRenamed("_id", id_col)


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path(MODEL)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    out = encode_decode(docs, model_path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: digests of ids and decoded text of every document."""
    return digests(read_table(spark, sf_dir, "documents"), default_model())
