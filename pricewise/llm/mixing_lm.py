"""Operator 6: language-model scoring by online logistic context mixing.

A text is its words (lower-cased), then one end token. A token is coded as binary
decisions: eight bits of its class (a hash of the word's last two bytes; class 0
is the end), one bit whether the word is unknown, and a known word within its class:
a mixture of its share of the class's training tokens and its share of those that
follow the word before. So the probabilities of all tokens add up to one.

Each class bit is predicted by five predictors: bit counts under four hashed
contexts (none, the class before, the two classes before, the word before),
gathered from all training documents, and a per-text adaptive state. Their
stretched probabilities are combined by a weight set that a gate selects (bit
position, and whether the two-class context is well known); after every bit the
chosen weights, and the adaptive states, are refined by the coding error. The
unknown bit has the class's share of words seen once as its prior and is refined
along the text in the same way, and so is the weight of the second share, one a level
of how often the class follows the word before (``LEVELS``). The score is the log10 probability of the tokens,
an unknown word being one symbol (as in ``base_score``). ``bits_per_byte`` adds the
spelling of unknown words, each byte and a closing blank predicted from the byte
before (counts of the training words), and divides by the bytes of the text.

Weights and states run through a whole text and start afresh with the next, so
texts are scored side by side and the result doesn't depend on how the table is
partitioned. (``SEGMENT``, if smaller than a text, restarts them within it.)

Data flow. Documents are packed into blocks as they are read. A block gives its
distinct words with training counts, cut into hash buckets, and its context
counts; buckets add up the counts of all blocks and answer every block with the
corpus counts of its words; the block then scores its texts. Pairs of a word and the
word before go the same way: a block sends a key of ``CONTEXT_BITS`` for the word before
with the class and ``WORD_BITS`` for the word, and gets back how often the pair and its
context stand in the training texts; there are more buckets for larger corpora. The class
bits' context tables have a fixed size; counts of words and pairs grow with the corpus
and are never gathered in one place.

Defined cases: a null or empty text is the end token alone; repeated rows count
and are scored each; a null ``doc_id`` is a training document; without training
documents N, V and all counts are 0 and every token is unknown (the score is that
of the untrained mixture); an empty table gives no rows; other columns are
ignored. A text of any length is scored whole, word after word in one task. Two words are taken as one with probability 2**-64 a pair (hashes);
two words of a class after the same word with 2**-20, two contexts with 2**-32.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ranges, mix64, read_table, stored, utf8, words

BLOCK_BYTES = 12 << 20
BUCKETS = 64                     # of word hashes (a power of two); more for larger corpora
SEGMENT = 1 << 40                # tokens scored with one set of weights and states
CONTEXTS = 4096                  # hashed contexts of a table
WEIGHTS = (0.05, 0.35, 0.35, 0.15, 0.15)
RATE, STATE_RATE, UNKNOWN_RATE = 0.003, 0.3, 0.2
SEEN = 400                       # tokens that make a two-class context well known
BACKOFF = 4.0
CONTEXT_BITS, WORD_BITS = 32, 20     # of a pair's key
LEVELS = (1, 3, 10, 100)         # occurrences of a context, each level with a weight of its own
FOLLOW = (-2.0, -1.0, 0.0, 1.0)  # logits of the weight of the share after the word before
FOLLOW_RATE = 0.1

_PARTS = "kind int, block long, bucket int, a binary, b binary, c binary"
_NAMES = ["kind", "block", "bucket", "a", "b", "c"]
_TEXT, _COUNT, _TABLE, _STAT, _ANSWER, _PAIR = range(6)


def _pack(x: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _unpack(b: bytes, kind) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _pack_steps(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: their steps, byte plane by byte plane."""
    import zstandard
    planes = np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack_steps(b: bytes) -> np.ndarray:
    planes = _unpack(b, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


# ---------------------------------------------------------------- tokens

class Tokens:
    """Words and ends of some texts, in order, with the classes of the contexts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w, first, end, woff = words(data, off)
        n = np.diff(woff)
        last = data[np.maximum(end - 1, 0)].astype(np.int64) if len(w) else np.zeros(0, np.int64)
        before = np.where(end - first > 1, data[np.maximum(end - 2, 0)], 0).astype(np.int64) if len(w) else last
        fold = lambda b: np.where((b >= 65) & (b <= 90), b + 32, b)      # noqa: E731
        cls = (mix64((fold(before) * 256 + fold(last)).astype(np.uint64)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
        self.data, self.first, self.end = data, first, end
        self.count = n + 1                           # tokens of each text
        self.off = np.concatenate([[0], np.cumsum(self.count)])
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), self.count)
        total = int(self.off[-1])
        self.is_end = np.zeros(total, bool)
        self.is_end[self.off[1:] - 1] = True
        self.word = np.zeros(total, np.uint64)
        self.word[~self.is_end] = w
        self.cls = np.zeros(total, np.uint8)
        self.cls[~self.is_end] = cls
        start = np.zeros(total, bool)
        start[self.off[:-1]] = True
        # At a text's start the classes before are 0 and the word before is 0.
        c1, w1 = np.roll(self.cls, 1), np.roll(self.word, 1)
        c1[start], w1[start] = 0, 0
        c2 = np.roll(c1, 1)
        c2[start] = 0
        self.c1 = c1
        self.two = (mix64(c2.astype(np.uint64) * np.uint64(256) + c1 + np.uint64(1)) % np.uint64(CONTEXTS)).astype(np.uint16)
        self.prev = (mix64(w1 ^ np.uint64(0x51ED270B)) % np.uint64(CONTEXTS)).astype(np.uint16)
        self.before = w1

    def tables(self, use: np.ndarray) -> np.ndarray:
        """Class counts under each context, of the tokens marked in ``use``: rows for
        the class before, the two before and the word before."""
        size = CONTEXTS * 256
        cls = self.cls[use]
        return np.concatenate([np.bincount(c[use].astype(np.int32) * 256 + cls, minlength=cells)
                               for c, cells in ((self.c1, 65536), (self.two, size), (self.prev, size))])

    def pairs(self) -> np.ndarray:
        """Key of every word with the word before it; the context is in the high bits."""
        inner = ~self.is_end
        context = mix64(mix64(self.before[inner]) ^ self.cls[inner].astype(np.uint64)) >> np.uint64(64 - CONTEXT_BITS)
        word = mix64(self.word[inner] ^ np.uint64(0x2545F491)) >> np.uint64(64 - WORD_BITS)
        return (context << np.uint64(WORD_BITS)) | word

    def spelled(self, which: np.ndarray):
        """(word, byte before, byte) of the marked words, some at a time; a word begins
        and closes with a blank."""
        size = self.end[which] - self.first[which] + 1
        cut = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()), 1 << 18))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(which)]):
            n = size[a:b]
            if not len(n):
                continue
            at = _ranges(self.first[which[a:b]], n)
            byte = self.data[np.minimum(at, len(self.data) - 1)].astype(np.int64)
            byte = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
            byte[np.cumsum(n) - 1] = 32
            before = np.roll(byte, 1)                # the first follows the closing blank of the last
            yield np.repeat(which[a:b], n), before, byte

    def spellings(self, use: np.ndarray) -> np.ndarray:
        """Counts of bytes after each byte, in words of tokens marked in ``use``."""
        out = np.zeros(65536, np.int64)
        for _, before, byte in self.spelled(np.flatnonzero(use[~self.is_end])):
            out += np.bincount(before * 256 + byte, minlength=65536)
        return out

    def spelling_bits(self, unknown: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Bits of the spelling of the words marked in ``unknown``, for every text."""
        pairs = counts.reshape(256, 256).astype(float)
        alone = (pairs.sum(0) + 1) / (pairs.sum() + 256)
        bits = -np.log2((pairs + BACKOFF * alone) / (pairs.sum(1, keepdims=True) + BACKOFF)).ravel()
        out, of = np.zeros(len(self.count)), self.doc[~self.is_end]
        for word, before, byte in self.spelled(np.flatnonzero(unknown[~self.is_end])):
            out += np.bincount(of[word], bits[before * 256 + byte], minlength=len(out))
        return out


# ---------------------------------------------------------------- model

def _paths() -> tuple[np.ndarray, np.ndarray]:
    """(node, bit) of each of the eight decisions of every class."""
    c, k = np.arange(256)[:, None], np.arange(8)[None, :]
    return (256 + c) >> (8 - k), (c >> (7 - k)) & 1


NODE, BIT = _paths()


def _stretch(counts: np.ndarray, prior: np.ndarray | None) -> np.ndarray:
    """Logits of bit 1 at every node from class counts (contexts, 256)."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for level in range(7, -1, -1):
        lo, hi = 1 << level, 2 << level
        tree[:, lo:hi] = tree[:, 2 * lo:2 * hi:2] + tree[:, 2 * lo + 1:2 * hi:2]
    ones = np.zeros((len(counts), 256))
    ones[:, 1:] = tree[:, 3::2]
    p = (ones + 0.4) / (tree[:, :256] + 0.8) if prior is None else (ones + BACKOFF * prior) / (tree[:, :256] + BACKOFF)
    p = np.clip(p, 2e-4, 1 - 2e-4)
    return np.log(p / (1 - p)).astype(np.float32)


class Model:
    """Stretched context tables and the static part of known words."""

    def __init__(self, table: np.ndarray, class_tokens: np.ndarray, class_once: np.ndarray):
        size = CONTEXTS * 256
        one, two, prev = (table[:65536].reshape(256, 256), table[65536:65536 + size].reshape(CONTEXTS, 256),
                          table[65536 + size:].reshape(CONTEXTS, 256))
        self.s0 = _stretch(one.sum(0, keepdims=True), None)
        prior = 1 / (1 + np.exp(-self.s0.astype(float)))
        self.s1, self.s2, self.s3 = (_stretch(t, prior) for t in (one, two, prev))
        self.known_context = (two.sum(1) >= SEEN).astype(np.int64)
        self.class_tokens = class_tokens
        unknown = (class_once + 0.5) / (class_tokens + 1.0)
        unknown = np.clip(unknown, 1e-5, 0.9)
        self.unknown = np.log(unknown / (1 - unknown)).astype(np.float32)

    def score(self, t: Tokens, c: np.ndarray, pair: np.ndarray | None = None, context: np.ndarray | None = None) -> np.ndarray:
        """Log10 probability of every text; ``c`` is each token's training count, ``pair`` and
        ``context`` how often it follows the word before and its class does."""
        total = np.zeros(len(t.count))
        known = c > 0
        inner = known & ~t.is_end
        share = np.ones(len(c))
        share[inner] = c[inner] / self.class_tokens[t.cls[inner]]
        if context is None:
            context = np.zeros(len(c), np.int64)
        level = np.where(inner, np.searchsorted(LEVELS, context, "right") - 1, -1).astype(np.int8)
        mixed = level >= 0
        follow = np.zeros(len(c))
        if mixed.any():
            follow[mixed] = pair[mixed] / context[mixed]
        total += np.bincount(t.doc, np.where(mixed, 0.0, np.log(share)), minlength=len(total))
        # segments, longest first, so that the active ones are a prefix
        n_seg = -(-t.count // SEGMENT)
        of = np.repeat(np.arange(len(t.count)), n_seg)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n_seg) - n_seg, n_seg)
        begin = t.off[of] + nth * SEGMENT
        length = np.minimum(SEGMENT, t.off[of + 1] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, of = begin[order], length[order], of[order]
        lanes = len(begin)
        weight = np.empty((lanes, 2, 8, 5), np.float32)
        weight[:] = np.array(WEIGHTS, np.float32)
        state = np.repeat(self.s0, lanes, axis=0)
        unknown_state = np.zeros(lanes, np.float32)
        follow_weight = np.tile(np.array(FOLLOW), (lanes, 1))
        loss = np.zeros(lanes)
        active = np.searchsorted(-length, -np.arange(length.max(initial=0)), "left")    # lanes longer than the step
        lane = np.arange(lanes)
        one = np.float32(1)
        for step in range(int(length.max(initial=0))):
            m = int(active[step])
            at = begin[:m] + step
            cls = t.cls[at]
            node, bit = NODE[cls], BIT[cls].astype(np.float32)
            x = np.empty((m, 8, 5), np.float32)
            x[:, :, 0] = self.s0.ravel()[node]
            x[:, :, 1] = self.s1.ravel()[(t.c1[at].astype(np.int64) * 256)[:, None] + node]
            two = t.two[at].astype(np.int64)
            x[:, :, 2] = self.s2.ravel()[(two * 256)[:, None] + node]
            x[:, :, 3] = self.s3.ravel()[(t.prev[at].astype(np.int64) * 256)[:, None] + node]
            cell = (lane[:m] * 256)[:, None] + node
            own = state.ravel()[cell]
            x[:, :, 4] = own
            gate = self.known_context[two]
            w = weight[lane[:m], gate]
            p = one / (one + np.exp(-np.clip((w * x).sum(2), -12, 12)))
            loss[:m] += np.log(np.where(bit > 0, p, one - p)).sum(1, dtype=np.float64)
            w += (np.float32(RATE) * (bit - p))[:, :, None] * x
            weight[lane[:m], gate] = w
            state.ravel()[cell] = own + np.float32(STATE_RATE) * (bit - one / (one + np.exp(-own)))
            # known or unknown word
            u = one / (one + np.exp(-(self.unknown[cls] + unknown_state[:m])))
            is_word, is_unknown = cls > 0, c[at] == 0
            loss[:m] += np.where(is_word, np.log(np.where(is_unknown, u, one - u)), 0.0)
            unknown_state[:m] += np.where(is_word, np.float32(UNKNOWN_RATE) * (is_unknown - u), 0).astype(np.float32)
            # the word within its class
            use = np.flatnonzero(mixed[at])
            if len(use):
                i, g = at[use], level[at[use]]
                v = 1 / (1 + np.exp(-follow_weight[use, g]))
                both = v * follow[i] + (1 - v) * share[i]
                loss[use] += np.log(both)
                follow_weight[use, g] += FOLLOW_RATE * (v * follow[i] / both - v)
        total += np.bincount(of, loss, minlength=len(total))
        return total / np.log(10.0)


# ---------------------------------------------------------------- jobs

def _bucket_edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of ascending hashes into buckets by their highest bits."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    return np.searchsorted(hashes >> shift, np.arange(buckets + 1).astype(np.uint64)) if buckets > 1 \
        else np.array([0, len(hashes)])


def _record(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Texts packed into blocks, their words' training counts, their context counts."""
    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 24
        held, size = [], 0
        for batch in _cut(batches):
            held.append(batch)
            size += batch.column(1).nbytes
            if size >= BLOCK_BYTES:
                block += 1
                yield from emit(block, held)
                held, size = [], 0
        if held:
            yield from emit(block + 1, held)

    def _cut(batches):
        for batch in batches:
            off = utf8(batch.column(1))[1]
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(off, off[a] + BLOCK_BYTES // 4, "right")) - 1)
                yield batch.slice(a, b - a)
                a = b

    def emit(block, held):
        table = pa.Table.from_batches(held).combine_chunks()
        data, off = utf8(table.column(1))
        t = Tokens(data, off)
        train = ~table.column(2).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        use = train[t.doc]
        inner = ~t.is_end
        distinct, first, place = np.unique(t.word[inner], return_index=True, return_inverse=True)
        count = np.bincount(place, use[inner], minlength=len(distinct)).astype(np.uint32)
        cls = t.cls[inner][first]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        yield _record([(_TEXT, block, -1, sink.getvalue().to_pybytes(), None, None)])
        cuts = _bucket_edges(distinct, buckets)
        yield _record([(_COUNT, block, i, _pack_steps(distinct[a:b]), _pack(count[a:b]), _pack(cls[a:b]))
                       for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a])
        tables = np.concatenate([t.tables(use), t.spellings(use)]).reshape(BUCKETS, -1)
        yield _record([(_TABLE, block, i, _pack(tables[i].astype(np.int32)), None, None) for i in range(BUCKETS)])
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"),
                      F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
                      .alias("_held"))
    return stored(src.mapInArrow(run, _PARTS))


def _totals(parts: DataFrame) -> DataFrame:
    """Corpus counts of every block's words, per bucket, with class totals; summed tables."""
    def run(batches):
        bucket, hashes, counts, classes, waiting, table, asked = None, None, None, None, [], None, []

        def merge():
            nonlocal hashes, counts, classes, waiting
            if waiting:
                old = [] if hashes is None else [(hashes, counts, classes)]
                h, c, k = (np.concatenate(x) for x in zip(*old, *waiting))
                hashes, first, place = np.unique(h, return_index=True, return_inverse=True)
                counts = np.bincount(place, c, minlength=len(hashes)).astype(np.int64)
                classes = k[first]
                waiting = []

        def stats(rows):
            if bucket is not None and hashes is not None:
                seen = counts > 0
                k = classes.astype(np.int64)
                rows.append((_STAT, -1, bucket, np.bincount(k, counts, minlength=256).astype(np.int64).tobytes(),
                             np.bincount(k[counts == 1], minlength=256).astype(np.int64).tobytes(),
                             np.array([seen.sum()], np.int64).tobytes()))
                for block, own in asked:
                    rows.append((_ANSWER, block, bucket, _pack(counts[np.searchsorted(hashes, _unpack_steps(own))]),
                                 None, None))
            if table is not None:
                rows.append((_TABLE, -1, bucket, _pack(table), None, None))
        for batch in batches:
            rows = []
            for kind, block, b, x, y, z in zip(*[c.to_pylist() for c in batch.columns]):
                if b != bucket:
                    merge()
                    stats(rows)
                    bucket, hashes, waiting, table, asked = b, None, [], None, []
                if kind == _COUNT:
                    asked.append((block, x))
                    waiting.append((_unpack_steps(x), _unpack(y, np.uint32).astype(np.int64), _unpack(z, np.uint8)))
                    if sum(len(v[0]) for v in waiting) > 1_000_000:
                        merge()
                else:
                    one = _unpack(x, np.int32).astype(np.int64)
                    table = one if table is None else table + one
            yield _record(rows)
        merge()
        rows = []
        stats(rows)
        yield _record(rows)
    counts = parts.filter(F.col("kind").isin(_COUNT, _TABLE))
    rows = counts.repartition("bucket").sortWithinPartitions("bucket", "kind", "block")
    return stored(rows.mapInArrow(run, _PARTS))


def _key_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Cuts of ascending pair keys into buckets (a power of two) by their highest bits."""
    shift = np.uint64(CONTEXT_BITS + WORD_BITS - (buckets.bit_length() - 1))
    return np.searchsorted(keys >> shift, np.arange(buckets + 1).astype(np.uint64))


def _pair_totals(parts: DataFrame, buckets: int) -> DataFrame:
    """Corpus counts of every block's word pairs and of their contexts, per bucket of contexts."""
    def send(batches):
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                docs_of = pa.ipc.open_stream(x).read_all().combine_chunks()
                t = Tokens(*utf8(docs_of.column(1)))
                train = ~docs_of.column(2).combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
                # The lowest bit marks training texts, so one sort gives keys and counts.
                marked = np.sort((t.pairs() << np.uint64(1)) | train[t.doc][~t.is_end].astype(np.uint64))
                keys = marked >> np.uint64(1)
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
                keys, count = keys[first], np.add.reduceat(marked & np.uint64(1), first).astype(np.uint32)
                cuts = _key_edges(keys, buckets)
                rows = [(_PAIR, block, i, _pack_steps(keys[a:b]), _pack(count[a:b]), None)
                        for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
                if rows:
                    yield _record(rows)

    def answer(batches):
        def merged(bucket, held):
            keys, place = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
            count = np.bincount(place, np.concatenate([c for _, _, c in held]), minlength=len(keys)).astype(np.int64)
            of = keys >> np.uint64(WORD_BITS)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            context = np.repeat(np.add.reduceat(count, first), np.diff(np.append(first, len(of))))
            a = 0
            for block, k, _ in held:
                at = place[a: a + len(k)]
                a += len(k)
                yield _record([(_PAIR, block, bucket, _pack(count[at].astype(np.uint32)),
                                _pack(context[at].astype(np.uint32)), None)])
        bucket, held = None, []
        for batch in batches:
            for b, block, x, y in zip(*[batch.column(n).to_pylist() for n in ("bucket", "block", "a", "b")]):
                if b != bucket:
                    if held:
                        yield from merged(bucket, held)
                    bucket, held = b, []
                held.append((block, _unpack_steps(x), _unpack(y, np.uint32)))
        if held:
            yield from merged(bucket, held)
    texts = parts.filter(F.col("kind") == _TEXT).select("block", "a")
    return stored(texts.mapInArrow(send, _PARTS).repartition("bucket").sortWithinPartitions("bucket", "block")
                  .mapInArrow(answer, _PARTS))


def score(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte`` of every row of ``docs`` (columns ``doc_id, text``)."""
    parts = _blocks(docs, buckets)
    totals = _totals(parts)
    pair_buckets = BUCKETS           # of four blocks each or less
    while pair_buckets * 4 < parts.filter(F.col("kind") == _TEXT).count():
        pair_buckets *= 2
    pairs = _pair_totals(parts, pair_buckets)
    # Fixed-size results: class totals and one table, in as many rows as buckets.
    stat = totals.filter(F.col("kind") == _STAT).select("a", "b", "c").collect()
    long = lambda b: np.frombuffer(bytes(b), np.int64)                   # noqa: E731
    class_tokens = sum((long(r["a"]) for r in stat), np.zeros(256, np.int64))
    class_once = sum((long(r["b"]) for r in stat), np.zeros(256, np.int64))
    kept = totals.filter(F.col("kind") == _TABLE).orderBy("bucket").select("a").collect()
    size = 65536 + 2 * CONTEXTS * 256
    table = np.concatenate([_unpack(bytes(r["a"]), np.int64) for r in kept]) if kept else np.zeros(size + 65536, np.int64)
    ends = int(table[:65536].reshape(256, 256)[:, 0].sum())
    n_train = int(class_tokens.sum()) + ends
    distinct = int(sum(long(r["c"])[0] for r in stat)) + (ends > 0)
    packed = _pack(table)
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
              "score double, bits_per_byte double")

    def run(batches):
        tables = _unpack(packed, np.int64)
        model, spellings = Model(tables[:size], class_tokens, class_once), tables[size:].copy()
        denominator = np.log10(n_train + (distinct + 1))
        current, answers, follow = None, [], []
        for batch in batches:
            for kind, block, _, x, y, _ in zip(*[c.to_pylist() for c in batch.columns]):
                if block != current:
                    current, answers, follow = block, [], []
                if kind == _ANSWER:
                    answers.append(_unpack(x, np.int64))
                    continue
                if kind == _PAIR:
                    follow.append((_unpack(x, np.uint32), _unpack(y, np.uint32)))
                    continue
                docs_of = pa.ipc.open_stream(x).read_all().combine_chunks()
                data, off = utf8(docs_of.column(1))
                t = Tokens(data, off)
                inner = ~t.is_end
                c = np.full(len(t.word), ends, np.int64)
                if inner.any():
                    distinct_words, place = np.unique(t.word[inner], return_inverse=True)
                    of_block = np.concatenate(answers)
                    assert len(of_block) == len(distinct_words), "an answer for every word of the block"
                    c[inner] = of_block[place]
                pair, context = np.zeros((2, len(c)), np.int64)
                if inner.any():
                    keys, place = np.unique(t.pairs(), return_inverse=True)
                    of_block = [np.concatenate(x) for x in zip(*follow)]
                    assert len(of_block[0]) == len(keys), "an answer for every pair of the block"
                    pair[inner], context[inner] = of_block[0][place], of_block[1][place]
                n = len(t.count)
                got = model.score(t, c, pair, context)
                base = np.bincount(t.doc, np.log10(c + 1.0) - denominator, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [docs_of.column(0).combine_chunks(), docs_of.column(2).combine_chunks(), pa.array(t.count, pa.int64()),
                     pa.array(np.bincount(t.doc, c > 0, minlength=n).astype(np.int64)), pa.array(np.full(n, n_train, np.int64)),
                     pa.array(base), pa.array(got), pa.array((t.spelling_bits(c == 0, spellings) - got * np.log2(10)) / np.maximum(np.diff(off), 1))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                           "bits_per_byte"])
    work = parts.filter(F.col("kind") == _TEXT).select(F.lit(_PAIR + 1).alias("kind"), *_NAMES[1:]) \
        .unionByName(totals.filter(F.col("kind") == _ANSWER)).unionByName(pairs)
    return work.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(run, schema)


def op6_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: base and model scores of every document."""
    return score(read_table(spark, sf_dir, "documents"))
