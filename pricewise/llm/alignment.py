"""Operator 12: alignment of two tokenizers over the same texts.

Both id lists spell the same bytes (a space and the text). Each side's cumulative
byte ends go to a dictionary from end to index; the ends both sides have, sorted,
slice the two lists into groups, and every pair of a group's tokens is a link.

Neither vocabulary merges over a single space between two other characters (checked
on loading; otherwise a whole text is one unit), so both sides end there, and a text's
groups are those of its units one after the other. Units repeat, so a worker encodes
and aligns each unit it does not remember once, by the two libraries.

A pair's count is the number of documents that hold it linked. Documents are handled
in blocks of about ``BLOCK_BYTES`` of text: a block asks for each of its distinct pairs
once, counts are added up by pair, and the answers return to the block, where every
document sums them over its links.

Defined cases: a null or empty text, and one whose bytes a side does not give back (it
holds U+2581, say), has no tokens: zeros and an empty digest, and no part in the counts;
special tokens' strings in a text are plain text; rows sharing an id, null ids and
repeated rows are documents of their own; an empty table gives no rows; other columns
are ignored. A long text is as many units as it has words; only one that has no spaces is
encoded in one piece.

Scale: texts are read and encoded once; what is kept is some bytes per distinct pair of
a document, compressed. Questions are one row per block and distinct pair, so a pair that
every document holds is asked once a block, and counts are added before they are shuffled.
The best count of an id is a window over its partners, at most the other vocabulary.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from hashlib import sha256
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import read_table, slices, written
from .units import Units

MODEL_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
MARK = "▁"                       # stands for a space in pieces
CUT = re.compile(r"(?<=\S) (?=\S)")
SLICE = 4 << 20                  # bytes of text handled at a time
BLOCK_BYTES = 16 << 20           # of text in a block
BLOCK_DOCS = 20_000
QUESTIONS = 4_096                # pairs in a stored row
KEEP = 120_000                   # remembered units
PUNCTUATION = ".,;:!?%$&*#|\")('"


def common_ends(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int]]:
    """How many tokens of either side lie before each end that both sides have."""
    at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))
    return [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]


class Aligner:
    """Two vocabularies and the aligned units a worker remembers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.size_a, self.size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = sorted(set(range(256)) - set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes_a = [b""] * self.size_a
        for piece, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in piece)
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.len_a, self.len_b = _sizes(self.bytes_a), _sizes(self.bytes_b)
        crosses = any(x != MARK and y == MARK for p in pieces for x, y in zip(p, p[1:]))
        before = str(self.a.pre_tokenizer)
        self.by_unit = not crosses and before.startswith("ByteLevel") and "use_regex=True" in before
        self.inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}      # neighbours that a piece may join
        self.said_a, self.said_b = [str(i) for i in range(self.size_a)], [str(i) for i in range(self.size_b)]
        self.units = Units(self._units, KEEP)
        self.cores = Units(self._cores, KEEP)
        self.tails = Units(self._tails, KEEP)

    def _rows(self, texts: list[str], many_a: list[list[int]], many_b: list[list[int]]) -> list[tuple]:
        """(tokens a, tokens b, groups, their text, packed pairs) of every text; nothing if a
        side does not give its bytes back. The texts are aligned as one: both sides end
        where a text does, so no group crosses from one to the next."""
        raw = [t.encode() for t in texts]
        flat_a, flat_b = list(chain.from_iterable(many_a)), list(chain.from_iterable(many_b))
        ids_a, ids_b = np.array(flat_a, np.int64), np.array(flat_b, np.int64)
        n_a, n_b = _sizes(many_a), _sizes(many_b)
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        at = np.cumsum(_sizes(raw))
        whole = b"".join(raw)
        if not (b"".join(map(self.bytes_a.__getitem__, flat_a)) == whole == b"".join(map(self.bytes_b.__getitem__, flat_b))
                and n_a.all() and n_b.all()
                and (ends_a[np.cumsum(n_a) - 1] == at).all() and (ends_b[np.cumsum(n_b) - 1] == at).all()):
            good = [i for i, (r, x, y) in enumerate(zip(raw, many_a, many_b))
                    if b"".join([self.bytes_a[k] for k in x]) == r == b"".join([self.bytes_b[k] for k in y])]
            out: list = [()] * len(texts)
            for i, row in zip(good, self._rows(*[[v[i] for i in good] for v in (texts, many_a, many_b)])) if good else ():
                out[i] = row
            return out
        common = common_ends(ends_a.tolist(), ends_b.tolist())
        x, y = np.array(common, np.int64).reshape(-1, 2).T
        p, q = np.diff(x, prepend=0), np.diff(y, prepend=0)      # tokens of a group on either side
        links = p * q
        group = np.repeat(np.arange(len(common)), links)
        k = np.arange(len(group)) - (np.cumsum(links) - links)[group]
        pairs = (ids_a[(x - p)[group] + k // q[group]] * self.size_b + ids_b[(y - q)[group] + k % q[group]]).tobytes()
        sa, sb = list(map(self.said_a.__getitem__, flat_a)), list(map(self.said_b.__getitem__, flat_b))
        said = [f"{sa[i - 1]}|{sb[j - 1]}" if n == m == 1 else f"{','.join(sa[i - n:i])}|{','.join(sb[j - m:j])}"
                for (i, j), n, m in zip(common, p.tolist(), q.tolist())]
        upto = np.searchsorted(ends_a[x - 1], at, "right")       # groups before each text's end
        linked = 8 * np.cumsum(links)[upto - 1]
        out, g, c = [], 0, 0
        for i, j, h, d in zip(n_a.tolist(), n_b.tolist(), upto.tolist(), linked.tolist()):
            out.append((i, j, h - g, ";".join(said[g:h]), pairs[c:d]))
            g, c = h, d
        return out

    def _library_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _cores(self, words: list[str]) -> list[tuple]:
        """Rows of units behind a space."""
        spaced = [" " + w for w in words]
        return self._rows(spaced, self._library_a(spaced), self.b.encode(words, num_threads=1)) if words else []

    def _tails(self, tails: list[str]) -> list[tuple]:
        """Rows of punctuation behind a letter that no piece joins it with."""
        behind = []
        for t in tails:
            letter = next((c for c in "abcdefghijklmnopqrstuvwxyz" if c + t[0] not in self.inside), None)
            ids = self.b.encode(letter + t) if letter else []
            first = self.b.encode(letter) if letter else []
            behind.append(ids[len(first):] if ids[:len(first)] == first else [])
        return self._rows(tails, self._library_a(tails), behind) if tails else []

    def _units(self, units: list[str]) -> list[tuple]:
        """Rows of units. Both sides end between a letter or digit and punctuation behind
        it if no piece joins the two, so such a unit is the two parts' rows."""
        cuts = []
        for u in units:
            c = u.rstrip(PUNCTUATION)
            m = len(c)
            cuts.append(m if 0 < m < len(u) and c[-1].isalnum() and u[m - 1:m + 1] not in self.inside else len(u))
        heads = self.cores.rows([u[:m] for u, m in zip(units, cuts)])
        cut = [i for i, (u, m) in enumerate(zip(units, cuts)) if m < len(u)]
        for i, t in zip(cut, self.tails.rows([units[i][cuts[i]:] for i in cut])):
            h = heads[i]
            heads[i] = (h[0] + t[0], h[1] + t[1], h[2] + t[2], f"{h[3]};{t[3]}", h[4] + t[4]) if h and t else ()
        whole = [i for i in cut if not heads[i]]         # a part that does not come back: try the unit itself
        for i, row in zip(whole, self._cores([units[i] for i in whole])):
            heads[i] = row
        return heads

    def texts(self, texts: list[str | None]) -> list[tuple | None]:
        """(tokens a, tokens b, groups, their text, pair of every link) of whole texts."""
        split = [CUT.split(t) if t and self.by_unit else [t] if t else [] for t in texts]
        rows = self.units.rows([u for units in split for u in units])
        out, at = [], 0
        for units in split:
            mine = rows[at: at + len(units)]
            at += len(units)
            if not all(mine) or not mine:
                out.append(None)
                continue
            a, b, g, said, pairs = zip(*mine)
            out.append((sum(a), sum(b), sum(g), ";".join(said), np.frombuffer(b"".join(pairs), np.int64)))
        return out


def _sizes(many) -> np.ndarray:
    return np.fromiter(map(len, many), np.int64, len(many))


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def default_models() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(MODEL_A), public_tokenizers.path(MODEL_B)


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, groups`` (array of ``a``, ``b``: the ids of either side) of every row."""
    def run(batches):
        _settle()
        al = aligner(path_a, path_b)
        for batch in batches:
            for part in slices(batch, "_text", SLICE):
                said = [r and r[3] for r in al.texts(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())], names=["_id", "_said"])
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    said = src.mapInArrow(run, f"_id {src.schema['_id'].dataType.simpleString()}, _said string")

    def side(g, k):
        return F.split(F.split_part(g, F.lit("|"), F.lit(k)), ",").cast("array<int>")
    cut = F.transform(F.split("_said", ";"), lambda g: F.struct(side(g, 1).alias("a"), side(g, 2).alias("b")))
    return said.select(F.col("_id").alias(id_col), F.coalesce(cut, F.array().cast("array<struct<a:array<int>,b:array<int>>>"))
                       .alias("groups"))


def _settle() -> None:
    """A task is one thread, and remembered rows are many small objects, none in cycles."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    gc.disable()


# ---------------------------------------------------------------- counts over the corpus

def aligned(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of two kinds. A document: ``_block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    links`` (distinct pairs and how often, packed). A block's questions: ``_block, pairs, docs``,
    its distinct pairs and the number of its documents that hold each."""
    src = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    kind = src.schema["_id"].dataType
    fields = ["_block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "docs"]
    kinds = [pa.int64(), to_arrow_type(kind), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.list_(pa.int64()),
             pa.list_(pa.int64())]

    def run(batches):
        import zstandard
        from pyspark import TaskContext
        _settle()
        al, pack = aligner(path_a, path_b), zstandard.ZstdCompressor(level=1).compress
        block, held, size, n_docs = TaskContext.get().partitionId() << 32, [], 0, 0

        def questions():
            codes, n = _added(held)
            for a in range(0, len(codes), QUESTIONS):
                cells = [[block], *[[None]] * 7, [codes[a: a + QUESTIONS]], [n[a: a + QUESTIONS]]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds)], names=fields)
        for batch in batches:
            for part in slices(batch, "_text", min(SLICE, block_bytes)):
                rows, seen = [], []
                for r in al.texts(part.column(1).to_pylist()):
                    if r is None:
                        rows.append((0, 0, 0, 0, "", None))
                        continue
                    codes, often = np.unique(r[4], return_counts=True)
                    seen.append(codes)
                    rows.append((*r[:3], len(r[4]), sha256(r[3].encode()).hexdigest(),
                                 pack(np.diff(codes, prepend=0).tobytes() + often.astype(np.int32).tobytes())))
                n = part.num_rows
                cols = [pa.array(np.full(n, block)), part.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds[2:8])],
                        pa.nulls(n, kinds[8]), pa.nulls(n, kinds[9])]
                yield pa.RecordBatch.from_arrays(cols, names=fields)
                if seen:
                    held = [_added([*held, *((c, np.ones(len(c), np.int64)) for c in seen)])]
                size += part.column(1).nbytes
                n_docs += n
                if size >= block_bytes or n_docs >= BLOCK_DOCS:
                    yield from questions()
                    block, held, size, n_docs = block + 1, [], 0, 0
        yield from questions()
    return src.mapInArrow(run, f"_block long, doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, "
                               "groups_sha256 string, links binary, pairs array<long>, docs array<long>")


def _added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of several sorted lists and their summed counts."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([n for _, n in held]), minlength=len(codes))
    return codes, n.astype(np.int64)


def pair_counts(parts: DataFrame, size_b: int) -> DataFrame:
    """``a, b, pair, count, best`` of every linked id pair: the documents that hold it, and
    whether no other pair of ``a`` has more. ``parts``: rows of ``aligned``."""
    asked = parts.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("_q"))
    counts = asked.groupBy(F.col("_q.pairs").alias("pair")).agg(F.sum("_q.docs").alias("count"))
    counts = counts.select(F.expr(f"pair div {size_b}").alias("a"), (F.col("pair") % size_b).alias("b"), "pair", "count")
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def link_counts(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document its token, group and link numbers, ``n_best`` (links whose pair no other
    pair of the same A id beats), ``count_sum`` (of the pairs' counts over its links) and
    the digest of its groups."""
    parts = written(aligned(docs, path_a, path_b, block_bytes))
    counts = pair_counts(parts, aligner(path_a, path_b).size_b)
    asked = parts.filter("pairs IS NOT NULL").select(F.col("_block").alias("_of"), F.explode("pairs").alias("pair"))
    told = asked.join(counts, "pair").select("_of", "pair", "count", "best")
    rows = parts.filter("pairs IS NULL").drop("pairs", "docs")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard
        unpack = zstandard.ZstdDecompressor().decompress
        pair = right.column("pair").to_numpy()
        order = np.argsort(pair)
        pair, count = pair[order], right.column("count").to_numpy()[order]
        best = right.column("best").to_numpy()[order].astype(bool)
        n_best, count_sum = [], []
        for z in left.column("links").to_pylist():
            if z is None:
                n_best.append(0)
                count_sum.append(0)
                continue
            raw = unpack(z)
            n = len(raw) // 12
            at = np.searchsorted(pair, np.cumsum(np.frombuffer(raw, np.int64, n)))
            often = np.frombuffer(raw, np.int32, n, 8 * n).astype(np.int64)
            n_best.append(int(often[best[at]].sum()))
            count_sum.append(int((often * count[at]).sum()))
        cols = [left.column(c) for c in names[:5]]
        return pa.table([*cols, pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()),
                         left.column("groups_sha256")], names=names)
    kind = parts.schema["doc_id"].dataType.simpleString()
    return rows.groupBy("_block").cogroup(told.groupBy("_of")).applyInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
             "groups_sha256 string")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: groups and links of every document."""
    return link_counts(read_table(spark, sf_dir, "documents"), *default_models())
