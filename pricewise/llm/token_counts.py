"""Operator 7: greedy word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with two roots, one for pieces that begin a word and
one for pieces that continue it. A node's failure link leads to where matching
goes on when no child fits, and ``pops`` is the number of pieces emitted on the
way; both are found once, breadth first. A word is then read once, left to
right, adding ``pops`` along failure links: its greedy longest-match length comes
out without any piece being built. A word that cannot be covered counts as one
unknown piece, as in word-piece tokenisation.

Words are ``[^\\x20\\x09-\\x0D]+``; case is kept. The vocabulary comes from a piece
model whose word-initial pieces carry a space mark (a parameter).

Defined cases: null, empty and blank texts have 0 words and 0 tokens; repeated
rows are counted each; a null id is passed on; other columns are ignored; an empty table gives no rows;
words of any length are read in linear time.

Scale: one map, no shuffle; per worker the automaton and a bounded cache.
"""

from __future__ import annotations

import gc
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, utf8
from .piece_codec import MARK, Remembered, default_model

_UNKNOWN = 1 << 40               # added to a word's length if it is unknown


def word_pieces(path: str) -> tuple[list[str], list[str]]:
    """(word-initial pieces, continuing pieces) of a piece model."""
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    first, inner = [], []
    for i in range(lib.get_piece_size()):
        if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i):
            continue
        p = lib.id_to_piece(i)
        if p[:1] == MARK and len(p) > 1 and MARK not in p[1:]:
            first.append(p[1:])
        elif MARK not in p:
            inner.append(p)
    return first, inner


class Automaton:
    """Trie with failure links and counts of popped pieces."""

    ROOT, INNER = 0, 1

    def __init__(self, first: list[str], inner: list[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        for root, pieces in ((self.ROOT, first), (self.INNER, inner)):
            for p in pieces:
                u = root
                for c in p:
                    v = self.child[u].get(c)
                    if v is None:
                        v = self.child[u][c] = len(self.child)
                        self.child.append({})
                        piece.append(False)
                    u = v
                piece[u] = u != root
        n = len(self.child)
        self.fail, self.pops = [-1] * n, [0] * n
        level = [self.ROOT, self.INNER]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if piece[v]:
                        self.fail[v], self.pops[v] = self.INNER, 1
                        continue
                    z, popped = self.fail[u], self.pops[u]
                    while z >= 0 and c not in self.child[z]:
                        popped += self.pops[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.pops[v] = self.child[z][c], popped
            level = below
        self.length = Remembered(self.measure)

    def measure(self, word: bytes) -> int:
        """Pieces of a word, or 1 + ``_UNKNOWN``."""
        child, fail, pops = self.child, self.fail, self.pops
        u, count = self.ROOT, 0
        for c in word.decode():
            v = child[u].get(c)
            while v is None:
                count += pops[u]
                u = fail[u]
                if u < 0:
                    return 1 + _UNKNOWN
                v = child[u].get(c)
            u = v
        while u != self.INNER:           # the word ends: pop what is matched so far
            count += pops[u]
            u = fail[u]
            if u < 0:
                return 1 + _UNKNOWN
        return count


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(*word_pieces(path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_tokens, n_unknown`` of every row."""
    def run(batches):
        length = automaton(model_path).length.__getitem__
        gc.disable()
        for batch in batches:
            for part in slices(batch, "_text"):
                data, off = utf8(part.column(1))
                data = data.tobytes()
                n_words, total = [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                    ws = data[a:b].split()       # ASCII white space only, for bytes
                    n_words.append(len(ws))
                    total.append(sum(map(length, ws)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_words, pa.int64()), pa.array([t % _UNKNOWN for t in total], pa.int64()),
                     pa.array([t // _UNKNOWN for t in total], pa.int64())],
                    names=["_id", "n_words", "n_tokens", "n_unknown"])
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return (src.mapInArrow(run, f"_id {kind}, n_words long, n_tokens long, n_unknown long")
            .withColumnRenamed("_id", id_col))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word-piece lengths of every document."""
    return token_counts(read_table(spark, sf_dir, "documents"), default_model())
