import numpy as np
import pyarrow as pa
import pytest

from pricewise.llm import common as C

from .helpers import shingles, words

TEXTS = ["Hello  world\n foo", "", None, "a", "  xé \x0b y z w q R ", "  b", "one two three four five six", "x" * 3000,
         "A B c d e f", "a b C D E F"]


@pytest.mark.parametrize("window", [1 << 20, 7])
def test_words_match_the_pattern(monkeypatch, window):
    monkeypatch.setattr(C, "WINDOW", window)
    data, off = C.utf8(pa.array(TEXTS, pa.string()))
    h, first, end, woff = C.words(data, off)
    assert np.diff(woff).tolist() == [len(words(t)) for t in TEXTS]
    seen = [bytes(data[a:b]).decode() for a, b in zip(first, end)]
    assert [s.lower() for s in seen] == [w for t in TEXTS for w in words(t)]
    names = {}
    for s, x in zip(seen, h.tolist()):
        assert names.setdefault(x, s.lower()) == s.lower()
    assert len(names) == len({s.lower() for s in seen})


def test_shingles_match_sets():
    data, off = C.utf8(pa.array(TEXTS, pa.string()))
    w, _, _, woff = C.words(data, off)
    sh, soff = C.shingles(w, woff)
    sets = [set(sh[a:b].tolist()) for a, b in zip(soff, soff[1:])]
    assert [len(s) for s in sets] == [len(shingles(t)) for t in TEXTS]
    assert sets[-1] == sets[-2] and not sets[0] & sets[6]


def test_slices_cover_a_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(TEXTS, pa.string())], names=["t"])
    parts = list(C.slices(batch, "t", 10))
    assert sum(p.num_rows for p in parts) == len(TEXTS)
    assert [x for p in parts for x in p.column(0).to_pylist()] == TEXTS
