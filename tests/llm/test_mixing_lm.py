import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pricewise.llm import mixing_lm as L
from pricewise.llm.common import utf8

from .helpers import DOCUMENT, document_rows, words


def texts(n=90):
    rng = random.Random(9)
    out = []
    for i in range(n):
        syll = ("er", "th", "ing", "on") if i % 2 else ("qu", "ez", "al", "os")
        out.append(" ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 60))))
    return out + ["", None, out[0], "X" * 3000, "\n \t", "é 中 🙂"]


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, DOCUMENT).withColumnRenamed("lang", "kind").withColumnRenamed("source", "block")
    return L.score(df.repartition(parts)).collect()


def test_contract_columns_and_base_score(spark):
    rows = document_rows(texts())
    got = {r.doc_id: r for r in run(spark, rows)}
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2                # noqa: E731
    tokens = {d: words(t) + ["\n"] for d, t, *_ in rows}
    count = Counter(x for d in tokens if not held(d) for x in tokens[d])
    n, v = sum(count.values()), len(count)
    for d, ts in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(ts), sum(count[x] > 0 for x in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in ts))
        assert r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_partitioning_changes_nothing(spark, monkeypatch):
    rows = document_rows(texts())
    one = {r.doc_id: (r.score, r.base_score) for r in run(spark, rows, 1)}
    monkeypatch.setattr(L, "BLOCK_BYTES", 500)
    many = {r.doc_id: (r.score, r.base_score) for r in run(spark, rows, 5)}
    assert one.keys() == many.keys()
    for d in one:
        assert one[d] == pytest.approx(many[d], rel=1e-5)


def plain(model, t, c, segment):
    """The same model, one decision at a time."""
    total = np.zeros(len(t.count))
    for d in range(len(t.count)):
        for k, i in enumerate(range(t.off[d], t.off[d + 1])):
            if k % segment == 0:
                w = np.tile(np.array(L.WEIGHTS, np.float64), (2, 8, 1))
                state, unknown = model.s0[0].astype(float).copy(), 0.0
            cls, gate = int(t.cls[i]), int(model.known_context[t.two[i]])
            node, bits, before = 1, 0, state.copy()
            for j in range(8):
                bit = (cls >> (7 - j)) & 1
                x = np.array([model.s0[0, node], model.s1[t.c1[i], node], model.s2[t.two[i], node],
                              model.s3[t.prev[i], node], before[node]], float)
                p = 1 / (1 + math.exp(-max(-12, min(12, float(w[gate, j] @ x)))))
                bits += math.log(p if bit else 1 - p)
                w[gate, j] += L.RATE * (bit - p) * x
                state[node] += L.STATE_RATE * (bit - 1 / (1 + math.exp(-before[node])))
                node = 2 * node + bit
            total[d] += bits
            if cls:
                u = 1 / (1 + math.exp(-(model.unknown[cls] + unknown)))
                total[d] += math.log(u if c[i] == 0 else 1 - u)
                unknown += L.UNKNOWN_RATE * ((c[i] == 0) - u)
                if c[i]:
                    total[d] += math.log(c[i] / model.class_tokens[cls])
    return total / math.log(10)


def test_lanes_agree_with_a_sequential_run(monkeypatch):
    monkeypatch.setattr(L, "SEGMENT", 17)
    monkeypatch.setattr(L, "SEEN", 5)
    t = L.Tokens(*utf8(pa.array(texts(30), pa.string())))
    use = t.doc % 3 > 0
    count = Counter(t.word[use & ~t.is_end].tolist())
    c = np.array([30 if e else count[w] for e, w in zip(t.is_end.tolist(), t.word.tolist())])
    cls = {w: k for w, k in zip(t.word.tolist(), t.cls.tolist())}
    tokens, once = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for w, n in count.items():
        tokens[cls[w]] += n
        once[cls[w]] += n == 1
    model = L.Model(t.tables(use), tokens, once)
    assert model.score(t, c) == pytest.approx(plain(model, t, c, 17), rel=2e-4)


def test_bits_cover_unknown_words(spark):
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 7 == 2][:3]
    rng = random.Random(6)
    noise = " ".join("".join(chr(rng.randrange(97, 123)) for _ in range(400)) for _ in range(5))
    prose = [" ".join(rng.choice(("the", "cat", "sat", "on", "a", "mat")) for _ in range(60)) for _ in range(60)]
    rows = [(d, t, "en", "s", 1) for d, t in zip((d for d in range(1000) if zlib.crc32(str(d).encode()) % 7 != 2), prose)]
    rows += [(held[0], noise, "en", "s", 1), (held[1], prose[0], "en", "s", 1), (held[2], noise.upper(), "en", "s", 1)]
    got = {r.doc_id: r.bits_per_byte for r in run(spark, rows)}
    assert got[held[0]] > 4 and got[held[0]] == pytest.approx(got[held[2]])      # 26 letters at random: 4.7 bits
    assert got[held[1]] < 1.5


def test_weights_and_states_run_through_a_text():
    t = L.Tokens(*utf8(pa.array(["ab cd ef gh " * 200], pa.string())))
    use = np.ones(len(t.word), bool)
    c = np.full(len(t.word), 200)
    tokens = np.bincount(t.cls, minlength=256)
    model = L.Model(t.tables(use), tokens, np.zeros(256, np.int64))
    assert model.score(t, c) == pytest.approx(plain(model, t, c, 10 ** 9), rel=1e-3)


def test_class_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    s = L._stretch(rng.integers(0, 50, (1, 256)).astype(float), None)
    p = 1 / (1 + np.exp(-s[0].astype(float)))
    total = sum(np.prod(np.where(L.BIT[c] > 0, p[L.NODE[c]], 1 - p[L.NODE[c]])) for c in range(256))
    assert total == pytest.approx(1.0)


def test_empty_and_untrained(spark):
    assert L.score(spark.createDataFrame([], DOCUMENT)).count() == 0
    held = next(d for d in range(100) if zlib.crc32(str(d).encode()) % 7 == 2)
    r = run(spark, [(held, "a b c", "en", "s", 1)], 1)[0]
    assert (r.n_known, r.train_tokens, r.n_tokens) == (0, 0, 4) and math.isfinite(r.score) and r.base_score == 0.0
    r = run(spark, [(None, "a a", "en", "s", 1)], 1)[0]
    assert (r.held_out, r.n_known, r.train_tokens) == (False, 3, 3)


def test_the_word_before_predicts_the_word_within_its_class(spark):
    """Both orders have the same words and the same classes; only one stands in the training texts."""
    held = [d for d in range(400) if zlib.crc32(str(d).encode()) % 7 == 2][:2]
    rows = [(d, "red catzz blue dogzz " * 5, "en", "s", 1) for d in range(60) if zlib.crc32(str(d).encode()) % 7 != 2]
    rows += [(held[0], "red catzz blue dogzz " * 3, "en", "s", 1), (held[1], "red dogzz blue catzz " * 3, "en", "s", 1)]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[held[0]].n_known == got[held[1]].n_known == 13
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 1


def test_shares_of_known_words_add_up_to_one(spark):
    """Counts answered over all blocks equal plain counts, and a class's words share one probability."""
    data = texts(40)
    t = L.Tokens(*utf8(pa.array(data, pa.string())))
    use, inner = t.doc % 3 > 0, ~t.is_end
    plain_pairs = Counter(zip(t.before[inner & use].tolist(), t.word[inner & use].tolist()))
    contexts = Counter(zip(t.before[inner & use].tolist(), t.cls[inner & use].tolist()))
    keys, place = np.unique(t.pairs(), return_inverse=True)
    count = np.bincount(place, use[inner], minlength=len(keys))
    every = list(zip(t.before[inner].tolist(), t.word[inner].tolist(), t.cls[inner].tolist()))
    assert count[place].tolist() == [plain_pairs[b, w] for b, w, _ in every]
    by = Counter()
    for (b, w), n in plain_pairs.items():
        by[b, next(k for x, y, k in every if (x, y) == (b, w))] += n
    assert by == contexts


def test_pair_counts_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 300)
    rows = document_rows(["red catzz blue dogzz"] * 60 + texts(20))
    parts = L._blocks(spark.createDataFrame(rows, DOCUMENT).repartition(4), 64)
    for buckets in (64, 256):
        answers = L._pair_totals(parts, buckets).collect()
        n = sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in range(60))
        assert max(L._unpack(bytes(r.a), np.uint32).max() for r in answers) >= n
        assert all((L._unpack(bytes(r.a), np.uint32) <= L._unpack(bytes(r.b), np.uint32)).all() for r in answers)


def test_steps_take_less_room_than_the_numbers():
    x = np.unique(np.random.default_rng(4).integers(0, 2 ** 63, 20_000, np.uint64) * np.uint64(2))
    for part in (x, x[:1], x[:0], np.array([2 ** 64 - 1], np.uint64)):
        assert L._unpack_steps(L._pack_steps(part)).tolist() == part.tolist()
    assert len(L._pack_steps(x)) < 0.9 * len(L._pack(x))
