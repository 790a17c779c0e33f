import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pricewise.llm import packing as P
from pricewise.llm.units import Units

from .helpers import DOCUMENT, document_rows


def plain_bins(lengths, capacity):
    """Piece-by-piece version: large pieces matched, the others best fit."""
    large = sorted((n for n in lengths if 3 * n > capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        mate = next((b for b in large if a + b <= capacity), None)
        if mate is not None:
            large.remove(mate)
        gaps.append(capacity - a - (mate or 0))
    for n in sorted((n for n in lengths if 3 * n <= capacity), reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 60))
def test_matching_equals_the_piece_by_piece_version(lengths, capacity):
    counts = {n: lengths.count(n) for n in set(lengths)}
    slots, bins = P.plan_bins(counts, capacity)
    assert bins == plain_bins(lengths, capacity)
    held = {}
    for n, first, bin0, per_bin, offset in slots.tolist():
        after = min([s[1] for s in slots.tolist() if s[0] == n and s[1] > first], default=counts[n])
        for i in range(after - first):
            held.setdefault(bin0 + i // per_bin, []).append((offset + i % per_bin * n, n))
    assert sorted(n for v in held.values() for _, n in v) == sorted(lengths)
    assert sorted(held) == list(range(bins))
    for parts in held.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= capacity


def test_the_table_of_slots_is_bounded_by_the_capacity():
    rng = random.Random(5)
    for top in (2048, 700, 60):
        for _ in range(3):
            slots, _ = P.plan_bins({n: rng.randrange(1, 10 ** 9) for n in range(1, top + 1)}, 2048)
            assert len(slots) < 40_000


def test_large_pieces_are_matched_optimally():
    # 1,000 of 1,200 and 1,000 of 848: one bin each pair; 683 is just large.
    assert P.plan_bins({1200: 1000, 848: 1000}, 2048)[1] == 1000
    assert P.plan_bins({683: 4, 682: 3}, 2048)[1] == 3
    assert P.plan_bins({2048: 7}, 2048)[1] == 7
    assert P.plan_bins({}, 2048)[1] == 0


TEXTS = ["Hello, world! it's 2024 &&& don't.", "", None, "  \n\t ", "<|endoftext|> x<|startoftext|>y", "Ñandú, ΣΊΣΥΦΟΣ İi ﬁ 漢字",
         "a\xa0b　c \x1cd\x1d e\x85f", "word " * 5000, "ÀÉÎõü, straße ÿ×÷ ªº µm", "x" * 9000, "école,, (é", "Hello, world! it's 2024 &&& don't.",
         "q?! \"quoted\" (paren) 'S 's can'T", "é" * 3000 + " z", "́ a ​ b c", "#" * 300]


@lru_cache
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(P.default_tokenizer())


def library(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, capacity):
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for d, t in enumerate(texts):
        ids = library(t)
        got = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(-(-len(ids) // capacity)))
        for r in got:
            part = ids[r.start: r.start + capacity]
            assert (r.start, r.length) == (r.piece * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    for parts in by_bin.values():
        end = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= capacity
    return len(by_bin)


@pytest.mark.parametrize("parts", [1, 4])
def test_pieces_and_places(spark, parts):
    df = spark.createDataFrame(document_rows(TEXTS), DOCUMENT).repartition(parts)
    rows = P.pack(df, P.default_tokenizer(), 64).collect()
    lengths = [len(library(t)[a: a + 64]) for t in TEXTS for a in range(0, len(library(t)), 64)]
    assert check(rows, TEXTS, 64) == plain_bins(lengths, 64)


def test_repeated_rows_null_ids_clashing_columns_and_whole_sequences(spark):
    rows = [(None, "a b c", "x")] * 30 + [(7, "a b c", "y")] * 30 + [(8, None, "z")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, length string").selectExpr(
        "doc_id", "text", "length", "1 AS _part", "2 AS sequence_id", "3 AS `offset`").repartition(3)
    packed = P.pack(df, P.default_tokenizer(), 16, with_ids=True)
    got = P.sequences(packed).collect()
    abc = library("a b c")
    assert len(got) == -(-60 // 4) + 1        # four of length 4 fill a sequence, the five empty ones one more
    assert sum(r.n_tokens for r in got) == 60 * 4 + 5 and all(r.n_tokens == len(r.ids) for r in got)
    assert sorted(i for r in got for i in r.ids) == sorted(abc * 60 + [0] * 5)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], DOCUMENT), P.default_tokenizer()).count() == 0


def test_remembered_units_stay_bounded():
    made = []
    u = Units(lambda many: (made.extend(many), [m.upper() for m in many])[1], keep=3)
    for batch in (["a", "b", "a"], ["c", "d" * 99, "a"], ["e", "a"], ["d" * 99], ["b"], ["f", "g", "h", "i"], ["b"]):
        assert u.rows(batch) == [x.upper() for x in batch]
        assert len(u.new) <= 3 and all(len(k) <= 64 for k in u.new)
    assert made.count("a") == 1 and made.count("d" * 99) == 2
