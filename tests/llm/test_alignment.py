import random
from collections import Counter, defaultdict
from functools import lru_cache
from hashlib import sha256

import pytest

from pricewise.llm import alignment as A

from .helpers import DOCUMENT, document_rows


@lru_cache
def al():
    return A.Aligner(*A.default_models())


def whole(text):
    """Groups of a text by encoding it whole: cut wherever the prefix bytes agree."""
    if not text:
        return None
    want = (" " + text).encode()
    a = al().a.encode(" " + text, add_special_tokens=False).ids
    b = al().b.encode(text)
    xa, xb = [al().bytes_a[i] for i in a], [al().bytes_b[i] for i in b]
    if b"".join(xa) != want or b"".join(xb) != want:
        return None
    out, i, j, ga, gb, pa, pb = [], 0, 0, [], [], 0, 0
    while i < len(a) or j < len(b):
        if pa <= pb and i < len(a):
            ga.append(a[i])
            pa += len(xa[i])
            i += 1
        else:
            gb.append(b[j])
            pb += len(xb[j])
            j += 1
        if pa == pb:
            out.append((ga, gb))
            ga, gb = [], []
    return out


def brute(texts):
    groups = [whole(t) for t in texts]
    links = [Counter((x, y) for ga, gb in g or [] for x in ga for y in gb) for g in groups]
    count = Counter(p for n in links for p in n)
    top = defaultdict(int)
    for (x, _), c in count.items():
        top[x] = max(top[x], c)
    rows = []
    for d, (g, n) in enumerate(zip(groups, links)):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        rows.append((d, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), n.total(),
                     sum(m for p, m in n.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in n.items()),
                     sha256(said.encode()).hexdigest() if g else ""))
    return rows, groups


TEXTS = ["Hello world, it's a test.", "", None, "  two  spaces \n\n and\tlines \r\n x ", "has ▁ mark", "<|endoftext|> <s></s> <0x41>",
         "Ñandú 漢字かな 🙂👍🏽 ﬁ é", "Hello world, it's a test.", "x" * 400, "a\xa0b　c\x1c d \x85e", " lead", "trail ", " ", "\n",
         "don't we'll 1234 5.67e8 http://a.b/c?d=e", "word " * 300, "end▁"]


@pytest.mark.parametrize("parts,block", [(1, 1 << 20), (3, 60), (2, 1)])
def test_agrees_with_whole_texts(spark, parts, block):
    df = spark.createDataFrame(document_rows(TEXTS), DOCUMENT).repartition(parts)
    got = A.link_counts(df, *A.default_models(), block_bytes=block).collect()
    assert sorted(tuple(r) for r in got) == brute(TEXTS)[0]


def test_units_agree_with_whole_texts():
    rng = random.Random(3)
    bits = ["the", "of", "Éa", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "12", "漢", "🙂", "<", "▁", "\x1c", "\xa0", "x", "ing", "́", "​"]
    texts = ["".join(rng.choice(bits + [" "] * 8) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    want = brute(texts)[0]
    for r, w in zip(al().texts(texts), want):
        got = (r[0], r[1], r[2], len(r[4]), sha256(r[3].encode()).hexdigest()) if r else (0, 0, 0, 0, "")
        assert got == (w[1], w[2], w[3], w[4], w[7])


def test_groups_as_arrays_and_repeated_or_null_ids(spark):
    rows = [(None, "one two", 1), (None, "one two", 2), (5, None, 3), (5, "unaffable&&& x", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _block long").selectExpr("*", "'x' AS pairs", "1 AS n_a")
    got = [(r.doc_id, [(list(g.a), list(g.b)) for g in r.groups]) for r in A.groups(df, *A.default_models()).collect()]
    want = [(r[0], whole(r[1]) or []) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sums = A.link_counts(df, *A.default_models()).collect()
    per = brute([r[1] for r in rows])[0]
    assert sorted(((r.doc_id, *tuple(r)[1:]) for r in sums), key=repr) == sorted(
        ((rows[p[0]][0], *p[1:]) for p in per), key=repr)


def test_lexicon(spark):
    df = spark.createDataFrame(document_rows(["a b", "a b", "a c", None]), DOCUMENT)
    parts = A.aligned(df, *A.default_models())
    got = {(r.a, r.b): (r["count"], r.best) for r in A.pair_counts(parts, al().size_b).collect()}
    count = Counter(p for t in ("a b", "a b", "a c") for p in {(x, y) for ga, gb in whole(t) for x in ga for y in gb})
    assert {k: v[0] for k, v in got.items()} == count and all(v[1] for v in got.values())


def test_empty_table(spark):
    assert A.link_counts(spark.createDataFrame([], DOCUMENT), *A.default_models()).count() == 0
