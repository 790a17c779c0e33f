import hashlib

import numpy as np
import pytest

from pricewise.llm import fingerprints as P

from .helpers import DOCUMENT, document_rows, resemblance, shingles

ROWS = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "x y"), (7, None), (3, ""), (3, "hello there all of you people"),
        (None, "q r"), (12, "one two three four five six seven eight nine ten"), (4, "é🙂 " * 9)]


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(t) // 3
        e = t[:len(t) - m] + nxt[:m]
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), resemblance(shingles(t), shingles(e)),
                    resemblance(shingles(t), shingles(nxt)), float(len(shingles(t)))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


@pytest.mark.parametrize("rows,bucket", [(ROWS, 1), (ROWS, 3), (ROWS, 100), (ROWS[:1], 1), ([(None, "x y"), (None, "z")], 1)])
def test_neighbours_agree_with_brute_force(spark, rows, bucket):
    df = spark.createDataFrame([(d, t, 9) for d, t in rows], "doc_id long, text string, _bucket int")
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next, r.n_shingles)
           for r in P.compare_with_next(df, bucket_docs=bucket).collect()]
    got.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):          # small sets: the sketches are exact
        assert g[3:] == pytest.approx(w[3:])


def test_empty_table(spark):
    assert P.compare_with_next(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_estimates():
    rng = np.random.default_rng(1)
    text = lambda ids: " ".join(f"w{i}" for i in ids)          # noqa: E731
    a = rng.integers(0, 10 ** 9, 6000).tolist()
    b = a[:4500] + rng.integers(0, 10 ** 9, 1500).tolist()
    sa, sb = P.sketches([text(a), text(b)])
    true = resemblance(shingles(text(a)), shingles(text(b)))
    assert abs(P.resemblance(sa, sb) - true) < 0.15
    assert abs(P.distinct_count(sa) / 5996 - 1) < 0.3
    assert abs(P.containment(sa, sb) - 0.75) < 0.2
    part = P.sketches([text(a[:3004]), text(a[3000:])])
    assert (P.merge_two(*part) == sa).all()
    assert (P.from_text(P.to_text(sa)) == sa).all()


def test_merge_by_key(spark):
    texts = [f"{i} b c d {i % 5} f g h {i}" for i in range(60)]
    df = spark.createDataFrame(document_rows(texts), DOCUMENT).repartition(5)
    prints = P.fingerprint(df).join(df.select("doc_id", "source"), "doc_id")
    got = {r.source: r.fingerprint for r in P.merge(prints, "source").collect()}
    for s in range(3):
        union = np.unique(np.concatenate(P.sketches([t for i, t in enumerate(texts) if i % 3 == s])))[:P.K]
        assert (P.from_text(got[f"src{s}"]) == union).all()
