import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricewise.llm import quality as Q
from pricewise.llm import toxicity as X

from .helpers import DOCUMENT

SYLL = ("er", "th", "on", "ing", "an", "re", "ou", "st", "ha", "nd")
LABEL = "doc_id long, quality int, toxic int, note string"


def corpus(n=700):
    rng = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        w = ["".join(rng.choice(SYLL) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(40, 160))]
        toxic, junk = i % 6 == 0, i % 7 == 3
        if toxic:
            for _ in range(max(3, len(w) // 15)):
                w.insert(rng.randrange(len(w)), rng.choice(("disgusting", "worthless", "pathetic", "vequille")))
        text = " ".join(x.upper() + "!!" if junk else x for x in w)
        rows.append((i, text, "en", f"src{i % 4}", len(text)))
        labels.append((i, int(not junk), int(toxic), "x"))
    rows += [(n, "", "en", None, None), (n + 1, None, None, "s", 0), (None, rows[0][1], "en", "s", 1), rows[0]]
    labels += [(None, 1, 1, "x"), (3, None, None, "x"), (n, 1, 0, "x")]
    return rows, labels


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows, labels = corpus()
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, LABEL).write.parquet(str(path / "labels.parquet"))
    return str(path), rows, {d: (q, t) for d, q, t, _ in labels[:-3]}


def test_toxicity_on_held_out_documents(spark, data):
    path, rows, truth = data
    out = X.op4_toxicity(spark, path).collect()
    assert len(out) == len(rows)
    by_text = {}
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id][1] for r in held) / len(held)
    assert right >= 0.95
    texts = {r[0]: r[1] or "" for r in rows}
    for r in out:
        by_text.setdefault(texts[r.doc_id], set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())        # the score depends on the text alone


def test_toxic_stage_keeps_columns_and_clean_rows(spark, data):
    path, rows, truth = data
    docs = spark.read.parquet(path + "/documents.parquet")
    out = X.keep_clean(spark, docs, path)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    clean = {d for d, (_, t) in truth.items() if not t}
    toxic = set(truth) - clean
    assert len(clean & kept) >= 0.97 * len(clean) and len(toxic & kept) <= 0.08 * len(toxic)


def test_dictionaries_find_planted_words():
    rng = random.Random(2)
    plain = [" ".join("".join(rng.choice(SYLL) for _ in range(3)) for _ in range(100)).encode() for _ in range(80)]
    bad = [p.replace(b" ", b" pathetic ", 6) for p in plain[:40]]
    ordinary, toxic = X.train_dictionaries(bad, plain[40:])
    assert b"pathetic" in toxic and b"pathetic" not in ordinary
    d = X.Distance(ordinary, toxic)
    assert d.features(bad[3])[2] > d.features(plain[60])[2]
    assert d.features(b"") == [0.0] * (3 + len(X.STEPS))


def test_dictionary_of_a_large_vocabulary():
    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(9))          # noqa: E731
    vocabulary = [word("bcdfgjklmpqvwxyz") for _ in range(300)]
    plain = [[word("aeiounrsth") for _ in range(60)] for _ in range(500)]
    bad = [" ".join(f"{a} {b}" for a, b in zip(p, rng.sample(vocabulary, 60))).encode() for p in plain[:300]]
    plain = [" ".join(p).encode() for p in plain]
    _, toxic = X.train_dictionaries(bad, plain[300:])
    assert sum(w.encode() in toxic for w in vocabulary) >= 0.95 * len(vocabulary)


def test_copies_count_once():
    doc = b"some text that is copied very often in the corpus"
    assert X._without_copies([doc, doc, doc + b"!", b"another document altogether, quite unlike"]) == \
        [doc, b"another document altogether, quite unlike"]


@pytest.mark.parametrize("labels", [[], [(0, 1, 1, "x")], [(0, 1, 0, "x"), (1, 1, 0, "x")]])
def test_without_both_classes(spark, tmp_path, labels):
    rows, _ = corpus(10)
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    assert len({r.score for r in X.op4_toxicity(spark, str(tmp_path)).collect()}) == 1
    out = Q.op3_quality(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) and all(r.kept for r in out)


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, "x")], [(0, 1, 1, "x")]])
def test_toxicity_rejects_nothing_unlearnt(spark, tmp_path, labels):
    rows, _ = corpus(10)
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert X.keep_clean(spark, docs, str(tmp_path)).count() == len(rows)
    assert {r.predicted for r in X.op4_toxicity(spark, str(tmp_path)).collect()} == {0}


def test_one_long_text_does_not_end_the_sample(spark, data, monkeypatch):
    path, rows, truth = data
    monkeypatch.setattr(X, "SAMPLE_BYTES", 1 << 20)
    docs, labels = spark.read.parquet(path + "/documents.parquet"), spark.read.parquet(path + "/labels.parquet")
    first = [r.id for r in spark.range(10_000, 60_000).filter("crc32(cast(cast(id AS string) AS binary)) % 4 != 2")
             .orderBy(F.xxhash64("id", F.lit(4))).limit(4).collect()]            # before all others in the sample
    long = spark.createDataFrame([(i, "word " * 300_000, "en", "s", 1) for i in first], DOCUMENT)
    more = spark.createDataFrame([(i, 1, i % 2, "x") for i in first], LABEL)
    assert "w" in X.train(docs.unionByName(long), labels.unionByName(more))


def test_a_repeated_id_gives_one_training_row(spark, data, monkeypatch):
    path, rows, truth = data
    labels = spark.read.parquet(path + "/labels.parquet")
    hot = next(d for d in sorted(truth) if d and spark.range(d, d + 1).select(~X.held_out("id")).first()[0])
    docs = spark.read.parquet(path + "/documents.parquet")
    again = spark.createDataFrame([(hot, f"text {i % 300}", "en", "s", 1) for i in range(900)] +
                                  [(50_000, "unlabelled", "en", "s", 1)] * 900, DOCUMENT)
    docs = docs.unionByName(again)
    seen = []
    monkeypatch.setattr(X, "train_dictionaries", lambda t, o, f=X.train_dictionaries: (seen.append(len(t) + len(o)), f(t, o))[1])
    assert "w" in X.train(docs, labels)
    assert max(seen) <= len(truth)
    picked = spark.createDataFrame([(hot, 1, 1), (50_000, -1, 2)], "doc_id long, _y int, _k long")
    assert [r[0] for r in Q._sampled_views(docs, picked)] == [1, 2]


def test_empty_documents_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 1, "x")], LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    assert X.op4_toxicity(spark, str(tmp_path)).count() == 0
    assert Q.op3_quality(spark, str(tmp_path)).count() == 0


def test_quality_on_held_out_documents(spark, data):
    path, rows, truth = data
    out = Q.op3_quality(spark, path).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.kept == bool(truth[r.doc_id][0]) for r in held) / len(held) >= 0.95
    good = [r for r in held if truth[r.doc_id][0]]
    assert sum(r.kept for r in good) / len(good) >= 0.97
    docs = spark.read.parquet(path + "/documents.parquet")
    stage = Q.keep_good(spark, docs, path)
    assert stage.columns == docs.columns


def test_co_training_hands_over_confident_labels():
    import numpy as np
    rng = np.random.default_rng(3)
    y = np.array([0.0, 1.0] * 10)
    make = lambda lab, n: lab[:, None] * 3 + rng.normal(size=(len(lab), n))          # noqa: E731
    truth = (np.arange(400) % 2).astype(float)
    a, b = make(y, 4), make(y, 3)
    pool = [make(truth, 4), make(truth, 3)]
    models = Q.co_train([a, b], y, pool, rounds=3, per_round=40, sure=0.9)
    for m, u in zip(models, pool):
        assert ((Q._p(m, u) >= 0.5) == (truth > 0)).mean() > 0.97


def test_features_of_odd_texts():
    texts = pa.array(["", None, "ab", "abc", "é\n\nX1,"], pa.string())
    batch = pa.RecordBatch.from_arrays([texts, pa.array(["en", None, "en", "zz", ""]), pa.array([None, "s", "s", "t", "u"], pa.string()),
                                        pa.array([0, None, 2, 3, 6], pa.int64())], names=["text", "lang", "source", "n_chars"])
    a, b = Q._views(batch)
    assert a.shape == (5, Q.CONTENT + Q.LAYOUT) and b.shape[0] == 5
    grams = a[:, :Q.CONTENT]
    assert grams[0].sum() == grams[1].sum() == grams[2].sum() == 0 and grams[3].sum() == pytest.approx(1.0)
    assert not (b != b).any()


def test_sources_with_a_common_beginning_are_told_apart():
    names = [f"site-{i:06d}" for i in range(64)] + [None]
    out = Q._bucket(pa.array(names), 4096)
    assert len({tuple(np.flatnonzero(r)) for r in out}) == 65 and out[-1, -1] == 1


def test_views_share_nothing():
    """Metadata features do not change with the text, content features not with the metadata."""
    a = pa.RecordBatch.from_pydict({"text": ["one Two 3", "x\ny"], "lang": ["en", None], "source": ["s", "t"], "n_chars": [9, None]})
    b = pa.RecordBatch.from_pydict({"text": ["other", ""], "lang": ["en", None], "source": ["s", "t"], "n_chars": [9, None]})
    c = pa.RecordBatch.from_pydict({"text": ["one Two 3", "x\ny"], "lang": ["de", "fr"], "source": ["u", None], "n_chars": [1, 2]})
    assert (Q._views(a)[1] == Q._views(b)[1]).all() and (Q._views(a)[0] == Q._views(c)[0]).all()


def test_null_ids_are_not_held_out_and_the_base_comes_from_all_texts(spark):
    df = spark.createDataFrame([(None, "x"), (1, "y")], "doc_id long, text string")
    assert all(r.h is not None for r in df.select(X.held_out().alias("h")).collect())
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))                    # noqa: E731
    shared = " ".join(word() for _ in range(30))
    texts = [" ".join(word() for _ in range(60)).encode() for _ in range(40)]
    for i in range(20, 40):                                                    # a passage of the later half
        texts[i] += b" " + shared.encode()
    grams, counts = X._frequencies(texts)
    base = X._covering(texts, grams, counts)
    assert len(base) <= X.BASE_BYTES and sum(shared[i:i + 20].encode() in base for i in range(0, len(shared) - 20, 20)) >= 5
