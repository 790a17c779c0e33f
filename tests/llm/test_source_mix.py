import pytest

from pricewise.llm import source_mix as M

from .helpers import DOCUMENT, words


def rows():
    out = []
    for s, n, size in (("a", 30, 4), ("b", 3, 2), ("ü", 40, 9), (None, 10, 3), ("c", 5, 0)):
        out += [(len(out) + i, " ".join(["w"] * (size + i % 3 if size else 0)), "en", s, 1) for i in range(n)]
    out += [out[0], out[0], (None, "x y z", "en", "a", 1), (500, None, "en", "b", 1)]
    return out


def targets(data):
    size = {}
    for _, t, _, s, _ in data:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = set()
    while True:
        free = sum(size.values()) - sum(3 * size[s] for s in capped)
        rest = sum(w[s] for s in order if s not in capped)
        share = {s: 3 * size[s] if s in capped else free * w[s] / rest for s in order}
        over = {s for s in order if share[s] > 3 * size[s]}
        if not over:
            return size, share
        capped |= over


def test_targets_and_taken_words(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, DOCUMENT).withColumnRenamed("lang", "size")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = M.op9_source_mix(spark, str(tmp_path)).collect()
    again = M.op9_source_mix(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    size, share = targets(data)
    assert len(got) == len(data)
    source = {d: s for d, _, _, s, _ in data}
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == size[s] and r.target == pytest.approx(share[s])
        assert 0 <= r.taken <= 3 * r.size
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
        taken[s] = taken.get(s, 0) + r.taken
    for s in size:
        assert abs(taken[s] - share[s]) <= 0.5 + 1e-6


def test_small_buckets_give_the_same_plan(spark, monkeypatch):
    sizes = M._sized(spark.createDataFrame(rows(), DOCUMENT))
    key = lambda df: sorted(map(str, M.with_taken(M.plan(df)).drop("_no_source").collect()))     # noqa: E731
    whole = key(sizes)
    monkeypatch.setattr(M, "BUCKET_ROWS", 1)
    assert key(sizes) == whole


def test_mixture_repeats_whole_rows_in_order(spark):
    data = rows()
    out = M.mixture(spark.createDataFrame(data, DOCUMENT))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    got = [tuple(r) for r in out.collect()]
    size, share = targets(data)
    assert set(got) <= set(data)
    biggest = {s: max(len(words(t)) for _, t, _, x, _ in data if x == s) for s in size}
    for s in size:
        mine = [r for r in got if r[3] == s]
        assert abs(sum(len(words(r[1])) for r in mine) - share[s]) <= biggest[s]
        for r in set(mine):
            assert mine.count(r) <= 3 * data.count(r)


def test_position_inverts_the_demand(spark):
    df = spark.range(101).selectExpr("id / 100 * 50 AS y", "cast(id % 3 AS int) AS cls").withColumn("t", M.position(
        M.F.col("y"), M.F.lit(50.0), M.F.col("cls")))
    for r in df.collect():
        s = M.SLOPES[r.cls]
        assert 50 * ((1 - s) * r.t + s * r.t ** 2) == pytest.approx(r.y, abs=1e-9)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    assert M.op9_source_mix(spark, str(tmp_path)).count() == 0
    assert M.mixture(spark.createDataFrame([], DOCUMENT)).count() == 0


def test_query_reads_its_rows_from_the_sequence(spark, tmp_path, monkeypatch):
    """Words and positions come from the texts of the training sequence, in its order."""
    data = rows()
    spark.createDataFrame(data, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seq = M.sequence(docs, M.stored(M._sized(docs)))
    at = [r._m_position for r in seq.collect()]
    assert at == sorted(at) and len(at) > 0
    got = M.op9_source_mix(spark, str(tmp_path)).collect()
    assert sum(r.taken for r in got) == sum(len(words(r.text)) for r in seq.collect())
    cut = [r for r in seq.collect() if r._m_cut is not None]
    assert cut and all(len(words(r.text)) == r._m_cut < len(words(data[r.doc_id][1])) for r in cut if r.doc_id is not None)
    right = M.sequence
    monkeypatch.setattr(M, "sequence", lambda *args: right(*args).filter("doc_id > 20"))
    less = {r.doc_id: r for r in M.op9_source_mix(spark, str(tmp_path)).collect() if r.doc_id is not None}
    assert len(less) > 20 and all(r.taken == 0 and r.position is None for d, r in less.items() if d <= 20)
