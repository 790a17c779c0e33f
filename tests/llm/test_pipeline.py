import corpus_pipeline
from pricewise.llm import piece_codec, quality, source_mix, toxicity

from .helpers import DOCUMENT, groups, words
from .test_classifiers import LABEL, corpus

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, labels = corpus(240)
    rows = rows[:-2] + [(1000 + i, rows[i][1], "en", "src9", 1) for i in range(20)]
    spark.createDataFrame(rows, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABEL).write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    docs = spark.read.parquet(sf + "/documents.parquet")
    before = {tuple(r) for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == (COLUMNS if k < 4 else COLUMNS + ["ids"])
        out.write.parquet(str(tmp_path / f"stage{k}"))
        out = spark.read.parquet(str(tmp_path / f"stage{k}"))
        after = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
        assert set(after) <= before
        if name == "quality":
            m = quality.train(spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet"))
            good = {r.doc_id for r in quality.score(docs, m).collect() if r.quality_score >= quality.THRESHOLD}
            assert {r[0] for r in after} == good
        elif name == "toxicity":
            m = toxicity.train(spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet"))
            d = toxicity.Distance(m["ordinary"], m["toxic"])
            clean = {r[0] for r in before if toxicity.scores(m, [(r[1] or "").encode()], d)[0] < toxicity.THRESHOLD}
            assert {r[0] for r in after} == clean
        elif name == "dedup":
            want = groups([(r[0], r[1]) for r in before])
            assert sorted(r[0] for r in after) == sorted({c for _, c in want.values()})
        elif name == "mix":
            size = {}
            for r in before:
                size[r[3]] = size.get(r[3], 0) + len(words(r[1]))
            assert abs(sum(len(words(r[1])) for r in after) - sum(size.values())) <= 200 * len(size)
            assert all(after.count(r) <= source_mix.CAP for r in set(after))
        elif name == "encode":
            lib = piece_codec.codec(piece_codec.default_model())
            assert all(list(r.ids) == lib.encode(r.text or "") for r in out.collect())
        docs, before = out, set(after)
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
