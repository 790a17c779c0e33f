import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from pricewise.llm import piece_codec as P
from pricewise.llm import token_counts as T

from .helpers import DOCUMENT, WORD, document_rows

PATH = P.default_model()
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", None, " ", "  two  spaces ", "tab\tand\nline", "▁mark ▁", "<s>x</s><0x0A>", "中文🙂", "x" * 5000, "a b", "a b",
       "ernd, onatth.", "%%% !!", "  "]


def test_ids_and_text_agree_with_the_library():
    c = P.codec(PATH)
    rng = random.Random(3)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("abthe  \n▁é<s>0xA\t中🙂,. ing") for _ in range(rng.randint(0, 16)))
                                      for _ in range(3000)]
    for t in texts:
        ids = LIB.encode(t)
        assert c.encode(t) == ids, t
        assert c.decode(ids) == LIB.decode(ids), t


def test_decoding_any_ids():
    c, rng = P.codec(PATH), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 6))]
        assert c.decode(ids) == LIB.decode(ids), ids
        lists = [ids, [], ids[::-1]]
        off = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        assert P._decode_batch(c, np.array(sum(lists, []), np.int32), off).to_pylist() == [LIB.decode(x) for x in lists]


def test_cache_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 4)
    c = P.PieceCodec(PATH)
    text = " ".join(f"w{i % 7}x" for i in range(50))
    assert c.encode(text) == LIB.encode(text)


@pytest.mark.parametrize("unit", ["ab" * 40, "th" * 24 + "e", "the" * 30])
def test_long_and_short_agendas_agree(unit):
    c = P.codec(PATH)
    assert c.encode(unit) == LIB.encode(unit)


def test_operator_on_odd_rows(spark):
    df = spark.createDataFrame(document_rows(ODD), DOCUMENT).withColumnRenamed("lang", "ids").withColumnRenamed("source", "decoded")
    got = {r.doc_id: r for r in P.digests(df, PATH).collect()}
    for i, t in enumerate(ODD):
        ids = LIB.encode(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
    assert P.compare_with_library(df, PATH).count() == 0
    back = P.decode(P.encode(df, PATH), PATH).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: LIB.decode(LIB.encode(t or "")) for i, t in enumerate(ODD)}
    whole = P.with_ids(df, PATH)
    assert whole.columns == ["doc_id", "text", "decoded", "n_chars", "ids"] and whole.count() == len(ODD)
    assert P.digests(df.limit(0), PATH).count() == 0


def test_word_piece_lengths_agree_with_the_tokenizers_library(spark):
    from tokenizers.models import WordPiece
    first, inner = T.word_pieces(PATH)
    vocab = {}
    for p in first + ["##" + p for p in inner] + ["[UNK]"]:
        vocab.setdefault(p, len(vocab))
    model = WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10 ** 6)
    rng = random.Random(5)
    texts = ODD + [" ".join("".join(rng.choice("abtheionr,.é中") for _ in range(rng.randint(1, 12))) for _ in range(40))
                   for _ in range(20)]
    got = {r.doc_id: r for r in T.token_counts(spark.createDataFrame(document_rows(texts), DOCUMENT), PATH).collect()}
    for i, t in enumerate(texts):
        ws = WORD.findall(t or "")
        pieces = [model.tokenize(w) for w in ws]
        assert (got[i].n_words, got[i].n_tokens) == (len(ws), sum(map(len, pieces))), t
        assert got[i].n_unknown == sum(p[0].value == "[UNK]" for p in pieces)
    assert T.token_counts(spark.createDataFrame([], DOCUMENT), PATH).count() == 0
