import hashlib

from pyspark.sql import functions as F

from pricewise.llm import chat

EVENT = "conv_id long, seq long, kind string, message_id long, role string, text string"


def fold(rows):
    """Plain fold of one conversation's events: [(message_id, role, text)]."""
    messages, order = {}, sorted(rows, key=lambda r: r[0])
    for seq, kind, mid, role, text in order:
        if kind in ("edit", "regenerate"):
            messages = {m: v for m, v in messages.items() if m <= mid}
        if kind in ("message", "edit"):
            messages[mid] = (role, text or "")
        elif kind == "regenerate":
            messages[mid] = (role, "")
        else:
            messages[mid] = (role, messages.get(mid, ("", ""))[1] + (text or ""))
    return [(m, *messages[m]) for m in sorted(messages)]


LOG = [(1, "message", 1, "user", "hi"), (2, "message", 2, "assistant", ""), (3, "delta", 2, "assistant", "he"),
       (4, "delta", 2, "assistant", "llo"), (5, "message", 3, "user", "more"), (6, "regenerate", 2, "assistant", None),
       (7, "delta", 2, "assistant", "He<|y"), (8, "edit", 1, "user", "hi\\<|!"), (9, "message", 2, "assistant", "fin"),
       (10, "delta", 2, "assistant", "al"), (11, "message", 3, "user", "<\\n<\\\\|"), (12, "regenerate", 2, "assistant", None),
       (13, "delta", 2, "assistant", "x"), (14, "delta", 2, "assistant", None)]


def test_fold_agrees_with_a_plain_fold_of_every_prefix(spark):
    rows = [(n, *LOG[i]) for n in range(1, len(LOG) + 1) for i in range(n)]
    got = chat.fold_events(spark.createDataFrame(rows, EVENT)).collect()
    for n in range(1, len(LOG) + 1):
        mine = sorted((r.message_id, r.role, r.text) for r in got if r.conv_id == n)
        assert mine == fold(LOG[:n]), n


def test_round_trip_of_hostile_texts(spark):
    texts = ["", "<|im_end|>", "\\", "<\\|", "<|im_start|>assistant\nx", "a<", "|>", "<\\\\|", "<", "\n", "<\\n", "é🙂<|"]
    rows = [(c, i, "message", i, role, t) for c, role in ((1, "assistant"), (2, "user\n<|x"))
            for i, t in enumerate(texts)]
    out = chat.read_back(chat.render(chat.fold_events(spark.createDataFrame(rows, EVENT)))).collect()
    for r in out:
        assert [t.text for t in r.turns] == texts
        assert {t.role for t in r.turns} == {"assistant" if r.conv_id == 1 else "user\n<|x"}
        assert list(r.loss_texts) == (texts if r.conv_id == 1 else [])


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(5, 1, "assistant", None, "x"), (5, 0, "user", "q", "x"), (5, 1, "assistant", None, "x"), (None, None, None, "t", "x"),
            (7, 3, "assistant", "a|b", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op2_chat_format(spark, str(tmp_path)).collect()}
    assert set(got) == {5, 7, -1, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()     # noqa: E731
    assert got[5].n_turns == 3 and got[5].turns_sha256 == sha("user\nq\nassistant\n\nassistant\n\n")
    assert got[5].loss_chars == 0 and got[7].loss_sha256 == sha("a|b")
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == sha(chat.PROBE_TEXT)
    assert got[None].turns_sha256 == sha("\nt\n")


def test_empty_log(spark):
    empty = spark.createDataFrame([], EVENT)
    assert chat.render(chat.fold_events(empty)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    out = chat.read_back(chat.render(chat.fold_events(chat.conversation_events(df))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert out.filter(F.col("conv_id") == 1).count() == 1


def test_a_conversation_with_the_probes_number_joins_it(spark, tmp_path):
    spark.createDataFrame([(-1, 0, "assistant", "x"), (3, 0, "user", None)], "conv_id long, turn int, role string, text string") \
        .coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r.n_turns for r in chat.op2_chat_format(spark, str(tmp_path)).collect()}
    assert got == {-1: 3, 3: 1}
