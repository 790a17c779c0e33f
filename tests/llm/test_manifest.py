import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from pricewise.llm import manifest as M

from .helpers import DOCUMENT


def h(*nodes):
    return sha256("".join(nodes).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    value = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"       # noqa: E731
    return h(value(doc_id), value(source), value(lang), value(n_chars), value(text))


def tree(nodes, fanout):
    """(top, proof of every node as [(place, others)])"""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j in range(len(proofs)):
            run = nodes[at[j] // fanout * fanout:][:fanout]
            i = at[j] % fanout
            proofs[j].append((i, run[:i] + run[i + 1:]))
            at[j] //= fanout
        nodes = [h(*nodes[a: a + fanout]) for a in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows, fanout=3):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in names:
        members = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        tops[s] = (members, *tree([leaf(*r) for r in members], fanout))
    root, above = tree([tops[s][1] for s in names], fanout)
    for s, upper in zip(names, above):
        members, sub, proofs = tops[s]
        for r, low in zip(members, proofs):
            steps = low + upper
            changed = list(r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                changed[1] = r[1].replace("\n", "")
            node = leaf(*changed)
            for i, others in steps:
                node = h(*others[:i], node, *others[i:])
            out.append((r[0], leaf(*r), sub, root, h(*[x for _, o in steps for x in o]), node, node == root))
    return sorted(out, key=repr)


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, DOCUMENT).withColumn("_group", F.lit(1)).withColumn("leaf", F.lit("x")).repartition(4)
    cols = [F.col(c) for c in M.FIELDS]
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    claimed = F.when(hit, M.leaf(*cols[:-1], F.translate("text", "\n", "")))
    got = M.manifest(df, "doc_id", "source", M.leaf(*cols), claimed, **how)
    return got


def table(n, sources):
    return [(i, f"line {i}\nmore é {i}" if i % 3 else f"line {i}", "en", sources(i), i) for i in range(n)]


@pytest.mark.parametrize("n,sources,levels,fanout", [
    (1, lambda i: "a", 1, 3), (2, lambda i: None, 1, 3), (4, lambda i: "ab"[i % 2], 1, 3),
    (200, lambda i: "big" if i % 2 else f"s{i % 14}", 1, 3), (85, lambda i: "one", 1, 3), (28, lambda i: f"s{i}", 1, 3),
    (130, lambda i: "é" if i % 5 else None, 2, 3), (100, lambda i: "z" if i > 20 else "a", 1, 2), (70, lambda i: "x", 0, 3)])
def test_agrees_with_plain_trees(spark, n, sources, levels, fanout):
    rows = table(n, sources)
    got = run(spark, rows, block_levels=levels, fanout=fanout).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, fanout)


def test_nulls_repeats_and_empty_texts(spark):
    rows = ([(None, None, None, None, None)] * 5 + [(3, "a\nb", "en", "s", 3)] * 40 + [(None, "\n", "en", "s", 1), (3, "", None, "s", 0)]
            + [(i, "x\n" * 3, "de", "", 6) for i in range(9)])
    got = run(spark, rows, block_levels=1).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_default_blocks_and_the_proofs_themselves(spark):
    rows = table(1900, lambda i: "hot" if i % 4 else f"s{i % 5}")
    got = run(spark, rows, with_proof=True).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == brute(rows)
    for r in got:
        steps = [(s.i, [x.encode() for x in s.h]) for s in r.proof]
        assert M.fold(r.leaf.encode(), steps).decode() == r.root and M.proof_digest(steps) == r.proof_sha256
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_empty_table(spark):
    assert run(spark, []).count() == 0


def test_round_sends_as_many_messages_as_there_are_siblings(spark):
    """Every block gets one message from each part beside its own, also from a short one."""
    n = 23
    state = spark.createDataFrame([(False, "g", b, n, h(str(b)), []) for b in range(n)],
                                  f"_none boolean, _group string, _block long, _n long, node string, proof {M.PROOF}")
    for r in range(3):
        state = M.exchange(state, r)
    rows = state.collect()
    assert {x.node for x in rows} == {tree([h(str(b)) for b in range(n)], 3)[0]}
    want = tree([h(str(b)) for b in range(n)], 3)[1]
    assert {x._block: [(s.i, list(s.h)) for s in x.proof] for x in rows} == dict(enumerate(want))


def test_every_row_is_folded_with_its_proof(spark, monkeypatch):
    """A proof with one wrong level verifies no row, also none that was left as it was."""
    right = M.upper_proofs

    def wrong(*args):
        level = F.array(F.struct(F.lit(0).alias("i"), F.array(F.lit(h("no sibling"))).alias("h"))).cast(M.PROOF)
        return right(*args).withColumn("proof", F.concat("proof", level))
    monkeypatch.setattr(M, "upper_proofs", wrong)
    rows = table(40, lambda i: "ab"[i % 2])
    got = run(spark, rows, block_levels=1).collect()
    assert len(got) == 40 and not any(r.verified or r.folded_root == r.root for r in got)
