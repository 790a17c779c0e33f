import random

import numpy as np

from pricewise.llm import near_dedup as N
from pricewise.llm.components import components

from .helpers import DOCUMENT, groups, resemblance, shingles


def corpus(seed=1):
    """Unrelated texts, exact copies, near copies at many distances, a passage that
    all of one part share, short texts, and a chain of small edits."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))     # noqa: E731
    text = lambda n: [word() for _ in range(n)]                                        # noqa: E731
    out = [" ".join(text(rng.randint(1, 80))) for _ in range(60)]
    base = text(60)
    for i in range(60):                                   # a large group of near copies
        t = base[:]
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(60)] = word()
        out.append(" ".join(t))
    passage = text(30)
    out += [" ".join(passage + text(40)) for _ in range(50)]
    chain = text(40)
    for i in range(8):
        chain = chain[:]
        chain[5 * i % 40] = word()
        out.append(" ".join(chain))
    out += ["", None, "  \n", "a", "A", "a b c d", "a b c d", out[0].upper(), out[1], out[1]]
    return out


def test_groups_agree_with_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 6)                     # several tree levels
    rows = list(enumerate(corpus()))
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, node string, label int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_dedup(df.repartition(4)).collect()}
    assert got == groups(rows)


def test_odd_rows(spark):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (2, "A b C d e f"), (None, "a b c d e f"), (9, None), (8, ""), (9, None),
            (None, "only here x y z"), (7, "x " * 4000)]
    out = N.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    comp = sorted(((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in out), key=str)
    assert comp == sorted([(3, 2, False, 2), (3, 2, False, 2), (2, 2, True, 2), (None, 2, False, 2), (9, 9, True, 0), (8, 8, True, 0),
                           (9, 9, True, 0), (None, None, True, 1), (7, 7, True, 1)], key=str)
    assert N.near_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tokens_estimate_resemblance():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 40, 3000):
        est, true = [], []
        for _ in range(20):
            pool = rng.integers(0, 2 ** 63, 2 * n, np.uint64)
            k = rng.integers(0, n + 1)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:k], pool[n:2 * n - k]]))
            t = N.minwise(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            est.append((t[0] == t[1]).mean())
            true.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert np.abs(np.array(est) - np.array(true)).max() < 0.22
        assert abs(np.mean(est) - np.mean(true)) < 0.05


def test_two_bit_sketches():
    t = np.array([[1] * 128, [1] * 64 + [2] * 64], np.int32)
    s = N.two_bits(t).view(np.uint64)
    x = s[0] ^ s[1]
    differ = sum(int(((v | (v >> np.uint64(1))) & np.uint64(0x5555555555555555))).bit_count() for v in x)
    assert differ == 64


def test_tree_number_follows_the_recall():
    assert N.trees_needed(0.9) < N.trees_needed(0.999) and N.trees_needed(0.9999, depth=1) < N.trees_needed(0.9999, depth=3)


def test_trees_follow_the_depth_and_pairs_their_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF", 4)
    monkeypatch.setattr(N, "MAX_DEPTH", 6)                # nodes are left there and compared in blocks
    asked, sizes = [], []
    needed, across = N.trees_needed, N._across
    monkeypatch.setattr(N, "trees_needed", lambda r, d=N.DESIGN_DEPTH: (asked.append(d), needed(r, d))[1])
    monkeypatch.setattr(N, "_across", lambda rows, bits: (sizes.append(rows.agg({"size": "max"}).first()[0] or 0),
                                                          across(rows, bits))[1])
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join(passage + [f"o{i}x{k}" for k in range(9)]) for i in range(40)]      # resemblance below 0.75
    texts += [t + " z" for t in rng.sample(texts, 5)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_dedup(df, 0.9).collect()} == groups(rows)
    assert max(asked) > N.DESIGN_DEPTH and max(sizes) > N.LEAF


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 140)] + [(0, i) for i in range(1, 30)] + [(5, 5), (0, 1), (200, 201), (201, 202)]
    edges += [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}

    def root(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x
    for a, b in edges:
        if a != b:
            least[max(root(a), root(b))] = min(root(a), root(b))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(got) == nodes
    assert all((got[a] == got[b]) == (root(a) == root(b)) for a in nodes for b in nodes)
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    texts = corpus(2)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCUMENT)
    out = N.keep_one(spark, df, "").collect()
    want = groups(list(enumerate(texts)))
    assert sorted(r.doc_id for r in out) == sorted({c for _, c in want.values()})
    assert resemblance(shingles(texts[0]), shingles(texts[1])) < 0.75


def test_stage_keeps_one_row_a_component(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long + " end"), (5, "something else entirely here now"), (5, long),           # 5 repeats, one row near 1
            (7, "q r s t u v"), (7, "Q r s  t u v"), (None, "q r s t u v"),                     # equal sets
            (None, "m " + long[::-1]), (None, "n " + long[::-1]),                               # near copies without ids
            (None, "only here x y z"), (None, "only here x y z"), (9, ""), (9, ""), (None, None)]
    df = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCUMENT)
    out = N.keep_one(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert [d for d, _ in got if d] == [1, 5, 7, 9] and len(got) == 7
    assert (1, long + " end") in got and (5, "something else entirely here now") in got
    assert (None, "only here x y z") in got and (None, None) in got
    assert sum(t in ("m " + long[::-1], "n " + long[::-1]) for _, t in got) == 1


def test_a_node_of_many_copies_gives_members_and_a_forest(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(40)]       # every pair is linked
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = N._sketch(docs).cache()
    rows = known.selectExpr("0L AS path", "node", "node AS label", "40L AS size")
    members = N._across(rows, N._bits(known)).cache()
    assert members.count() == 40                          # not 780 pairs
    reps = known.selectExpr("node", "_id AS _rep")
    links = N._joined(members, N._full_sets(members.select("node"), reps, docs)).collect()
    assert len(links) == 39 and len({x for r in links for x in (r.a, r.b)}) == 40
    sets = [np.array([1, 2, 3], np.int64), np.array([2, 3, 9], np.int64), np.array([7], np.int64)]
    assert N._overlaps(sets)[~np.eye(3, dtype=bool)].tolist() == [2, 0, 2, 0, 0, 0]


def test_a_node_of_many_copies_is_joined_in_little_memory():
    import tracemalloc
    rng = np.random.default_rng(4)
    n = 1500
    base = np.arange(400)
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 400, 2)), [1000 + i]])) for i in range(n)]
    size = np.array([len(x) for x in sets], np.int64)
    label = rng.integers(0, 900, n)
    tracemalloc.start()
    links = N._forest(N._overlaps(sets), size, label, None)           # every pair is linked: a million
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert len(links) == len(set(label.tolist())) - 1


def test_the_forest_joins_what_all_pairs_join():
    rng = random.Random(9)
    for two in (False, True):
        for _ in range(60):
            n = rng.randint(1, 14)
            sets = [np.array(sorted(rng.sample(range(8), rng.randint(5, 8)))) for _ in range(n)]
            label = np.array([rng.randint(0, n) * 10 for _ in range(n)])
            block = np.array([rng.randint(0, 1) for _ in range(n)])
            size = np.array([len(x) for x in sets], np.int64)
            pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if label[a] != label[b] and (not two or block[a] != block[b])
                     and 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))]

            def parted(links):
                of = {int(x): {int(x)} for x in label}
                for a, b in links:
                    whole = of[int(label[a])] | of[int(label[b])]
                    of.update((x, whole) for x in whole)
                return {frozenset(x) for x in of.values()}
            got = N._forest(N._overlaps(sets), size, label, block if two else None)
            assert set(got) <= set(pairs) and parted(got) == parted(pairs)
            assert len(got) == len(set(label.tolist())) - len(parted(pairs))


def test_members_that_meet_in_many_paths_are_compared_once(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1:]) for i in range(12)]       # every pair is linked
    texts += [" ".join(f"y{i}" for i in range(k, k + 60)) for k in (0, 1)]            # a cluster of its own
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = N._sketch(docs).cache()
    rows = known.selectExpr("explode(sequence(0L, 9L)) AS path", "node", "node AS label", "14L AS size")
    members = N._across(rows, N._bits(known)).cache()
    assert members.count() == 14                          # not 140
    assert sorted(r["count"] for r in members.groupBy("cluster").count().collect()) == [2, 12]
    sets = N._full_sets(members.select("node").distinct(), known.selectExpr("node", "_id AS _rep"), docs)
    assert N._joined(members, sets).count() == 12


def test_clusters_are_the_components_of_their_pairs():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n = int(rng.integers(1, 30))
        pairs = rng.integers(0, n, (int(rng.integers(0, 40)), 2))
        at = np.arange(n)
        for part in np.array_split(pairs, 3):
            at = N._merged(at, part[:, 0], part[:, 1])
        least = list(range(n))
        for _ in range(n):
            for a, b in pairs.tolist():
                least[a] = least[b] = min(least[a], least[b])
        assert at.tolist() == least
        met, node = np.isin(np.arange(n), pairs), rng.permutation(n).astype(np.int64)
        own, names = N._clusters(at, met, node, np.full(n, -1, np.int64))
        assert sorted(own.tolist()) == np.flatnonzero(met).tolist()
        assert len(set(zip(at[own].tolist(), names.tolist()))) == len(set(names.tolist())) == len(set(at[own].tolist()))


def test_a_group_of_near_copies_is_compared_without_branching(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(1500):                                 # alike, most pairs below 0.75
        t = base[:]
        for k in rng.sample(range(40), rng.choice([1, 1, 2])):
            t[k] = f"x{i}"
        texts.append(" ".join(t))
    seen = []
    across = N._across
    monkeypatch.setattr(N, "_across", lambda rows, bits: (seen.append(rows.agg({"size": "max"}).first()[0] or 0),
                                                          across(rows, bits))[1])
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_dedup(df).collect()} == groups(rows)
    assert len(seen) == 1
