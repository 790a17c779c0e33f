"""Operator 1: near-duplicate groups by a chosen-path set similarity join.

Documents are sets of five-word shingles (words lower-cased; fewer words: the
whole sequence as one). Documents with equal sets form a class, represented
once. A fast similarity sketch gives ``T`` minwise tokens of every class: token i
of two classes is equal with probability their resemblance.

Search. A tree starts with all classes in one node. A node's path chooses one or
two of the ``T`` token positions (4/3 on average, the inverse of the threshold),
and a class moves on to the child named by each chosen position and its token
there. So two classes at the threshold meet again in one child on average
whatever the depth, while classes with little in common part at once. Trees are
independent; their number follows from the survival recurrence and
``TARGET_RECALL`` at ``DESIGN_DEPTH``, and if some node is settled only deeper, at the
depth reached: trees are added until they suffice for the deepest node.

Links. In every node each class is first compared with the node's smallest class
(so a large group of copies needs as many comparisons as it has members), links
are confirmed on the full sets and their components found. Nodes whose classes
are all connected are settled. The rest: small nodes (``LEAF``) are compared
exhaustively across components, larger ones branch on. Pairs are dropped early
only if 128 two-bit sketch positions put them far below the threshold (more than
four standard deviations). Members of a node with a pair left get their full sets,
and of all links between them those of a spanning forest are kept: members and
links, not pairs, are rows, so a node of many copies alike to each other stays
linear. Every link returned was confirmed on full sets with integer arithmetic
(100 * intersection >= 75 * union).

Result of ``near_dedup``: the class of every document and the smallest ``doc_id``
it is connected to.

Defined cases: a null, empty or blank text is linked with nothing and is its own
component; rows with equal sets are linked whatever their ids; repeated rows
(same id) share a component and are each kept if the id is the component's; a
null ``doc_id`` is ordered after all ids (its own component is null, and it is
kept only if its component has no id at all); an empty table gives no rows; other
columns are ignored. Sets are named by 64 bits of a digest of their shingle
hashes, so two different ones collide with probability 2**-64 a pair.

Scale: the corpus is read for sketches and once more, filtered, for the full sets
of candidates. Tree levels move (path, class) rows of 16 bytes, and only those of
nodes with several components survive a level. Members of a node that are joined by
plausible pairs form a cluster; one that several paths show is compared once. A task
holds the sets of one cluster's members, at most about ``LEAF``, and their overlaps
(4 * LEAF**2 bytes). Nothing grows on the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _ranges, mix64, read_table, shingles, slices, utf8, words, written
from .components import components

T = 128                          # minwise tokens of a class
THRESHOLD = 75                   # per cent
TARGET_RECALL, DESIGN_DEPTH = 0.9999, 3
LEAF = 4096                      # classes of a node compared exhaustively
MAX_DEPTH = 24                   # beyond this, remaining nodes are compared in blocks
MIN_SAME = 86                    # of 128 two-bit positions; 104 expected at the threshold (s.d. 4.4)
PAIRS, CELLS = 1 << 18, 1 << 21  # pairs, and members x shingles, compared at a time in a task
BROADCAST_IDS = 1_000_000        # candidate ids sent to every task (8 MB); more are shuffled

_U = np.uint64
_ROUNDS = 24                     # rounds of random bins before the fixed bins


def trees_needed(recall: float = TARGET_RECALL, depth: int = DESIGN_DEPTH, j: float = THRESHOLD / 100) -> int:
    """Trees so that a pair of resemblance ``j`` meets at ``depth`` in one of them
    with probability ``recall``."""
    q = 1.0
    for _ in range(depth):
        q = 2 / 3 * j * q + 1 / 3 * (1 - (1 - j * q) ** 2)
    return int(np.ceil(np.log(1 - recall) / np.log(1 - q)))


# ---------------------------------------------------------------- sketches

def minwise(sets: np.ndarray, off: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch: (documents, t) tokens of 32 bits. In round r every
    element falls into one random bin; a bin keeps the smallest value of the first
    round that reaches it. Bins still empty after all rounds (small sets) take the
    smallest value of a hash of their own."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.full(n * t, np.iinfo(np.uint64).max, _U)
    doc = np.repeat(np.arange(n), size)
    live, at = sets, doc * t
    mask = _U((1 << 57) - 1)
    for r in range(_ROUNDS):
        if not len(live):
            break
        h = mix64(live + _U((r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        value = (_U(r) << _U(57)) | (h & mask)
        np.minimum.at(out, at + (h >> _U(57)).astype(np.int64) % t, value)
        open_docs = (out.reshape(n, t) == np.iinfo(np.uint64).max).any(1)
        keep = open_docs[at // t]
        live, at = live[keep], at[keep]
    grid = out.reshape(n, t)
    for b in range(t):
        need = np.flatnonzero((grid[:, b] == np.iinfo(np.uint64).max) & (size > 0))
        if len(need):
            sub = size[need]
            idx = np.repeat(off[need] - np.concatenate([[0], np.cumsum(sub)[:-1]]), sub) + np.arange(sub.sum())
            h = mix64(sets[idx] ^ mix64(np.full(1, b + 1000, _U))[0])
            grid[need, b] = np.minimum.reduceat(h, np.concatenate([[0], np.cumsum(sub)[:-1]])) | (_U(63) << _U(58))
    return (mix64(grid.reshape(-1)) >> _U(32)).astype(np.uint32).view(np.int32).reshape(n, t)


def two_bits(tokens: np.ndarray) -> np.ndarray:
    """Four longs a row: the two lowest bits of each of 128 tokens."""
    bits = (tokens & 3).astype(_U).reshape(len(tokens), 4, 32)
    return (bits << (_U(2) * np.arange(32, dtype=_U))).sum(-1, dtype=_U).view(np.int64)


def shingle_sets(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their offsets."""
    w, _, _, woff = words(*utf8(column))
    sh, off = shingles(w, woff)
    sets = [np.unique(sh[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
    return (np.concatenate(sets) if sets else sh), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _sketch(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                sets, off = shingle_sets(part.column(1))
                raw = sets.tobytes()
                node = [int.from_bytes(hashlib.blake2b(raw[8 * a: 8 * b], digest_size=8).digest(), "little", signed=True)
                        if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                tokens = minwise(sets, off)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(off), pa.int64()), pa.array(node, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1, dtype=np.int32) * T),
                                              pa.array(tokens.reshape(-1)))],
                    names=["_id", "n", "node", "tokens"])
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    return src.mapInArrow(run, "_id long, n long, node long, tokens array<int>")


def _bits(classes: DataFrame) -> DataFrame:
    """``node, n, s0..s3`` from the tokens."""
    def run(batches):
        for batch in batches:
            tokens = batch.column(2).values.to_numpy()[batch.column(2).offsets[0].as_py():
                                                       batch.column(2).offsets[-1].as_py()].reshape(-1, T)
            s = two_bits(tokens)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(s[:, i].copy()) for i in range(4)]],
                                             names=["node", "n", "s0", "s1", "s2", "s3"])
    return classes.select("node", "n", "tokens").mapInArrow(
        run, "node long, n long, s0 long, s1 long, s2 long, s3 long")


# ---------------------------------------------------------------- tree steps

def _children(rows: DataFrame, levels: int = 1) -> DataFrame:
    """(path, node, tokens) -> (path, node) in the chosen children, some levels down."""
    i = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(T)).cast("int")
    j = F.pmod(i + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(T - 1)), F.lit(T)).cast("int")
    two = F.pmod(F.xxhash64("path", F.lit(3)), F.lit(3)) == 0
    child = lambda p: F.xxhash64("path", p, F.get("tokens", p))          # noqa: E731
    for _ in range(levels):
        rows = rows.select(F.explode(F.when(two, F.array(child(i), child(j))).otherwise(F.array(child(i)))).alias("path"),
                           "node", "tokens")
    return rows.select("path", "node")


def _similar(a: str, b: str):
    """Sizes allow the threshold and the two-bit sketches do not rule it out."""
    same = None
    for k in range(4):
        x = F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))
        differ = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        same = differ if same is None else same + differ
    sizes = F.least(F.col(f"{a}n"), F.col(f"{b}n")) * 100 >= F.greatest(F.col(f"{a}n"), F.col(f"{b}n")) * THRESHOLD
    return sizes & (F.lit(128) - same >= MIN_SAME)


def _named(bits: DataFrame, key: str, prefix: str) -> DataFrame:
    return bits.select(F.col("node").alias(key), *[F.col(c).alias(prefix + c) for c in ("n", "s0", "s1", "s2", "s3")])


def _plausible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    return (pairs.join(_named(bits, "a", "_a"), "a").join(_named(bits, "b", "_b"), "b")
            .filter(_similar("_a", "_b")).select("a", "b"))


def _full_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, set``: the shingles of the classes ``nodes``, read from their texts."""
    ids = written(nodes.join(reps, "node").select(F.col("_rep").alias("_id"), "node"))
    src = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    # Classes without an id are read again from the rows without one, by their sets.
    nameless = ids.filter("_id IS NULL").select("node")
    named, nameless = ids.filter("_id IS NOT NULL"), ids.filter("_id IS NULL").select(F.col("node").alias("_node"))
    if ids.count() <= BROADCAST_IDS:
        named = F.broadcast(named)
    rest = src.filter("_id IS NULL").withColumnRenamed("_text", "text")
    src = src.join(named, "_id").select("_id", "_text", "node")
    if not nameless.isEmpty():
        src = src.unionByName(_with_class(rest).join(nameless, "_node")
                              .select("_id", F.col("text").alias("_text"), F.col("_node").alias("node")))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text", 4 << 20):
                sets, off = shingle_sets(part.column(1))
                raw = sets.tobytes()
                # Of rows that repeat an id, those with the class's set.
                mine = [i for i, (a, b, k) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), part.column(2).to_pylist()))
                        if b > a and int.from_bytes(hashlib.blake2b(raw[8 * a: 8 * b], digest_size=8).digest(),
                                                    "little", signed=True) == k]
                whole = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sets.view(np.int64)))
                take = pa.array(mine, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(2).take(take), whole.take(take)], names=["node", "set"])
    sets = src.select("_id", "_text", "node").mapInArrow(run, "node long, set array<bigint>")
    return written(sets.dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """The stored pairs whose full sets reach the threshold."""
    sets = _full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), reps, docs)
    side = lambda k: sets.select(F.col("node").alias(k), F.col("set").alias(f"_{k}"))      # noqa: E731
    both = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(both * 100 >= (F.size("_a") + F.size("_b") - both) * THRESHOLD).select("a", "b"))


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(path, node, label, size) of the nodes with classes of several components."""
    rows = rows.join(labels, "node", "left").select("path", "node", F.coalesce("label", "node").alias("label"))
    stats = written(rows.groupBy("path").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"),
                                            F.count(F.lit(1)).alias("size"))
                   .filter("_lo != _hi").select("path", "size"))
    return written(rows.join(stats, "path"))


_MEMBER = "cluster long, block int, node long, label long"
_KEY = ("path", "i", "j")


def _whole_nodes(batches, key=_KEY):
    """Tables of rows sorted by ``key``, cut so that no key's rows are parted."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _starts(table, key)
        if len(starts) == 1:
            held = table
            continue
        yield table.slice(0, int(starts[-1])).combine_chunks()
        held = table.slice(int(starts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _starts(table: pa.Table, key=_KEY) -> np.ndarray:
    """First rows of the keys."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in key:
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def _pairs_of(table: pa.Table):
    """Row numbers (a, b) of the pairs to compare within each key, a million or so at
    a time: of different components and, if the key is of two blocks, one of each."""
    n = table.num_rows
    starts = _starts(table)
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    count = end - np.arange(n) - 1
    label, block = table.column("label").to_numpy(), table.column("block").to_numpy()
    two = table.column("i").to_numpy() != table.column("j").to_numpy()
    total = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        a = np.repeat(np.arange(at, to), count[at:to])
        b = _ranges(np.arange(at, to) + 1, count[at:to])
        keep = (label[a] != label[b]) & (~two[a] | (block[a] != block[b]))
        yield a[keep], b[keep]
        at = to


def _merged(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The components ``at`` of rows, each named by one of its rows, after joining rows ``a`` and ``b``."""
    while True:
        x, y = at[a], at[b]
        apart = x != y
        if not apart.any():
            return at
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        to = np.arange(len(at))
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := to[to], to):
            to = up
        at = to[at]


def _clusters(at: np.ndarray, met: np.ndarray, node: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``met`` and a name for the component of each. The name is made of the
    component's nodes (and blocks), so it is the same wherever the same nodes meet."""
    rows = np.flatnonzero(met)
    rows = rows[np.lexsort((node[rows], at[rows]))]
    names = np.empty(len(rows), np.int64)
    cuts = np.flatnonzero(np.diff(at[rows])) + 1
    for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)] if len(rows) else []):
        own = rows[low:high]
        raw = np.stack([node[own], block[own]]).tobytes()
        names[low:high] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
    return rows, names


def _across(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The members of each path of ``rows`` that have a plausible partner of another
    component there (``_MEMBER``), in clusters joined by such pairs. Two classes meet in
    most of the trees, so clusters of the same members come from several paths and stay
    once. The nodes of a path over ``LEAF`` (only where branching ends) are dealt into
    blocks and every pair of blocks is a key of its own, so no path lands in one task."""
    blocks = F.when(F.col("size") <= LEAF, 1).otherwise(F.ceil(F.col("size") * 2 / LEAF)).cast("int")
    full = (rows.select("path", "node", "label", blocks.alias("_n"))
            .withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("_n")).cast("int")).join(bits, "node"))
    other = full.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    full = other.select("path", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "node",
                        "label", "n", "s0", "s1", "s2", "s3")

    def run(batches):
        for table in _whole_nodes(batches):
            n, *s = (table.column(c).to_numpy() for c in ("n", "s0", "s1", "s2", "s3"))
            met, at = np.zeros(table.num_rows, bool), np.arange(table.num_rows)
            for a, b in _pairs_of(table):
                fits = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * THRESHOLD
                a, b = a[fits], b[fits]
                differ = np.zeros(len(a), np.int64)
                for v in s:
                    x = (v[a] ^ v[b]).view(_U)
                    differ += np.bitwise_count((x | (x >> _U(1))) & _U(0x5555555555555555))
                near = 128 - differ >= MIN_SAME
                met[a[near]] = met[b[near]] = True
                at = _merged(at, a[near], b[near])
            i, j, block, node, label = (table.column(c).to_numpy() for c in ("i", "j", "block", "node", "label"))
            block = np.where(i == j, -1, block).astype(np.int64)     # -1: all pairs, else one of each block
            own, names = _clusters(at, met, node, block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(block[own].astype(np.int32)), pa.array(node[own]), pa.array(label[own])],
                names=["cluster", "block", "node", "label"])
    found = full.repartition(*_KEY).sortWithinPartitions(*_KEY).mapInArrow(run, _MEMBER)
    return found.dropDuplicates(["cluster", "node"])


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of some sets."""
    n = len(sets)
    of = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df > 1                                  # others add to no intersection
    place = np.cumsum(shared) - 1
    use = shared[column]
    of, column = of[use], place[column[use]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    out = np.zeros((n, n), np.float32)                # counts below 2**24: exact
    columns = max(64, CELLS // n)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, (low, low + columns))
        part = np.zeros((n, columns), np.float32)
        part[of[a:b], column[a:b] - low] = 1
        for r in range(0, n, 512):
            out[r: r + 512] += part[r: r + 512] @ part.T
    return out


def _forest(both: np.ndarray, size: np.ndarray, label: np.ndarray, block: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs of members of a key (``block``: of two blocks, one of each) whose overlap
    ``both`` reaches the threshold: a spanning forest of the components ``label``."""
    at = np.unique(label, return_inverse=True)[1]
    links = []
    for a in range(len(size) - 1):
        over = both[a, a + 1:].astype(np.int64)
        linked = over * 100 >= (size[a] + size[a + 1:] - over) * THRESHOLD
        linked &= at[a + 1:] != at[a]
        if block is not None:
            linked &= block[a + 1:] != block[a]
        b = a + 1 + np.flatnonzero(linked)
        if len(b):
            joined, first = np.unique(at[b], return_index=True)
            links += [(a, x) for x in b[first].tolist()]
            at[np.isin(at, joined)] = at[a]
    return links


def _joined(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` on full sets that join the components within each cluster of
    ``members``: a spanning forest, so a cluster gives fewer links than it has classes
    however many of them are alike."""
    rows = members.join(sets, "node").select("cluster", "block", "node", "label", "set")

    def run(batches):
        for table in _whole_nodes(batches, ("cluster",)):
            node, label, block = (table.column(c).to_numpy() for c in ("node", "label", "block"))
            lists = table.column("set").combine_chunks()
            off, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            links: list[tuple[int, int]] = []
            starts = _starts(table, ("cluster",))
            for at, to in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
                both = _overlaps([values[off[r]: off[r + 1]] for r in range(at, to)])
                size = np.diff(off[at: to + 1]).astype(np.int64)
                for a, b in _forest(both, size, label[at:to], block[at:to] if block[at] >= 0 else None):
                    u, v = int(node[at + a]), int(node[at + b])
                    links.append((min(u, v), max(u, v)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "a long, b long").distinct()


def _of(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """The tokens of the classes in ``rows``; while these are few, the others cross no shuffle."""
    nodes = written(rows.select("node").distinct())
    return tokens.join(F.broadcast(nodes), "node", "left_semi") if nodes.count() <= BROADCAST_IDS else tokens


def _searched(roots, tokens: DataFrame, bits: DataFrame, reps: DataFrame, docs: DataFrame,
              links: DataFrame | None, labels: DataFrame | None) -> tuple[DataFrame, DataFrame, int]:
    """Links and components after the trees of ``roots``, and the depth at which the
    last nodes were settled or compared."""
    first = _children(tokens.select(F.explode(roots).alias("path"), "node", "tokens"))
    sizes = written(first.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least"))
                   .filter("size > 1"))
    rows = written(first.join(sizes, "path").select("path", "node", "least"))
    star = written(_plausible(rows.filter("node != least").select(F.col("least").alias("a"), F.col("node").alias("b"))
                             .distinct(), bits))
    if links is not None:
        star = written(star.join(links, ["a", "b"], "left_anti"))
    new = written(_confirmed(star, reps, docs))
    links = new if links is None else links.unionByName(new)
    labels = components(links)

    found, depth = [], 1
    rows = rows.select("path", "node")
    while True:
        rows = _mixed(rows, labels)
        last = depth >= MAX_DEPTH
        small = rows if last else rows.filter(F.col("size") <= LEAF)
        found.append(written(_across(small, bits)))
        if last or rows.filter(F.col("size") > LEAF).isEmpty():
            break
        large = rows.filter(F.col("size") > LEAF).select("path", "node")
        levels = min(depth, MAX_DEPTH - depth)       # 1, 2, 4, ...: few rounds for a very large node
        rows = _children(large.join(_of(large, tokens), "node"), levels)
        depth += levels
    members = found[0]
    for f in found[1:]:
        members = members.unionByName(f)
    if not members.isEmpty():
        sets = _full_sets(members.select("node").distinct(), reps, docs)
        links = links.unionByName(written(_joined(members, sets)))
        labels = components(links)
    return links, labels, depth


def near_dedup(docs: DataFrame, recall: float = TARGET_RECALL) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id, label`` for every row of
    ``docs`` (columns ``doc_id, text``); ``label`` names the component by a class."""
    base = written(_sketch(docs))
    known = base.filter("node IS NOT NULL")
    classes = written(known.groupBy("node").agg(F.min("_id").alias("_least"), F.first("n").alias("n"),
                                               F.first("tokens").alias("tokens")))
    reps = classes.select("node", F.col("_least").alias("_rep"))
    bits = written(_bits(classes))
    tokens = classes.select("node", "tokens")

    links, labels, trees, deepest = None, None, 0, DESIGN_DEPTH
    while trees < trees_needed(recall, deepest):     # deeper nodes than known so far ask for more trees
        more = trees_needed(recall, deepest)
        roots = F.array(*[F.xxhash64(F.lit(t), F.lit("tree")) for t in range(trees, more)])
        links, labels, depth = _searched(roots, tokens, bits, reps, docs, links, labels)
        trees, deepest = more, max(deepest, depth)

    named = classes.select("node", "_least").join(labels, "node", "left") \
                   .withColumn("label", F.coalesce("label", "node"))
    least = written(named.groupBy("label").agg(F.min("_least").alias("component_id")))
    by_class = written(written(named.select("node", "label")).join(least, "label").select("node", "component_id", "label"))
    own = base.select("_id", "n", "node")
    joined = (own.filter("node IS NOT NULL").join(by_class, "node")
              .unionByName(own.filter("node IS NULL").withColumn("component_id", F.col("_id"))
                           .withColumn("label", F.lit(None).cast("long"))))
    return joined.select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id",
                         F.col("_id").eqNullSafe(F.col("component_id")).alias("kept"), F.col("node").alias("class_id"), "label")


def _with_class(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_node``, the class of each row's text (null: no words)."""
    names = [*docs.columns, "_node"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                sets, off = shingle_sets(part.column(part.schema.get_field_index("text")))
                raw = sets.tobytes()
                node = [int.from_bytes(hashlib.blake2b(raw[8 * a: 8 * b], digest_size=8).digest(), "little", signed=True)
                        if b > a else None for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(node, pa.int64())], names=names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, _node long")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, that of the smallest id (null
    last), of the smallest class if the id repeats. Rows without words are linked
    with nothing: equal ones that repeat an id count once, those without an id stay."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = written(near_dedup(docs).filter("class_id IS NOT NULL")
                    .groupBy("class_id", "doc_id", "label").agg(F.count(F.lit(1)).alias("_rows")))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "class_id", "_rows"))
    kept = found.groupBy("label").agg(first.alias("f")).select(
        F.col("f.doc_id").alias("_kept_id"), F.col("f.class_id").alias("_kept_node"), F.col("f._rows").alias("_rows"))
    rows = _with_class(docs)
    joined = rows.join(kept, (F.col("_node") == F.col("_kept_node")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")))
    once = joined.filter("_rows = 1").select(*cols)
    again = joined.filter("_rows > 1").dropDuplicates(["_node"]).select(*cols)
    blank = rows.filter("_node IS NULL")
    return (once.unionByName(again)
            .unionByName(blank.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text"]).select(*cols))
            .unionByName(blank.filter("doc_id IS NULL").select(*cols)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: near-duplicate component of every document."""
    return near_dedup(read_table(spark, sf_dir, "documents")).drop("label")
