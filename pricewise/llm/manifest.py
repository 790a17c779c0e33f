"""Operator 13: Merkle manifest of a dataset by butterfly exchange.

Leaves are hashes of rows; per group (source) they stand in key order, and every run
of ``FANOUT`` consecutive nodes becomes its hash until one is left, the group's
subroot. Subroots in group order make one more tree of the same kind, whose top is
the root. A row's proof is the siblings on its way up, and folding its leaf with
them must give the root.

Groups are cut into aligned blocks of ``FANOUT ** k`` leaves; a block hashes its own
subtree. Blocks then swap roots round by round: in round ``r`` the ``FANOUT`` aligned
parts of ``FANOUT ** r`` blocks that share a parent exchange their roots, each block
with the blocks in the same place of the other parts (a part that is cut short at the
end of the group serves its places in turn). So every block hashes all its ancestors
itself, redundantly, and holds the siblings of each when the last round ends; nothing
travels down again. A round moves as many small messages as there are blocks and
siblings, and no block sends more than its share except a short last part.

Defined cases: a null field hashes as ``-``, which no value gives; null groups are one
group, ordered first; rows with a null key come first, rows of one key follow each
other by leaf; equal rows are leaves of their own; a lone leaf is its group's subroot;
with one group the subroot is the root; with no sibling at all the proof is the hash of
nothing; an empty table gives no rows. Texts of any length are hashed in place; other
columns are ignored.

Scale: the texts are read once, in a plain projection that keeps two digests a row. Rows
get their place within a group from a range partitioning and per-partition counts
(equal rows are salted, so they split too); a group that holds most rows is as many blocks
as any other part of the table. Only the number of blocks of the largest group reaches
the driver.
"""

from __future__ import annotations

from functools import reduce
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.rows import with_row_index
from .common import read_table, stored, written

FANOUT = 3
BLOCK_LEVELS = 6                 # levels inside a block: 729 leaves
SALTS = 1024                     # places among equal rows
OUT_ROWS = 4096
KEY = ["_none", "_group"]        # group: whether it is null, its text
BLOCK = [*KEY, "_block"]
PROOF = "array<struct<i: int, h: array<string>>>"     # per level: place in the run, the others' hashes


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Lower-case hex digest of the fields in order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(nodes: list[bytes]) -> bytes:
    return sha256(b"".join(nodes)).hexdigest().encode()


# ---------------------------------------------------------------- places

def placed(leaves: DataFrame, key: str) -> DataFrame:
    """``leaves`` (``_none, _group, key, leaf, ...``) with ``_pos``, the place in the group by
    (key, leaf), and ``_n``, the group's size."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    order = [F.desc("_none"), F.asc("_group"), F.asc_nulls_first(key), F.asc("leaf"), F.asc("_salt")]
    rows = written(leaves.withColumn("_salt", salt))
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt")
                     .withColumn("_part", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    counts = ranged.groupBy("_part", *KEY).agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_first"))
    whole = Window.partitionBy(*KEY)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.select("_part", *KEY, (F.coalesce(F.sum("_c").over(before), F.lit(0)) - F.col("_first"))
                                  .alias("_shift"), F.sum("_c").over(whole).alias("_n")))
    return (ranged.join(counts, ["_part", *KEY])
            .withColumn("_pos", F.col("_mid") + F.col("_shift")).drop("_part", "_mid", "_shift"))


# ---------------------------------------------------------------- inside a block

def _levels(nodes: list[bytes], whole: bool, fanout: int, block_levels: int) -> list[list[bytes]]:
    """The nodes of every level of a block; a block that is its whole group stops at
    one node, any other goes up all its levels."""
    levels = [nodes]
    while len(levels[-1]) > 1 if whole else len(levels) <= block_levels:
        low = levels[-1]
        levels.append([_hash(low[a: a + fanout]) for a in range(0, len(low), fanout)])
    return levels


def _blocks(batches, names: list[str]):
    """(block key, rows as dicts) of sorted batches, block by block."""
    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns])
    for key, group in groupby(rows(), key=lambda r: r[:3]):
        yield key, [dict(zip(names, r)) for r in group]


def _batches(rows, kinds: list[pa.DataType], names: list[str]):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == OUT_ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)


def block_roots(nodes: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``_none, _group, _block, _n`` (blocks of the group) and ``node`` (its root) per block, from
    rows with ``_none, _group, _pos, _n, leaf`` (binary)."""
    size = fanout ** block_levels

    def run(batches):
        def rows():
            for key, leaves in _blocks(batches, [*BLOCK, "_pos", "_n", "leaf"]):
                n = leaves[0]["_n"]
                top = _levels([r["leaf"].hex().encode() for r in leaves], n <= size, fanout, block_levels)[-1][0]
                yield *key, -(-n // size), top.decode()
        yield from _batches(rows(), [pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.string()], [*BLOCK, "_n", "node"])
    cut = nodes.select(*KEY, F.expr(f"_pos div {size}").alias("_block"), "_pos", "_n", "leaf")
    return (cut.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "_pos")
            .mapInArrow(run, "_none boolean, _group string, _block long, _n long, node string"))


# ---------------------------------------------------------------- between blocks

def exchange(state: DataFrame, r: int, fanout: int = FANOUT) -> DataFrame:
    """Round ``r``: every block learns the roots of the parts beside its own and hashes
    their parent. Groups with one part left keep their state."""
    w = fanout ** r
    n, block = F.col("_n"), F.col("_block")
    part, place = F.expr(f"_block div {w}"), block % w
    parts = F.expr(f"(_n + {w - 1}) div {w}")
    first = part - part % fanout

    def width(p):                # blocks of part p
        return F.least(F.lit(w).cast("long"), n - p * w)

    def receivers(p):            # blocks of part p that this one serves
        served = F.sequence(place, width(p) - 1, width(part))
        return (F.when(p == part, F.array(block)).when(place < width(p), F.transform(served, lambda x: p * w + x))
                .otherwise(F.array().cast("array<bigint>")))
    beside = F.sequence(first, F.least(first + fanout - 1, parts - 1))
    sent = state.select(*KEY, F.explode(F.flatten(F.transform(beside, receivers))).alias("_to"), "_block", "_n", "node",
                        part.alias("_from"), "proof")
    own = F.col("_to") == F.col("_block")
    got = sent.groupBy(*KEY, F.col("_to").alias("_block")).agg(
        F.first("_n").alias("_n"), F.array_sort(F.collect_list(F.struct("_from", "node"))).alias("_run"),
        F.first(F.when(own, F.col("node")), ignorenulls=True).alias("_node"),
        F.first(F.when(own, F.col("proof")), ignorenulls=True).alias("_proof"))
    others = F.transform(F.filter("_run", lambda x: x["_from"] != part), lambda x: x["node"])
    level = F.array(F.struct((part % fanout).cast("int").alias("i"), others.alias("h"))).cast(PROOF)
    parent = F.sha2(F.array_join(F.transform("_run", lambda x: x["node"]), ""), 256)
    return got.select(*BLOCK, "_n", F.when(parts > 1, parent).otherwise(F.col("_node")).alias("node"),
                      F.when(parts > 1, F.concat("_proof", level)).otherwise(F.col("_proof")).alias("proof"))


def upper_proofs(nodes: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``_none, _group, _block, node`` (the group's top) and ``proof`` (levels above the block)."""
    state = stored(block_roots(nodes, fanout, block_levels).withColumn("proof", F.array().cast(PROOF)))
    most = state.agg(F.max("_n")).first()[0] or 0
    rounds = next(r for r in range(64) if fanout ** r >= most)
    return stored(reduce(lambda s, r: exchange(s, r, fanout), range(rounds), state).drop("_n"))


def _with_upper(nodes: DataFrame, upper: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Rows of nodes and, before those of its block, the row of ``upper``; sorted by block."""
    above = [c for c in upper.columns if c not in BLOCK]
    kinds = {f.name: f.dataType for f in [*nodes.schema, *upper.schema]}

    def null(c):
        return F.lit(None).cast(kinds[c]).alias(c)
    low = nodes.select(*KEY, F.expr(f"_pos div {size}").alias("_block"), "_pos", "_n", *columns, *[null(c) for c in above])
    top = upper.select(*BLOCK, F.lit(-1).cast("long").alias("_pos"), F.lit(None).cast("long").alias("_n"),
                       *[null(c) for c in columns], *above)
    return low.unionByName(top).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "_pos")


class _Path:
    """The way up of every leaf of one block."""

    def __init__(self, leaves: list[bytes], n: int, upper: list[dict], fanout: int, block_levels: int):
        levels = _levels(leaves, n <= fanout ** block_levels, fanout, block_levels)
        self.runs = [[low[a: a + fanout] for a in range(0, len(low), fanout)] for low in levels[:-1]]
        self.upper = [(x["i"], [h.encode() for h in x["h"]]) for x in upper]
        self.fanout = fanout

    def steps(self, p: int):
        """(place in the run, the others' hashes), level by level."""
        for runs in self.runs:
            run, i = runs[p // self.fanout], p % self.fanout
            yield i, run[:i] + run[i + 1:]
            p //= self.fanout
        yield from self.upper


def proof_digest(steps) -> str:
    return sha256(b"".join(h for _, others in steps for h in others)).hexdigest()


def fold(node: bytes, steps) -> bytes:
    """The root that a leaf and its proof give."""
    for i, others in steps:
        node = _hash([*others[:i], node, *others[i:]])
    return node


def group_proofs(subroots: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``_none, _group, root, above``: the tree over the groups (``_none, _group, leaf``)."""
    indexed = with_row_index(subroots, [F.desc("_none"), F.asc("_group")], "_pos", materialise_input=True)
    nodes = stored(indexed.select(F.lit(False).alias("_none"), F.lit("").alias("_group"), "_pos", "leaf",
                                  F.struct(*KEY).alias("_whose")).crossJoin(indexed.agg(F.count(F.lit(1)).alias("_n"))))
    upper = upper_proofs(nodes, fanout, block_levels)
    names = [*BLOCK, "_pos", "_n", "leaf", "_whose", "node", "proof"]

    def run(batches):
        def rows():
            for _, (top, *leaves) in _blocks(batches, names):
                path = _Path([r["leaf"].hex().encode() for r in leaves], leaves[0]["_n"], top["proof"], fanout, block_levels)
                for p, r in enumerate(leaves):
                    steps = [{"i": i, "h": [h.decode() for h in others]} for i, others in path.steps(p)]
                    yield r["_whose"]["_none"], r["_whose"]["_group"], top["node"], steps
        kind = pa.list_(pa.struct([("i", pa.int32()), ("h", pa.list_(pa.string()))]))
        yield from _batches(rows(), [pa.bool_(), pa.string(), pa.string(), kind], [*KEY, "root", "above"])
    return _with_upper(nodes, upper, ["leaf", "_whose"], fanout ** block_levels).mapInArrow(
        run, f"_none boolean, _group string, root string, above {PROOF}")


# ---------------------------------------------------------------- the manifest

def manifest(rows: DataFrame, key: str, group: str, leaf_hash: Column, claimed: Column | None = None,
             with_proof: bool = False, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row: its leaf,
    the tops of its trees, the digest of its proof, and the root that ``claimed`` (the
    leaf of a row that may have been changed since; null: its own leaf) folds to with
    that proof, level by level for every row. ``with_proof`` adds ``proof``, the siblings
    themselves."""
    leaves = rows.select(F.col(key).alias("_key"), F.col(group).isNull().alias("_none"),
                         F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_group"),
                         F.unhex(leaf_hash).alias("leaf"),
                         (F.lit(None).cast("binary") if claimed is None else F.unhex(claimed)).alias("claimed"))
    nodes = placed(leaves, "_key")
    upper = upper_proofs(nodes, fanout, block_levels)
    above = group_proofs(upper.filter("_block = 0").select(*KEY, F.unhex("node").alias("leaf")), fanout, block_levels)
    upper = upper.join(above, KEY).select(*BLOCK, F.col("node").alias("subroot"), "root",
                                          F.concat("proof", "above").alias("proof"))
    names = [*BLOCK, "_pos", "_n", "_key", "leaf", "claimed", "subroot", "root", "proof"]
    kind = leaves.schema["_key"].dataType.simpleString()

    siblings = pa.list_(pa.struct([("i", pa.int32()), ("h", pa.list_(pa.string()))]))
    kinds = [to_arrow_type(leaves.schema["_key"].dataType), *[pa.string()] * 5, pa.bool_(), siblings]
    size = fanout ** block_levels

    def run(batches):
        def out():
            for _, (top, *low) in _blocks(batches, names):
                path = _Path([r["leaf"].hex().encode() for r in low], low[0]["_n"], top["proof"], fanout, block_levels)
                for p, r in enumerate(low):
                    steps = list(path.steps(p))
                    mine = r["leaf"] if r["claimed"] is None else r["claimed"]
                    folded = fold(mine.hex().encode(), steps).decode()
                    yield (r["_key"], r["leaf"].hex(), top["subroot"], top["root"], proof_digest(steps), folded,
                           folded == top["root"],
                           [{"i": i, "h": [h.decode() for h in o]} for i, o in steps] if with_proof else None)
        yield from _batches(out(), kinds, fields)
    fields = [key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
    done = _with_upper(nodes, upper, ["_key", "leaf", "claimed"], size).mapInArrow(
        run, f"`{key}` {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
             f"verified boolean, proof {PROOF}")
    return done if with_proof else done.drop("proof")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the manifest of ``documents``; rows whose id has an even CRC-32 are
    checked with all line feeds taken out of their text."""
    docs = read_table(spark, sf_dir, "documents")
    cols = [F.col(c) for c in FIELDS]
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    claimed = F.when(altered, leaf(*cols[:-1], F.translate("text", "\n", "")))
    return manifest(docs, "doc_id", "source", leaf(*cols), claimed)


_ROW = "concat({})".format(", ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END" for c in FIELDS[:-1]))
_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(doc_id::VARCHAR) + 1),
           lambda k: ord(substr(doc_id::VARCHAR, k::BIGINT, 1))::BIGINT)),
         lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
           lambda x, unused: xor(x // 2, 3988292384::BIGINT * (x % 2))))"""
SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, sha256({_ROW} || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
           CASE WHEN xor({_CRC}, 4294967295) % 2 = 0 AND text LIKE '%' || chr(10) || '%'
                THEN sha256({_ROW} || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')) END AS claimed
    FROM documents
), p AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY source) AS n FROM d
), g AS (   -- nodes of every source's tree, level by level
    SELECT source, 0 AS lvl, pos, leaf AS h, n FROM p
    UNION ALL
    SELECT source, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
    FROM g WHERE n > 1 GROUP BY source, lvl, pos // 3, n
), s AS (
    SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM g WHERE n = 1
), t AS (   -- and of the tree of sources
    SELECT 0 AS lvl, pos, h, n FROM s
    UNION ALL
    SELECT lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
    FROM t WHERE n > 1 GROUP BY lvl, pos // 3, n
), gs AS (  -- what stands left and right of a node in its run
    SELECT a.source, a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM g a JOIN g b ON a.source IS NOT DISTINCT FROM b.source AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3
    WHERE a.n > 1 GROUP BY ALL
), ts AS (
    SELECT a.lvl, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
           coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM t a JOIN t b ON a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL
), up AS (  -- every leaf on its way up in its source
    SELECT row_number() OVER () AS k, doc_id, source, leaf, 0 AS lvl, pos, n, coalesce(claimed, leaf) AS h, '' AS proof FROM p
    UNION ALL
    SELECT k, doc_id, up.source, leaf, up.lvl + 1, up.pos // 3, (n + 2) // 3, sha256(l || h || r), proof || l || r
    FROM up JOIN gs ON up.source IS NOT DISTINCT FROM gs.source AND up.lvl = gs.lvl AND up.pos = gs.pos WHERE n > 1
), top AS (
    SELECT k, doc_id, leaf, s.h AS subroot, 0 AS lvl, s.pos, s.n, up.h, proof
    FROM up JOIN s ON up.source IS NOT DISTINCT FROM s.source WHERE up.n = 1
    UNION ALL
    SELECT k, doc_id, leaf, subroot, top.lvl + 1, top.pos // 3, (n + 2) // 3, sha256(l || h || r), proof || l || r
    FROM top JOIN ts ON top.lvl = ts.lvl AND top.pos = ts.pos WHERE n > 1
)
SELECT doc_id, leaf, subroot, (SELECT h FROM t WHERE n = 1) AS root, sha256(proof) AS proof_sha256, h AS folded_root,
       h = (SELECT h FROM t WHERE n = 1) AS verified
FROM top WHERE n = 1
"""
