"""A Merkle manifest of a dataset, and octopus multiproofs from it.

Each row is a leaf. Leaves of one tree (a language) stand in the order of their
doc_id; two consecutive nodes become their hash, a last one alone becomes the
hash of itself, until one is left, the subroot. Subroots, in the order of their
trees, become the root in the same way. All digests are SHA-256 in lowercase
hexadecimal.

The leaves are put in order by a range partitioning and numbered by prefix
counts of its partitions. Nodes are built in blocks of ``2 ** LEVELS`` aligned
nodes, ``LEVELS`` levels at a time, and all of them are kept by tree, level and index.

A multiproof serves a block of leaves at once. From the places of its leaves
the block works out, level by level, which nodes it can derive from them and
which it lacks: the least union of coordinates that prove them all. These are
fetched in one join with the kept nodes. The block then derives the interiors
that its leaves share once, and reads each leaf's own proof off them. Subroots
are proved in the same way and hand their proof to all blocks of their tree.

Defined results: a null tree comes first, others by their bytes. Rows of one
tree with equal doc_ids (a null one before all others) stand by their leaf;
rows that are equal throughout are leaves of their own, and as which of them
stands where cannot show, results agree. A null column counts as ``-`` in the
leaf. Very long texts are hashed by Spark itself and do not leave their row. An
empty table has no root and gives no rows. Other columns do not take part.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, written

LEVELS = 12
#: Tree whose leaves are the subroots.
TOP = "^"
_NODE = "tree string, level int, idx long, hash string"


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that none runs into the next."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(n_chars: Column) -> Column:
    """The leaf of a document that states ``n_chars``."""
    return F.sha2(F.concat(*[field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))]), 256)


def node_hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _pos_of(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``pos``, their number within their tree. The ties of ``order`` are dealt
    out by a row number, so that equal rows may be as many as they like."""
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie")
    dealt = written(dealt.select(*rows.columns, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "merkle-order")
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("at").alias("from"))  # a row for each partition of a tree
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.select("tree", "part", (before - F.col("from")).alias("shift")), "merkle-starts")
    placed = dealt.join(checked_broadcast(starts), ["tree", "part"])
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("tie", "part", "at", "shift")


def _levels(nodes: list[str], top: int) -> list[list[str]]:
    """The ``top`` levels above an aligned stretch of nodes."""
    out = []
    for _ in range(top):
        nodes = [node_hash(nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def _grown(level: int, levels: int):
    """The nodes above a block of nodes that stand on ``level``."""

    def above(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        tree, at, top = rows["tree"][0].as_py(), rows["idx"][0].as_py(), rows["depth"][0].as_py() - level
        made = _levels(rows["hash"].to_pylist(), min(levels, top))
        out = [(tree, level + k, (at >> k) + i, h) for k, nodes in enumerate(made, 1) for i, h in enumerate(nodes)]
        columns = list(zip(*out, strict=True))
        types = (pa.string(), pa.int32(), pa.int64(), pa.string())
        return pa.table([pa.array(c, x) for c, x in zip(columns, types, strict=True)], ["tree", "level", "idx", "hash"])

    return above


def _kept_nodes(leaves: DataFrame, sizes: DataFrame, levels: int) -> DataFrame:
    """All nodes of the trees whose ``leaves`` (tree, pos, leaf) are given."""
    now = leaves.select("tree", F.lit(0).alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"))
    kept, level = [now], 0
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    while level < deepest:
        above = checked_broadcast(sizes.filter(F.col("depth") > level))
        blocks = now.join(above, "tree").groupBy("tree", F.shiftright("idx", levels).alias("block"))
        made = written(blocks.applyInArrow(_grown(level, levels), _NODE), "merkle-nodes")
        kept.append(made)
        level += levels
        now = made.filter(F.col("level") == level)
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out


class Manifest:
    """Leaves in order, all nodes, and one row for each tree.

    ``leaves``: the given columns with tree, pos and block; ``nodes``: tree, level,
    idx, hash; ``trees``: tree, n, depth, subroot, pos (among the subroots);
    ``tops``: the nodes above the subroots.
    """

    def __init__(self, rows: DataFrame, order: list[str], levels: int = LEVELS):
        placed = _pos_of(rows, order).withColumn("block", F.shiftright("pos", levels))
        self.leaves = written(placed, "merkle-leaves")
        sizes = self._sizes(self.leaves)
        self.nodes = _kept_nodes(self.leaves, sizes, levels)
        subroots = self.nodes.join(checked_broadcast(sizes), "tree").filter("level = depth").select("tree", "n", "depth", F.col("hash").alias("subroot"))
        named = written(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("name"), "n", "depth", F.col("subroot").alias("leaf")), "merkle-subroots")
        named = written(_pos_of(named, ["name"]), "merkle-trees")
        self.trees = named.select(F.col("name").alias("tree"), "n", "depth", F.col("leaf").alias("subroot"), "pos")
        self.top_leaves = named.select("tree", "pos", "leaf", F.shiftright("pos", levels).alias("block"), "name")
        self.top_sizes = self._sizes(named)
        self.tops = _kept_nodes(self.top_leaves, self.top_sizes, levels)

    @staticmethod
    def _sizes(leaves: DataFrame) -> DataFrame:
        n = F.col("n")
        counted = leaves.groupBy("tree").agg(F.count("*").alias("n"))
        return written(counted.select("tree", "n", F.when(n > 1, F.length(F.conv((n - 1).cast("string"), 10, 2))).otherwise(0).alias("depth")), "merkle-sizes")

    def root(self) -> str | None:
        """The root; none for an empty table."""
        found = self.tops.join(F.broadcast(self.top_sizes), "tree").filter("level = depth").first()
        return found and found["hash"]


def missing(places: list[int], n: int) -> list[tuple[int, int]]:
    """Coordinates (level, index) of the least set of nodes that, with the leaves at
    ``places`` of ``n``, gives the subroot."""
    out, level, known = [], 0, sorted(set(places))
    while n > 1:
        have = set(known)
        out += [(level, i ^ 1) for i in known if i ^ 1 < n and i ^ 1 not in have]
        known = sorted({i >> 1 for i in known})
        n, level = (n + 1) >> 1, level + 1
    return out


def expanded(places: list[int], hashes: list[str], fetched: dict[tuple[int, int], str], n: int) -> tuple[list[list[tuple[bool, str]]], str]:
    """Each leaf's own proof, from its level up: the other node of its run and whether it
    stands to the left; a level without one has none. And the subroot. Interiors
    that leaves share are derived once."""
    steps, known, level = [], dict(zip(places, hashes, strict=True)), 0
    while n > 1:
        known |= {i ^ 1: fetched[level, i ^ 1] for i in known if (level, i ^ 1) in fetched}
        steps.append(known)
        known = {i: node_hash([known[2 * i], known[2 * i + 1]] if 2 * i + 1 < n else [known[2 * i]]) for i in {k >> 1 for k in known}}
        n, level = (n + 1) >> 1, level + 1
    proofs = []
    for place in places:
        at = [(place >> k, nodes) for k, nodes in enumerate(steps)]
        proofs.append([(i & 1 == 1, nodes[i ^ 1]) if i ^ 1 in nodes else None for i, nodes in at])
    return proofs, known[0]


def folded(leaf: str, proof: list[tuple[bool, str] | None]) -> str:
    """The root that a leaf and its proof give."""
    for step in proof:
        leaf = node_hash([leaf] if step is None else [step[1], leaf] if step[0] else [leaf, step[1]])
    return leaf


_COORD = "tree string, block long, level int, idx long"
_STEPS = "array<struct<left: boolean, hash: string>>"
_STEP = pa.struct([("left", pa.bool_()), ("hash", pa.string())])
_PROOF = f"proof {_STEPS}, subroot string, root string, claimed string"


def _lacking(rows: pa.Table) -> pa.Table:
    """What a block cannot derive from its own leaves."""
    out = missing(rows["pos"].to_pylist(), rows["n"][0].as_py())
    level, idx = zip(*out, strict=True) if out else ((), ())
    same = [pa.array([rows[c][0].as_py()] * len(out), t) for c, t in (("tree", pa.string()), ("block", pa.int64()))]
    return pa.table([*same, pa.array(level, pa.int32()), pa.array(idx, pa.int64())], ["tree", "block", "level", "idx"])


def _served(check: str, names: list[str]):
    """The rows of a block with their proofs."""

    def serve(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return _with_proofs(leaves.select(names), [], [], [], [])
        places, hashes, checked = (leaves[c].to_pylist() for c in ("pos", "leaf", check))
        nodes = dict(zip(zip(fetched["level"].to_pylist(), fetched["idx"].to_pylist(), strict=True), fetched["hash"].to_pylist(), strict=True))
        found, subroot = expanded(places, hashes, nodes, leaves["n"][0].as_py())
        above = [s and (s["left"], s["hash"]) for s in leaves["above"][0].as_py()]
        found = [proof + above for proof in found]
        roots = [folded(leaf, proof) for leaf, proof in zip(hashes, found, strict=True)]
        claimed = [root if other == leaf else folded(other, proof) for root, leaf, other, proof in zip(roots, hashes, checked, found, strict=True)]
        return _with_proofs(leaves.select(names), found, [subroot] * len(found), roots, claimed)

    return serve


def _with_proofs(rows: pa.Table, found: list, subroots: list, roots: list, claimed: list) -> pa.Table:
    flat = [step for proof in found for step in proof]
    fields = [pa.array([s and s[0] for s in flat], pa.bool_()), pa.array([s and s[1] for s in flat], pa.string())]
    steps = pa.StructArray.from_arrays(fields, fields=list(_STEP), mask=pa.array([s is None for s in flat], pa.bool_()))
    ends = list(accumulate(map(len, found), initial=0))
    rows = rows.append_column("proof", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps))
    for name, values in (("subroot", subroots), ("root", roots), ("claimed", claimed)):
        rows = rows.append_column(name, pa.array(values, pa.string()))
    return rows


def _multiproofs(leaves: DataFrame, nodes: DataFrame, check: str) -> DataFrame:
    """``leaves`` (tree, block, pos, leaf, n, above and others) with their proofs."""
    keys, coord = ["tree", "block"], ["tree", "level", "idx"]
    wanted = written(leaves.select(*keys, "pos", "n").groupBy(*keys).applyInArrow(_lacking, _COORD), "merkle-wanted")
    once = written(wanted.select(coord).distinct(), "merkle-coordinates")
    fetched = written(nodes.join(checked_broadcast(once), coord, "left_semi").select(*coord, "hash"), "merkle-fetched")
    found = wanted.join(checked_broadcast(fetched), coord)
    names = [c for c in leaves.columns if c not in ("n", "above")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.select(names).schema)
    both = leaves.groupBy(*keys).cogroup(found.groupBy(*keys))
    return both.applyInArrow(_served(check, names), f"{schema}, {_PROOF}")


def proofs(manifest: Manifest, wanted: DataFrame, check: str = "leaf") -> DataFrame:
    """``wanted``, rows of ``manifest.leaves``, with proof (the other nodes of the runs from
    the leaf up to the root; null where a run has none), subroot, root (what the leaf
    and its proof give) and claimed (what the hash in ``check`` and the proof give)."""
    tops = manifest.top_leaves.join(F.broadcast(manifest.top_sizes.select("tree", "n")), "tree").withColumn("above", F.array().cast(_STEPS))
    above = _multiproofs(tops, manifest.tops, "leaf").select("name", F.col("proof").alias("above"))
    trees = written(above.join(manifest.trees, F.col("name") == F.col("tree")).select("tree", "n", "above"), "merkle-above")
    return _multiproofs(wanted.join(checked_broadcast(trees), "tree"), manifest.nodes, check)


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of documents and what tampering would make of them: where 7 divides the
    CRC-32 of its doc_id, a document claims one character more."""
    n = F.col("n_chars").cast("long")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))  # the null tree before all others
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(tree.alias("tree"), doc_id, leaf_hash(n).alias("leaf"), leaf_hash(n + F.when(tampered, 1).otherwise(0)).alias("claim"))


def verified_documents(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof, folded_root (from the leaf
    that is claimed, with the true proof) and verified (folded_root is the root)."""
    manifest = Manifest(written(document_leaves(docs), "merkle-hashes"), ["doc_id", "leaf"], levels)
    root = F.lit(manifest.root()).cast("string")
    got = proofs(manifest, manifest.leaves, "claim")
    return got.select("doc_id", "leaf", "subroot", root.alias("root"), "proof", F.col("claimed").alias("folded_root"), (F.col("claimed") == root).alias("verified"))
