"""Operator 13: a Merkle manifest of a dataset, with a proof of membership for every row.

A row's leaf is the hash of its fields; per tree (the lang) leaves stand in order of doc_id, and every two consecutive nodes
become one until one remains. The tree roots, in order, are the leaves of one more tree, whose root stands for the dataset.

Leaves are hashed where the rows are read, put in order by ranges and numbered, so the texts are never shuffled. Trees are
cut into superblocks of 2**LEVELS consecutive nodes. Going up, a superblock is reduced to one node, a node of the next
round; a round has a thousandth of the rows of the one before. Going down, the nodes of a superblock are cogrouped with what
stands outside of it on the way to the root, and one function finishes the local reduction, joins inner and outer siblings
to proofs and folds them. No tree and no level is in one task.

Null fields are hashed as ``-``, a null lang is a tree of its own and comes first, null doc_ids come first in their tree and
are never tampered with. Rows that repeat an id stand in order of their leaves; equal rows have equal leaves but proofs of
their own. Texts are hashed whole. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stash

#: Height of a superblock: it holds 2**LEVELS nodes at most.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """The hash of a row's fields, each with its length in bytes."""
    written = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*written), 256)


def node(*digests: str) -> str:
    """The hash of digests one after the other."""
    return sha256("".join(digests).encode("ascii")).hexdigest()


def height(n: int) -> int:
    """Levels between ``n`` leaves and their root."""
    return (n - 1).bit_length()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of every level, from the given ones up; the last node of an odd number is hashed alone."""
    found = [nodes]
    for _ in range(levels):
        nodes = [node(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        found.append(nodes)
    return found


def siblings(levels: list[list[str]], at: int) -> str:
    """The way of a node to the top of its superblock: per level ``L`` or ``R`` and a sibling on that side, or ``-`` for none."""
    way = []
    for nodes in levels[:-1]:
        other = at ^ 1
        way.append(("R" if other > at else "L") + nodes[other] if other < len(nodes) else "-")
        at >>= 1
    return "".join(way)


def steps(way: str) -> list[tuple[str, str]]:
    """Sides and digests of a way."""
    found, k = [], 0
    while k < len(way):
        size = 0 if way[k] == "-" else 64
        found.append((way[k], way[k + 1 : k + 1 + size]))
        k += 1 + size
    return found


def proof_digest(way: list[tuple[str, str]]) -> str:
    return node(*(digest for _, digest in way))


def folded(digest: str, way: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for side, other in way:
        digest = node(other, digest) if side == "L" else node(digest, other)
    return digest


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the number within ``tree``, and ``n``, the tree's size: rows are sorted by ranges, and what stands before a range is added.

    ``order`` ends with a column that no two rows share, so that ranges cut groups of equal rows too.
    """
    at = F.monotonically_increasing_id()
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    sorted_ = stash(rows.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys).withColumns({"part": F.spark_partition_id(), "at": at}), "ordered")
    sizes = sorted_.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("m"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")  # a row a range
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("tree", "part", (F.coalesce(F.sum("m").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("m").over(tree).alias("n"))
    return sorted_.join(starts, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


_NODE = "tree string, pos bigint, n bigint, digest string"


def _up(levels: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The top of a superblock: one node of the next round."""
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        top = reduced(table.column("digest").to_pylist(), min(levels, height(n)))[-1][0]
        return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "n": pa.array([-(-n >> levels)], pa.int64()), "digest": [top]})

    return run


_WAY = "tree string, pos bigint, way string, subroot string, root string"


def _down(levels: int):
    def run(key: tuple, nodes: pa.Table, outer: pa.Table) -> pa.Table:
        """The ways of a superblock's nodes, its own part first."""
        nodes = nodes.sort_by("pos")
        inner = reduced(nodes.column("digest").to_pylist(), min(levels, height(nodes.column("n")[0].as_py())))
        rest, subroot, root = (outer.column(c)[0].as_py() for c in ("way", "subroot", "root"))
        ways, m = [siblings(inner, k) + rest for k in range(nodes.num_rows)], nodes.num_rows
        return pa.table({"tree": nodes.column("tree"), "pos": nodes.column("pos"), "way": ways, "subroot": [subroot] * m, "root": [root] * m})

    return run


_PROVEN = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proven(levels: int):
    def run(key: tuple, leaves: pa.Table, outer: pa.Table) -> pa.Table:
        """Finishes a superblock of leaves: local reduction, proofs and folds at once."""
        leaves = leaves.sort_by("pos")
        digests, given = leaves.column("digest").to_pylist(), leaves.column("given").to_pylist()
        inner = reduced(digests, min(levels, height(leaves.column("n")[0].as_py())))
        rest, subroot, root = (outer.column(c)[0].as_py() for c in ("way", "subroot", "root"))
        rest, proofs, tops = steps(rest), [], []
        for k, digest in enumerate(given):
            way = steps(siblings(inner, k)) + rest
            proofs.append(proof_digest(way))
            tops.append(folded(digest, way))
        m = len(digests)
        return pa.table({
            "doc_id": leaves.column("doc_id"), "leaf": leaves.column("digest"), "subroot": [subroot] * m, "root": [root] * m,
            "proof_sha256": proofs, "folded_root": tops, "verified": [t == root for t in tops],
        })

    return run


def _block(levels: int) -> Column:
    return F.shiftright("pos", levels).alias("block")


def rounds(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes of every round, up to the one whose trees have a node each."""
    found = [nodes]
    while (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        nodes = stash(nodes.groupBy("tree", _block(levels)).applyInArrow(_up(levels), _NODE), "round")
        found.append(nodes)
    return found


def ways(found: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """Ways of the nodes of the second round of ``found`` from those of its last one (``top``: tree, pos, way, subroot, root)."""
    for nodes in reversed(found[1:-1]):
        outer = top.groupBy("tree", F.col("pos").alias("block"))
        top = nodes.groupBy("tree", _block(levels)).cogroup(outer).applyInArrow(_down(levels), _WAY)
    return top


def forest(leaves: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of the trees of ``leaves`` (tree, pos, n, digest, ...), and the ways of their tops to the root over all trees."""
    trees = rounds(leaves, levels)
    roots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    top = stash(numbered(roots, ["name"]), "roots")
    over = rounds(top.select("tree", "pos", "n", "digest"), levels)
    start = over[-1].select("tree", "pos", F.lit("").alias("way"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    outer = ways([over[0], *over], start, levels)  # down to the tree roots themselves
    outer = top.select("pos", "name", "digest").join(outer.select("pos", "way", "root"), "pos")
    return trees, outer.select(F.col("name").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "way", F.col("digest").alias("subroot"), "root")


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaf, subroot, root, proof digest and folded root of every row; every seventh id (by crc32) is folded from a tampered row."""
    small_batches(docs.sparkSession)
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    tampered = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 0
    leaves = docs.select(
        doc_id.cast("bigint").alias("doc_id"), F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("tree"), leaf(*map(F.col, FIELDS)).alias("digest"),
        F.when(tampered, leaf(doc_id, source, lang, n_chars + 1, text)).alias("other"), F.monotonically_increasing_id().alias("uid"),
    )
    leaves = stash(leaves, "leaves")
    leaves = stash(numbered(leaves, ["doc_id", "digest", "uid"]).select("tree", "pos", "n", "digest", "doc_id", F.coalesce("other", "digest").alias("given")), "numbered")
    found, top = forest(leaves, levels)
    outer = ways(found, top, levels)
    return leaves.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(_proven(levels), _PROVEN)
