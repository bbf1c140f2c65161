"""Merkle manifest of a dataset: a digest per row, a tree per group, one root over the groups.

Nodes of a group are cut into aligned blocks of ``arity ** height``.  A block keeps each of
its levels as one string of digests in a row, all of them 64 characters, so the level above
is the hash of its fixed-width substrings, and what stands around a node in its run are two
substrings more.  The roots of the blocks are the leaves of the next, smaller tree, until a
group fits one block; the roots of the groups then make the last tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from weftline.llm.runs import stored
from weftline.plans.ordered import positions

#: Characters of a digest.
WIDTH = 64


def row_digest(*fields: Column) -> Column:
    """The leaf of a row: SHA-256 over its fields, each ``-`` if null, else bytes, ``:``, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to by its path, an array of (left, right) digests."""
    return F.aggregate(path, leaf, lambda digest, step: F.sha2(F.concat(step["left"], digest, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest over all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _hashed(level: Column, arity: int) -> Column:
    """The level above, from the fixed-width substrings of a level."""
    run = arity * WIDTH
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / run).cast("int"))
    return F.array_join(F.transform(runs, lambda i: F.sha2(F.substring(level, i * run + 1, F.lit(run)), 256)), "").cast("binary")


def _stage(nodes: DataFrame, arity: int, height: int, label: str) -> DataFrame:
    """Blocks (group, n, block, entries, levels, depth, top) of nodes (group, n, pos, digest, load)."""
    block = F.floor(F.col("pos") / arity**height).cast("long").alias("block")
    entry = F.struct("pos", "digest", "load")
    blocks = nodes.groupBy("group", "n", block).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    # a tree of n leaves has as many levels above them as there are powers of the arity below n
    depth = sum((F.col("n") > arity**i).cast("int") for i in range(height))
    first = F.array(F.array_join(F.transform("entries", lambda e: e["digest"]), "").cast("binary"))
    steps = F.filter(F.sequence(F.lit(1), F.lit(height)), lambda i: i <= F.col("depth"))
    blocks = blocks.withColumn("depth", depth).withColumn(
        "levels", F.aggregate(steps, first, lambda made, _: F.concat(made, F.array(_hashed(F.element_at(made, -1), arity))))
    )
    return stored(blocks.withColumn("top", F.element_at("levels", -1).cast("string")), label)


def _unfold(blocks: DataFrame, upper: DataFrame, arity: int, height: int) -> DataFrame:
    """A row per node: (group, load, digest) with its path and what ``upper`` says of its block."""
    others = [c for c in upper.columns if c not in ("group", "block", "path")]
    upper = upper.select(F.col("group").alias("_group"), F.col("block").alias("_block"), F.col("path").alias("_above"), *others)
    joined = blocks.join(upper, F.col("group").eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block")))
    powers = F.array(*[F.lit(arity**i) for i in range(height)])

    def path(at: Column) -> Column:
        def step(i: Column) -> Column:
            level, index = F.get("levels", i), F.floor(at / F.get(powers, i)).cast("int")
            run = (index - index % arity).cast("int")
            left = F.substring(level, run * WIDTH + 1, (index - run) * WIDTH)
            right = F.substring(level, (index + 1) * WIDTH + 1, (run + arity - 1 - index) * WIDTH)
            return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))

        below = F.filter(F.sequence(F.lit(0), F.lit(height - 1)), lambda i: i < F.col("depth"))
        return F.transform(below, step)

    node = F.transform("entries", lambda e, i: F.struct(e["load"].alias("load"), e["digest"].alias("digest"), path(i).alias("path")))
    out = joined.select("group", "_above", *others, F.explode(node).alias("_node"))
    return out.select("group", "_node.load", "_node.digest", F.concat("_node.path", "_above").alias("path"), *others)


def _above(blocks: DataFrame, arity: int, height: int, label: str) -> DataFrame:
    """(group, block, path, subroot): the path from each block's top to the root of its group."""
    size = arity**height
    if (blocks.agg(F.max("n")).head()[0] or 0) <= size:
        empty = F.array().cast("array<struct<left:string,right:string>>")
        return blocks.select("group", "block", empty.alias("path"), F.col("top").alias("subroot"))
    nodes = blocks.select(
        "group", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("pos"), F.col("top").alias("digest"), F.col("block").alias("load")
    )
    blocks = _stage(nodes, arity, height, label)
    return _unfold(blocks, _above(blocks, arity, height, label), arity, height).select("group", F.col("load").alias("block"), "path", "subroot")


def manifest(
    rows: DataFrame, leaf: Column, *, id_col: str = "doc_id", group_col: str = "lang", keep: Sequence[str] = (), arity: int = 2, height: int = 6
) -> DataFrame:
    """``keep`` of each row, with ``leaf``, ``subroot``, ``root`` and ``path``.

    Per value of ``group_col`` the leaves ascend by ``id_col``; every ``arity`` nodes in a
    row, a shorter last run too, become the hash of their digests in hexadecimal, until one
    is left: the subroot.  Subroots, ordered by group, null first and else by bytes, lead to
    the root in the same way.  ``path`` has a step per level, from the leaf to the root, with
    the digests that stand ``left`` and ``right`` in the run of the node, so
    ``fold(leaf, path)`` is the root.  ``height`` is the number of levels in a block.

    A null group is a group; null ids come first in theirs.  Rows of equal id are ordered by
    their leaves, so the tree is defined; equal rows have equal leaves.  A single row is its
    own subroot and root, with an empty path.  No rows, no result.  ``keep`` may use any names
    but ``leaf``, ``subroot``, ``root``, ``path``; its values must be orderable.  Of the other
    columns nothing is looked at but what ``leaf`` reads.
    """
    if arity < 2 or height < 1:
        raise ValueError("arity must be 2 or more, height 1 or more")
    load = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    leaves = rows.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf.alias("digest"), load.alias("load"))
    leaves = positions(leaves, [F.col("group").asc_nulls_first(), F.col("id").asc_nulls_first(), "digest"], "place")
    spans = leaves.groupBy(F.col("group").alias("_group")).agg(F.min("place").alias("_first"), F.count("*").alias("n"))
    leaves = leaves.join(spans, F.col("group").eqNullSafe(F.col("_group")))
    leaves = leaves.select("group", "n", (F.col("place") - F.col("_first")).alias("pos"), "digest", "load")
    blocks = _stage(leaves, arity, height, "merkle-blocks")
    above = stored(_above(blocks, arity, height, "merkle-above"), "merkle-paths")

    tops = positions(above.where("block = 0").select(F.col("group").alias("load"), F.col("subroot").alias("digest")), [F.col("load").asc_nulls_first()], "pos")
    tops = tops.select(F.lit(0).alias("group"), F.lit(tops.count()).cast("long").alias("n"), "pos", "digest", "load")
    tops = _stage(tops, arity, height, "merkle-groups")
    tops = _unfold(tops, _above(tops, arity, height, "merkle-groups"), arity, height)
    tops = tops.select(F.col("load").alias("_of"), F.col("path").alias("_last"), F.col("subroot").alias("root"))
    above = above.join(tops, F.col("group").eqNullSafe(F.col("_of")))
    above = above.select("group", "block", F.concat("path", "_last").alias("path"), "subroot", "root")
    out = _unfold(blocks, above, arity, height)
    return out.select(*[F.col("load")[c].alias(c) for c in keep], F.col("digest").alias("leaf"), "subroot", "root", "path")
