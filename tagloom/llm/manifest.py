"""Merkle manifest of a data set: one tree per group of rows, their roots in one tree above, proofs for every row.

Only every few levels are written ("checkpoints"). What lies between is computed again when proofs are read: the stored nodes
below one aligned subtree, a bounded number, make its missing interior nodes, these give each stored node its siblings up to the
next checkpoint, and are dropped. A row's proof is its own subtree's part and that of the stored node above, from the top down.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import written
from tagloom.operators.ranking import numbered

#: Children of a node, and levels from one checkpoint to the next: a subtree stands on at most FANOUT ** STEP stored nodes.
FANOUT, STEP = 2, 4

PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """Digest of a row."""
    return F.sha2(F.concat(*map(field, values)), 256)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(proof, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All sibling digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "")


def _up(size: Column | str, width: int) -> Column:
    """Nodes that stand on ``size`` nodes when each has ``width`` of them below it."""
    size = F.col(size) if isinstance(size, str) else size
    return F.floor((size + (width - 1)) / width)


def _subtrees(nodes: DataFrame, fanout: int, step: int) -> DataFrame:
    """One row per aligned subtree of more than one node's group: its stored nodes ``members`` and all ``level0`` ... ``level<step>``."""
    others = [c for c in nodes.columns if c not in ("grp", "size", "at")]
    members = F.sort_array(F.collect_list(F.struct("at", *others)))
    block = F.floor(F.col("at") / fanout**step).alias("block")
    out = nodes.where("size > 1").groupBy("grp", "size", block).agg(members.alias("members"))
    out = out.withColumn("level0", F.transform("members", lambda m: m["hash"]))
    for i in range(step):
        below = F.col(f"level{i}")
        runs = F.sequence(F.lit(0), F.floor((F.size(below) - 1) / fanout).cast("int"))
        above = F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(below, r * fanout + 1, F.lit(fanout)), ""), 256))
        out = out.withColumn(f"level{i + 1}", F.when(_up("size", fanout**i) > 1, above).otherwise(below))
    return out


def checkpoints(leaves: DataFrame, fanout: int = FANOUT, step: int = STEP) -> list[DataFrame]:
    """Stored levels of the trees over (grp, at, hash, size): ``at`` numbers a group's nodes from 0, ``size`` counts them.

    The first is ``leaves``; each further one lies ``step`` levels higher and holds the groups with more than one node below it.
    A group's root is its only node in the last checkpoint that holds it.
    """
    found = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        tops = _subtrees(found[-1].select("grp", "at", "hash", "size"), fanout, step)
        above = tops.select("grp", F.col("block").alias("at"), F.get(f"level{step}", F.lit(0)).alias("hash"), _up("size", fanout**step).alias("size"))
        found.append(written(above, "checkpoint"))
        most = -(-most // fanout**step)
    return found


def roots(stored: list[DataFrame]) -> DataFrame:
    """(grp, hash) of every group."""
    found = [level.where("size = 1").select("grp", "hash") for level in stored]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _siblings(place: Column, size: Column, fanout: int, step: int) -> Column:
    """Of the subtree's stored node number ``place``: siblings at each level that is below the root."""
    parts = []
    for i in range(step):
        level, at = F.col(f"level{i}"), F.floor(place / fanout**i).cast("int")
        own = at % fanout
        left = F.array_join(F.slice(level, at - own + 1, own), "")
        right = F.array_join(F.slice(level, at + 2, F.lit(fanout - 1) - own), "")
        parts.append(F.when(_up(size, fanout**i) > 1, F.struct(left.alias("left"), right.alias("right"))))
    return F.filter(F.array(*parts), lambda s: s.isNotNull())


def proofs(stored: list[DataFrame], above: DataFrame, fanout: int = FANOUT, step: int = STEP) -> DataFrame:
    """The leaves' columns but ``size``, with ``proof``, the siblings from the leaf up, left to right.

    ``above`` (grp, proof) goes on from each group's root. Tables of paths are written for the stored levels, from the top down;
    the leaves' own proofs, by far the largest part, are only a plan and are never written here.
    """
    path = None
    for number, level in reversed(list(enumerate(stored))):
        names = [c for c in level.columns if c not in ("grp", "size")]
        single = level.where("size = 1").join(above, "grp").select("grp", *names, "proof")
        if path is not None:
            upper = path.select("grp", F.col("at").alias("block"), F.col("proof").alias("upper"))
            trees = _subtrees(level, fanout, step).join(upper, ["grp", "block"])
            place = lambda m, j: F.struct(*[m[n].alias(n) for n in names], F.concat(_siblings(j, F.col("size"), fanout, step), "upper").alias("proof"))
            single = single.unionByName(trees.select("grp", F.inline(F.transform("members", place))))
        path = written(single.select("grp", "at", "proof"), "paths") if number else single
    return path


@dataclass(frozen=True)
class Manifest:
    """Stored levels of the groups' trees and of the tree over their roots.

    The first of ``groups`` has the rows: (grp, key, hash, at, size) and the columns kept. ``grp`` is the group's name behind
    ``=``, or empty for the null group.
    """

    groups: list[DataFrame]
    top: list[DataFrame]
    fanout: int
    step: int

    def roots(self) -> DataFrame:
        """(grp, subroot, at): the groups' roots in order."""
        return self.top[0].select(F.col("key").alias("grp"), F.col("hash").alias("subroot"), "at")

    def root(self) -> DataFrame:
        """(root): one row; none for an empty data set."""
        return roots(self.top).select(F.col("hash").alias("root"))

    def proofs(self) -> DataFrame:
        """(grp, at, key, hash, columns kept, proof, subroot, root) of every row."""
        none = F.array().cast(PROOF)
        root = written(self.root().select(F.lit("").alias("grp"), none.alias("proof"), "root"), "root")
        over = proofs(self.top, root.drop("root"), self.fanout, self.step)
        over = over.join(root.drop("proof"), "grp").select(F.col("key").alias("grp"), "proof", F.col("hash").alias("subroot"), "root")
        over = written(over, "group_paths")
        rows = proofs(self.groups, over.select("grp", "proof"), self.fanout, self.step)
        return rows.join(over.select("grp", "subroot", "root"), "grp")


def built(rows: DataFrame, columns: Sequence[str], group: str, key: str, kept: dict[str, Column] | None = None, fanout: int = FANOUT, step: int = STEP) -> Manifest:
    """Manifest of a table: a row's leaf covers ``columns``, a group's leaves ascend by ``key``, groups by name (null first).

    Every row is a leaf, repeated ones and those without a key (first in their group) too; rows of one key are ordered by their
    digests. ``fanout`` neighbouring nodes, fewer at the end of a level, even one, make a node until one remains; a lone leaf is its
    group's root. Other columns play no part; ``kept`` adds computed ones to the leaves. An empty table has no root.
    """
    more = kept or {}
    name = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp")
    leaves = rows.select(name, F.col(key).alias("key"), leaf([F.col(c) for c in columns]).alias("hash"), *[c.alias(n) for n, c in more.items()])
    groups = checkpoints(numbered(written(leaves, "leaves"), ["key", "hash"], ["grp"], "at", "size"), fanout, step)
    names = numbered(roots(groups).withColumnRenamed("grp", "key"), ["key"], out="at", total="size").withColumn("grp", F.lit(""))
    return Manifest(groups, checkpoints(names, fanout, step), fanout, step)
