"""Connected components of a link table by alternating star operations.

Every round is joins and combinable minima over (node, node) rows, written to the shared folder, so no
component is ever gathered in a task. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import written


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Rows (n, m): every m that ``keep`` accepts is hung on the smallest node around n."""
    roots = written(pairs.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("r")), "roots")
    return pairs.join(roots, "n").where(keep)


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m")).union(edges.select("b", "a"))
    joined = _star(both, F.col("m") > F.col("n"))
    return joined.select(F.col("m").alias("a"), F.col("r").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    joined = _star(down, F.lit(True))
    moved = joined.where(F.col("m") != F.col("r")).select(F.col("m").alias("a"), F.col("r").alias("b"))
    return moved.union(joined.select(F.col("n").alias("a"), F.col("r").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 31))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link to another one; component: its smallest node.

    Links are undirected; repeated links, loops and links with a null end change nothing. No links: no rows.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = written(edges.distinct(), "links")
    state = _state(edges)
    while state[0]:
        edges = written(_small(written(_large(edges), "stars")), "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return written(nodes.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "components")
