"""Near copies: documents whose sets of word shingles have a Jaccard similarity of at least 0.8, verified exactly.

One pass over the texts gives each a node (a hash of its set of shingles), its SimHash and the keys of min-hash bands. Two sets of
similarity s share a band with probability 1 - (1 - s^3)^21, 0.9999997 at 0.8. Pairs that share a band, and pairs that the SimHash index
proposes, are candidates; a pair is a link only if the sets themselves, joined to it, are that similar.

A large group of near copies, or of documents with a passage in common, makes no square of pairs: a band's nodes are first compared
with its smallest node, then with some of them. Nodes that share a band and are still in different components meet only over their
rarest shingles: of two sets that similar, the first fifth of each, in one order of all shingles, have one in common. What is
left out is connected already or not that similar, so the components are those of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.llm.components import components
from tagloom.llm.store import batches_of, small_or_shuffled, values, written

BANDS, ROWS = 21, 3
BLOCK = 8192
ROUNDS = (16, None)
_RANDOM = np.random.default_rng(5).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64)
FLIP, FACTOR, MIX = _RANDOM[0], _RANDOM[1] | np.uint64(1), (_RANDOM[2] | np.uint64(1)).reshape(BANDS, ROWS)
ID = ["x", "y"]


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the min-hash signature; none for an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(shingles), BLOCK):
        least = np.minimum(least, ((shingles[i : i + BLOCK] ^ FLIP[:, None]) * FACTOR[:, None]).min(1))
    return (least.reshape(BANDS, ROWS) * MIX).sum(1, dtype=np.uint64).view(np.int64)


def identified(documents: DataFrame, text: str, x: str = "x", y: str = "y") -> DataFrame:
    """Rows with 128 bits (x, y) that stand for their text; a null text counts as an empty one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return documents.withColumns({x: F.xxhash64(whole), y: F.xxhash64(F.lit(7), whole)})


def _signatures(rows: DataFrame, words: int) -> DataFrame:
    """(key, x, y, node, n, fp, bands) for rows (key, x, y, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            node, n, fp, bands = [], [], [], []
            for text in values(batch.column(3)):
                hashes = simhash.shingle_hashes(text, words)
                distinct = np.unique(np.array(hashes, np.uint64))
                node.append(xxhash.xxh64_intdigest(distinct.tobytes(), 3))
                n.append(len(distinct))
                fp.append(simhash.majority(hashes))
                bands.append(band_keys(distinct))
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            flat = np.concatenate([*bands, np.zeros(0, np.int64)])
            signed = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (node, fp)]
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns = [*batch.columns[:3], signed[0], pa.array(n, pa.int64()), signed[1], lists]
            yield pa.RecordBatch.from_arrays(columns, ["key", "x", "y", "node", "n", "fp", "bands"])

    return rows.mapInArrow(run, "key bigint, x bigint, y bigint, node bigint, n bigint, fp bigint, bands array<bigint>")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, s) with the distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            for node, text in zip(batch.column(0), values(batch.column(1))):
                s = np.unique(np.array(simhash.shingle_hashes(text, words), np.uint64)).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), pa.array(s))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.int64()), lists], ["node", "s"])

    return texts.mapInArrow(run, "node bigint, s array<bigint>")


def _comparable(n: Column, m: Column) -> Column:
    """Sets of such sizes can reach a similarity of 0.8."""
    return (n * 5 >= m * 4) & (m * 5 >= n * 4)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of at least 4/5."""
    left = sets.select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(both * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b")


def _indexed(signatures: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Candidate pairs (a, b) of the SimHash index: nodes of one fingerprint, and of fingerprints near each other."""
    nodes = signatures.where("n > 0").select("node", "n", "fp").distinct()
    first = written(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "fingerprints")
    same = nodes.join(first, "fp").select(F.col("first.node").alias("a"), F.col("first.n").alias("na"), F.col("node").alias("b"), F.col("n").alias("nb"))
    links = simhash.near_links(first.select("fp", F.col("fp").alias("node")), radius, blocks).distinct()
    ends = [first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first")) for c in ("a", "b")]
    near = links.join(ends[0], "a").join(ends[1], "b").select(
        F.col("a_first.node").alias("a"), F.col("a_first.n").alias("na"), F.col("b_first.node").alias("b"), F.col("b_first.n").alias("nb")
    )
    return same.unionByName(near).where((F.col("a") != F.col("b")) & _comparable(F.col("na"), F.col("nb"))).select("a", "b")


def _rare_pairs(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of nodes (node, n, c) in different components c: those with a shingle in common among the first
    n - ceil(0.8 n) + 1 of each, shingles ordered from the rarest up, and enough of both sets behind it. A pair of similarity 0.8 or
    more always has one: its first common shingle, which all of its (n + m) * 4 / 9 or more common ones follow or are."""
    shingles = written(sets.join(nodes, "node").select("node", "n", "c", F.explode("s").alias("k")), "shingles")
    often = shingles.groupBy("k").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("often", "k"))
    first = shingles.join(often, "k").withColumn("at", place).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 4 / 5) + 1)
    first = written(first.where("often > 1").select("k", "node", "n", "c", (F.col("n") - F.col("at")).alias("left")), "rare_shingles")
    other = first.select("k", F.col("node").alias("a"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("left").alias("rest"))
    enough = (F.least("left", "rest") + 1) * 9 >= (F.col("n") + F.col("m")) * 4
    pairs = first.join(other, "k").where((F.col("c") != F.col("d")) & (F.col("a") < F.col("node")) & _comparable(F.col("n"), F.col("m")) & enough)
    return pairs.select("a", F.col("node").alias("b")).distinct()


def _components(docs: DataFrame, signatures: DataFrame, text: str, words: int, radius: int, blocks: int) -> DataFrame:
    """(node, component) for nodes that a link reaches."""
    keyed = signatures.select(F.explode("bands").alias("k"), "node", "n")
    shared = keyed.groupBy("k").agg(F.min(F.struct("node", "n")).alias("lo"), F.max("node").alias("hi")).where("lo.node <> hi")
    shared = written(shared.select("k", F.col("lo.node").alias("lo"), F.col("lo.n").alias("m")), "shared_bands")
    members = written(keyed.join(small_or_shuffled(shared), "k").select("k", "lo", "m", "node", "n").distinct(), "band_members")
    first = members.where((F.col("node") != F.col("lo")) & _comparable(F.col("n"), F.col("m"))).select(F.col("lo").alias("a"), F.col("node").alias("b"))
    first = written(first.unionByName(_indexed(signatures, radius, blocks)).distinct(), "first_pairs")

    wanted = members.select("node").union(first.select("a")).union(first.select("b")).distinct()
    texts = signatures.groupBy("node").agg(F.min(F.struct(*ID)).alias("t")).join(wanted, "node", "left_semi").select("t.x", "t.y", "node")
    texts = identified(docs.select(F.col(text).alias("text")), "text").join(small_or_shuffled(written(texts, "wanted_texts")), ID)
    sets = written(_sets(texts.groupBy("node").agg(F.first("text").alias("text")), words), "shingle_sets")

    links = written(_verified(first, sets), "links")
    for some in ROUNDS:
        found = components(links, "a", "b")
        named = members.select("k", "node", "n").join(found, "node", "left").select("k", "node", "n", F.coalesce("component", "node").alias("c"))
        named = written(named, "band_components")
        mixed = named.groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi").select("k", "size")
        mixed = written(mixed, "mixed_bands")
        if mixed.isEmpty():
            break
        named = written(named.join(small_or_shuffled(mixed), "k"), "mixed_members")
        if some is None:
            pairs = _rare_pairs(written(named.select("node", "n", "c").distinct(), "mixed_nodes"), sets)
        else:
            chosen = named.where(F.pmod(F.xxhash64("node", "k"), "size") < some)
            chosen = chosen.select("k", F.col("node").alias("a"), F.col("n").alias("m"), F.col("c").alias("d"))
            pairs = named.join(chosen, "k").where((F.col("c") != F.col("d")) & _comparable(F.col("n"), F.col("m")))
            pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        links = written(links.unionByName(_verified(written(pairs, "pairs"), sets)), "links")
    return components(links, "a", "b")


def without_near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, radius: int = 7, blocks: int = 9) -> DataFrame:
    """One row of each group of near copies: that with the smallest key, a missing key being the greatest, then by its text's hash.

    Rows are told apart by key and text: rows of one key or without one are copies only if their texts are. Texts without words
    equal each other. Columns and the other rows are as they were; an empty table gives an empty one.
    """
    rows = identified(documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), "text").select("key", *ID, "text")
    signatures = written(_signatures(rows, words), "signatures")
    found = _components(documents, signatures, text, words, radius, blocks)
    named = signatures.select("key", *ID, "node").join(found, "node", "left").select("key", *ID, F.coalesce("component", "node").alias("c"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", *ID)
    groups = written(named.groupBy("c").agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "groups")
    touched = named.join(groups.select("c", "kept"), "c").select("key", *ID, (order == F.col("kept")).alias("kept")).distinct()
    touched = small_or_shuffled(written(touched.select(*(F.col(c).alias(f"_copy_{c}") for c in ("key", *ID, "kept"))), "touched"))
    told = identified(documents, text, "_row_x", "_row_y").withColumn("_row_key", F.col(key).cast("long"))
    same = (F.col("_row_x") == F.col("_copy_x")) & (F.col("_row_y") == F.col("_copy_y")) & F.col("_row_key").eqNullSafe(F.col("_copy_key"))
    told = told.join(touched, same, "left")
    once = told.where("_copy_kept").dropDuplicates(["_row_key", "_row_x", "_row_y"])
    return told.where("_copy_kept is null").unionByName(once).select(*documents.columns)
