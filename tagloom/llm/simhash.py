"""Near-duplicate documents by SimHash and a Gray-order hierarchical index over the fingerprints.

Fingerprints are computed per document. Equal fingerprints become one class; all further work is on distinct
fingerprints of eight bytes. They are cut into ``blocks`` bit blocks: two fingerprints that differ in at most
``radius`` bits agree in at least ``blocks - radius`` of them, so every choice of that many blocks is a table and
its bits are the key by which Spark deals fingerprints out. A key held by many fingerprints is cut into chunks and
every two chunks meet in a task of their own, so no task receives an unbounded group.

Inside a task each key's fingerprints are sorted by Gray rank, in which neighbours differ in few bits, and form a
tree: an upper node holds the bits on which all fingerprints below it agree. The tree is joined with itself from the
root; the differences on bits that become fixed on the way down accumulate, and a pair of nodes above the radius
is pruned with all that lies below. Of the links that remain a task returns a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.components import components
from tagloom.llm.store import batches_of, values, written

BITS = 64
FANOUT = 8
CHUNK = 512
BUFFER_ROWS = 200_000
EXPANSIONS = 2_000_000


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """Hashes of the shingles of ``words`` words, repeats included; a shorter text is one shingle, one without words has none."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    size, digest = min(words, len(parts)), xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, ends[size - 1 :])]


def majority(hashes: list[int]) -> int:
    """SimHash of shingle hashes; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = np.array(hashes[i : i + 65_536], ">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int) -> int:
    """SimHash of one text over shingles of ``words`` words, repeats included; no words: 0."""
    return majority(shingle_hashes(text, words))


def fingerprints(documents: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(key, fp) for every row; ``fp`` is the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches):
            fps = np.fromiter((fingerprint(t, words) for t in values(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["key", "fp"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key bigint, fp bigint")


def tables(radius: int, blocks: int) -> list[tuple[tuple[int, int], ...]]:
    """For each table the (shift, width) of the bit blocks that make up its key."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    pieces = [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]
    return list(combinations(pieces, blocks - radius))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def build_levels(codes: np.ndarray, groups: np.ndarray) -> list[dict]:
    """Levels of one tree per group, leaves first, over codes sorted by (group, Gray rank).

    A node has ``agree``: the bits shared by all codes below; ``bits``: their values; and its children's range.
    """
    full = np.full(len(codes), ~np.uint64(0))
    level = {"agree": full, "bits": codes, "group": groups, "first": None, "size": None}
    levels = [level]
    while True:
        group = level["group"]
        begins = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        sizes = np.diff(np.r_[begins, len(group)])
        if sizes.max() == 1:
            return levels
        within = np.arange(len(group)) - np.repeat(begins, sizes)
        starts = np.flatnonzero(within % FANOUT == 0)
        ones = np.bitwise_and.reduceat(level["bits"], starts)
        some = np.bitwise_or.reduceat(level["bits"], starts)
        agree = np.bitwise_and.reduceat(level["agree"], starts) & ~(ones ^ some)
        level = {
            "agree": agree, "bits": ones & agree, "group": group[starts],
            "first": starts, "size": np.diff(np.r_[starts, len(group)]),
        }
        levels.append(level)


def close_pairs(codes: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of one group whose codes differ in at most ``radius`` bits, in blocks of bounded size."""
    levels = build_levels(codes, groups)
    roots = np.arange(len(levels[-1]["bits"]))
    none = np.zeros(len(roots), np.uint64)
    todo = [(len(levels) - 1, roots, roots, none, np.zeros(len(roots), np.int64))]
    while todo:
        height, left, right, seen, differ = todo.pop()
        if height == 0:
            other = left != right
            yield left[other], right[other]
            continue
        node = levels[height]
        fan = node["size"][left] * node["size"][right]
        if len(left) > 1 and fan.sum() > EXPANSIONS:
            half = len(left) // 2
            todo += [(height, *(x[cut] for x in (left, right, seen, differ))) for cut in (slice(half), slice(half, None))]
            continue
        pair = np.repeat(np.arange(len(left)), fan)
        place = np.arange(len(pair)) - np.repeat(np.cumsum(fan) - fan, fan)
        wide = node["size"][right][pair]
        a, b = node["first"][left][pair] + place // wide, node["first"][right][pair] + place % wide
        kept = a <= b
        a, b, pair = a[kept], b[kept], pair[kept]
        below = levels[height - 1]
        both = below["agree"][a] & below["agree"][b]
        new = (below["bits"][a] ^ below["bits"][b]) & both & ~seen[pair]
        total = differ[pair] + np.bitwise_count(new)
        near = total <= radius
        todo.append((height - 1, a[near], b[near], both[near], total[near]))


def forest(size: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of ``size`` items the smallest index that the pairs connect it with."""
    root = np.arange(size)
    for a, b in pairs:
        while len(a):
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
    return root


def _links(radius: int):
    """A task: runs of equal group columns, sorted together, give (a, b) rows of node links."""

    def solve(group: np.ndarray, codes: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(codes), group))
        group, codes, nodes = group[order], codes[order], nodes[order]
        root = forest(len(codes), close_pairs(codes, group, radius))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches_of(batches):
            keys = [batch.column(i).to_numpy() for i in range(4)]
            held.append((np.stack(keys), batch.column(4).to_numpy().view(np.uint64), batch.column(5).to_numpy()))
            rows += batch.num_rows
            if rows < BUFFER_ROWS:
                continue
            keys, codes, nodes = np.concatenate([x[0] for x in held], 1), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if not len(turns):
                continue
            cut = turns[-1]
            yield solve(np.searchsorted(turns[:-1], np.arange(cut), "right"), codes[:cut], nodes[:cut])
            held, rows = [(keys[:, cut:], codes[cut:], nodes[cut:])], keys.shape[1] - cut
        if rows:
            keys, codes, nodes = np.concatenate([x[0] for x in held], 1), *(np.concatenate([x[i] for x in held]) for i in (1, 2))
            turns = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            yield solve(np.searchsorted(turns, np.arange(keys.shape[1]), "right"), codes, nodes)

    return run


def near_links(nodes: DataFrame, radius: int, blocks: int) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``radius`` bits; ``nodes`` has distinct ``fp`` and ``node``."""
    pieces = []
    for number, table in enumerate(tables(radius, blocks)):
        key, width = F.lit(0).cast("long"), 0
        for shift, bits in table:
            part = F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << bits) - 1 if bits < BITS else -1))
            key, width = key.bitwiseOR(F.shiftleft(part.cast("long"), width)), width + bits
        pieces.append(F.struct(F.lit(number).alias("t"), key.alias("k")))
    dealt = nodes.select("fp", "node", F.inline(F.array(*pieces)))
    crowded = dealt.groupBy("t", "k").count().where(F.col("count") > CHUNK)
    crowded = written(crowded.select("t", "k", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "crowded")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    met = (
        dealt.join(crowded, ["t", "k"], "left")
        .select("t", "k", "fp", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
        .select("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "node")
        .repartition("t", "k", "i", "j")
        .sortWithinPartitions("t", "k", "i", "j")
    )
    return met.mapInArrow(_links(radius), "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, radius: int = 3, blocks: int | None = None
) -> DataFrame:
    """(key, fp, component) per row: the smallest key that links of at most ``radius`` bits reach.

    A null or empty text has fingerprint 0 and is linked like any other. Rows of one key are one document: they share
    a component. A row without a key gets its fingerprint's component if keyed rows have that fingerprint, else null.
    Repeated rows come back repeated; an empty table gives an empty one; other columns play no part.
    """
    fps = written(fingerprints(documents, key, text, words), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("key").alias("node")), "nodes")
    keyed = fps.where("key is not null").groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi")
    ends = fps.join(keyed.select("key"), "key", "left_semi").join(nodes, "fp").select(F.col("key").alias("a"), F.col("node").alias("b"))
    links = near_links(nodes.where("node is not null"), radius, blocks or radius + 1).unionByName(ends)
    found = components(links, "a", "b")
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return fps.join(written(named, "classes"), "fp", "left").select("key", "fp", "component")
