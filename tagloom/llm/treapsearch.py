"""Ranked search by a K2-treap: a compressed quadtree over the grid of terms and documents whose cells hold impact maxima.

Documents are dealt into blocks of bounded size, each inverted where it is read. A block's grid has the asked terms as rows,
numbered by frequency so that neighbours have alike weights, and its documents as columns in the order of their keys. An item's
terms follow their row paths down the tree together: a range of documents is opened in the order of the sum of its cells'
maxima, an upper bound of every score in it, and a block is done when no open range can enter the best ``k``. So nothing is
lost to the pruning. The blocks' best are ranked together per item.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.store import written
from tagloom.operators.ranking import numbered

# Fixed values of the ranking: what separates terms, and how counts and lengths make a score.
LETTERS = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
SCALE, COUNT_WEIGHT, LENGTH_WEIGHT, LENGTH_SHARE = 1_000_000_000, 1000, 8, 90

#: A block ends at so many documents or so many terms, whichever comes first (one long document: alone).
BLOCK_DOCUMENTS, BLOCK_TERMS = 4096, 4_000_000
#: Bytes of distinct asked terms up to which the executors drop other terms while they read; beyond, a join drops them.
MOST_VOCABULARY_BYTES = 32_000_000
#: Terms of the items that are searched for in one job.
JOB_TERMS = 1_000_000
#: Document ranges opened at once.
WIDTH = 64

_TO_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in LETTERS else 0x20 for c in range(256))
_ONES = np.array([bin(i).count("1") for i in range(16)], np.int64)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text with repeats: runs of digits, ASCII letters (lower-cased) and all characters beyond ASCII."""
    return text.translate(_TO_WORDS).split()


def _terms(text: pa.Scalar) -> list[bytes]:
    return terms_of(text.as_buffer().to_pybytes()) if text.is_valid else []


class Block:
    """Inverted lists of some documents, while they are read."""

    def __init__(self) -> None:
        self.places: dict[bytes, int] = {}
        self.terms, self.counts, self.lengths, self.sizes = array("i"), array("i"), array("i"), array("i")
        self.keys: list[pa.Array] = []

    def add(self, key: pa.Array, words: list[bytes], asked: frozenset[bytes] | None) -> None:
        found, places = Counter(words if asked is None else filter(asked.__contains__, words)), self.places
        self.terms.extend([places.setdefault(w, len(places)) for w in found])
        self.counts.extend(found.values())
        self.lengths.append(len(words))
        self.sizes.append(len(found))
        self.keys.append(key)

    def full(self) -> bool:
        return len(self.lengths) >= BLOCK_DOCUMENTS or len(self.terms) >= BLOCK_TERMS

    def batch(self, number: int) -> pa.RecordBatch:
        """A row per term, and one without a term that has the documents' lengths and keys."""
        terms, counts = np.frombuffer(self.terms, np.int32), np.frombuffer(self.counts, np.int32)
        documents = np.repeat(np.arange(len(self.sizes), dtype=np.int32), np.frombuffer(self.sizes, np.int32))
        order = np.argsort(terms, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=len(self.places)))]).astype(np.int32)
        lengths = np.frombuffer(self.lengths, np.int32)
        rows, keys = len(self.places) + 1, pa.concat_arrays(self.keys)
        lists = lambda flat, more: pa.ListArray.from_arrays(pa.array(np.append(ends, ends[-1] + len(more)).astype(np.int32)), pa.array(np.concatenate([flat, more])))
        empty = np.zeros(0, np.int32)
        key_ends = pa.array([0] * rows + [len(keys)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([number] * rows, pa.int64()), pa.array([*self.places, None], pa.binary()), lists(documents[order], empty), lists(counts[order], lengths), pa.ListArray.from_arrays(key_ends, keys)],
            ["block", "term", "documents", "counts", "keys"],
        )


def _spread(bits: np.ndarray) -> np.ndarray:
    """Put a zero before each of the low 31 bits."""
    x = bits.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | x << shift) & mask
    return x


class Treap:
    """Cells that hold anything, level by level from the whole grid to single entries; each has its maximum, and the inner ones
    a mask of their four quarters and the place of the first that is there."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        cells = _spread(rows) << 1 | _spread(columns)
        order = np.argsort(cells)
        cells, maxima = cells[order], values[order]
        levels = [(maxima, np.zeros(0, np.uint8), np.zeros(0, np.int64))]
        for _ in range(self.height):
            above = cells >> 2
            first = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            masks = np.bitwise_or.reduceat(np.left_shift(1, cells & 3).astype(np.uint8), first)
            cells, maxima = above[first], np.maximum.reduceat(maxima, first)
            levels.append((maxima, masks, first))
        levels.reverse()
        ends = np.cumsum([len(m) for m, _, _ in levels])
        self.maxima = np.concatenate([m for m, _, _ in levels])
        self.masks = np.concatenate([m for _, m, _ in levels])
        self.first = np.concatenate([f + end for (_, _, f), end in zip(levels, ends)])

    def quarters(self, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        """The cells' children in that quarter; -1: none."""
        masks = np.where(cells < 0, 0, self.masks[cells])
        place = self.first[cells] + _ONES[masks & ((1 << quarter) - 1)]
        return np.where(masks >> quarter & 1, place, -1)

    def best(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(columns, sums over the rows) of the ``k`` largest sums above 0, equal ones by ascending column."""
        cells = np.zeros((1, len(rows)), np.int64)
        start, level, bound = np.zeros(1, np.int64), np.zeros(1, np.int64), self.maxima[cells].sum(axis=1)
        columns, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(1, min(WIDTH, 65_536 // max(1, len(rows))))
        while len(bound):
            order = np.lexsort((start << (self.height - level), -bound))
            now, later = order[:width], order[width:]
            row_bits = rows[None, :] >> (self.height - 1 - level[now])[:, None] & 1
            below = np.concatenate([self.quarters(cells[now], 2 * row_bits + half) for half in (0, 1)])
            begin, depth = np.concatenate([2 * start[now], 2 * start[now] + 1]), np.tile(level[now] + 1, 2)
            bounds = np.where(below < 0, 0, self.maxima[below]).sum(axis=1)
            single = depth == self.height
            columns, sums = np.concatenate([columns, begin[single]]), np.concatenate([sums, bounds[single]])
            keep = np.lexsort((columns, -sums))[:k]
            keep = keep[sums[keep] > 0]
            columns, sums = columns[keep], sums[keep]
            cells, start, level, bound = (np.concatenate([old[later], new[~single]]) for old, new in ((cells, below), (start, begin), (level, depth), (bound, bounds)))
            live = bound > 0
            if len(sums) == k:
                live &= (bound > sums[-1]) | (bound == sums[-1]) & (start << (self.height - level) < columns[-1])
            cells, start, level, bound = cells[live], start[live], level[live], bound[live]
        return columns, sums


@dataclass(frozen=True)
class Index:
    """Inverted blocks (block, term, documents, counts, keys), and the corpus' counts."""

    blocks: DataFrame
    documents: int
    terms: int

    def frequencies(self) -> DataFrame:
        """(term, df): documents that hold a term."""
        return self.blocks.where("term is not null").groupBy("term").agg(F.sum(F.size("documents")).alias("df"))


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term): each item's distinct terms, as a written table. Rows of one key, or without one, are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms = [*dict.fromkeys(_terms(batch.column(1)[i]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(terms), pa.int32())), pa.array(terms, pa.binary())], ["item", "term"])

    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    return written(rows.mapInArrow(run, f"item {rows.schema['item'].dataType.simpleString()}, term binary").distinct(), "items")


def indexed(documents: DataFrame, asked: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> Index:
    """Inverted blocks of all documents; with ``asked`` (term), only of those terms (lengths and counts are always the whole text's).

    Every row is a document, repeated ones and those without a key too; a null text has no terms. Other columns play no part.
    """
    terms = None if asked is None else asked.select("term").distinct()
    if terms is not None and (terms.agg(F.sum(F.octet_length("term") + 60)).first()[0] or 0) <= MOST_VOCABULARY_BYTES:
        shared = documents.sparkSession.sparkContext.broadcast(frozenset(bytes(r["term"]) for r in terms.collect()))
    else:
        shared = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, number = shared.value if shared else None, Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(batch.num_rows):
                block.add(batch.column(0)[i : i + 1], _terms(batch.column(1)[i]), known)
                if block.full():
                    yield block.batch(number)
                    block, number = Block(), number + 1
        if block.keys:
            yield block.batch(number)

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"block long, term binary, documents array<int>, counts array<int>, keys array<{rows.schema['key'].dataType.simpleString()}>"
    blocks = written(rows.mapInArrow(run, schema), "blocks")
    lengths = blocks.where("term is null").select(F.explode("counts").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0)))
    held = lengths.first()
    if terms is not None and shared is None:
        blocks = blocks.join(terms, "term", "left_semi").unionByName(blocks.where("term is null"))
    return Index(blocks, *held)


def _weight(df: Column, documents: int) -> Column:
    return F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * df + 1).cast("double"))).cast("long")


def _block_best(block: pa.Table, index_counts: tuple[int, int], items: pa.Table, k: int, kinds: pa.Schema) -> pa.Table:
    """The best documents of one block for each of ``items`` (item, rows)."""
    documents, all_terms = index_counts
    valid = block["row"].is_valid()
    entries, about = block.filter(valid), block.filter(compute.invert(valid))
    if not entries.num_rows or not items.num_rows:
        return kinds.empty_table()
    keys, lengths = about["keys"].combine_chunks().flatten(), about["counts"].combine_chunks().flatten().to_numpy()
    order = compute.sort_indices(keys, null_placement="at_end").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    lists, counts = entries["documents"].combine_chunks(), entries["counts"].combine_chunks().flatten().to_numpy().astype(np.int64)
    sizes, columns = compute.list_value_length(lists).to_numpy(), lists.flatten().to_numpy()
    length = 100 - LENGTH_SHARE + LENGTH_SHARE * lengths[columns].astype(np.int64) * documents // all_terms
    impact = np.repeat(entries["weight"].to_numpy(), sizes) * (SCALE * counts // (COUNT_WEIGHT * counts + LENGTH_WEIGHT * length))
    asked, rows = np.unique(entries["row"].to_numpy(), return_inverse=True)
    treap = Treap(np.repeat(rows, sizes), place[columns], impact)
    found = []
    for item in range(items.num_rows):
        wanted = items["rows"][item].values.to_numpy()
        at = np.searchsorted(asked, wanted)
        held = at < len(asked)
        held[held] = asked[at[held]] == wanted[held]
        best, scores = treap.best(at[held], k) if held.any() else (np.zeros(0, np.int64),) * 2
        found.append((np.full(len(best), item), order[best], scores))
    item, document, score = (np.concatenate(x) for x in zip(*found))
    return pa.table([items["item"].take(pa.array(item)), keys.take(pa.array(document)), pa.array(score)], schema=kinds)


def _best_by_block(shared: Broadcast, counts: tuple[int, int], k: int):
    def run(block: pa.Table) -> pa.Table:
        items, keys = shared.value, block.schema.field("keys").type.value_type
        return _block_best(block, counts, items, k, pa.schema([("item", items.schema.field("item").type), ("key", keys), ("score", pa.int64())]))

    return run


def search(index: Index, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(item, rank, key, score): the ``k`` best documents for each item of ``wanted`` (item, term), scores above 0 only.

    Equal scores rank by ascending key, a missing one last. An item without a term that any document holds has no rows. Items are
    sent to the blocks in sets of a bounded number of terms, one job each.
    """
    spark = wanted.sparkSession
    terms = wanted.select("term").distinct().join(index.frequencies(), "term")
    terms = terms.withColumn("weight", _weight(F.col("df"), index.documents)).where("weight > 0")
    terms = numbered(terms, ["df", "term"], out="row")
    terms = written(terms.select("term", "row", "weight"), "terms")
    about = index.blocks.where("term is null").select("block", "documents", "counts", "keys", F.lit(None).cast("long").alias("row"), F.lit(None).cast("long").alias("weight"))
    grid = index.blocks.where("term is not null").join(terms, "term").select(*about.columns).unionByName(about)
    items = written(wanted.join(terms, "term").groupBy("item").agg(F.sort_array(F.collect_list("row")).alias("rows")), "queries")
    sets = -(-(items.agg(F.sum(F.size("rows"))).first()[0] or 1) // JOB_TERMS)
    kinds = f"item {items.schema['item'].dataType.simpleString()}, key {index.blocks.schema['keys'].dataType.elementType.simpleString()}, score long"
    out, counts = None, (index.documents, index.terms)
    for number in range(sets):
        chosen = spark.sparkContext.broadcast(items.where(F.pmod(F.xxhash64("item"), F.lit(sets)) == number).toArrow())
        hits = grid.groupBy("block").applyInArrow(_best_by_block(chosen, counts, k), kinds)
        out = hits if out is None else out.unionByName(hits)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item", "rank", "key", "score")


def ranked(documents: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, rank, key, score): the ``k`` best of all documents for every item, over an index of the items' terms."""
    wanted = item_terms(items, item, text)
    return search(indexed(documents, wanted, key, text), wanted, k)
