"""Packing of tokenised documents into sequences of bounded length, in order, by dynamic programming.

Documents stay in the order of their keys and are cut into windows. A cut may stand at the end of a document (free), at the end
of a sentence, or, only inside a sentence longer than a window, between any of its evenly spaced tokens. Of all ways to cut a run of
documents the least sum of padding, cut penalties and a charge for each sequence is found exactly: costs before a cut are kept in a
monotone queue, so each place is weighed once, and the few lengths that need no padding are looked up.
Runs of documents of bounded length are packed on their own, wherever their rows lie.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tagloom.llm.bpe import vocabulary
from tagloom.llm.store import slices

CAPACITY = 4096
#: In tokens of padding: a cut between sentences, a cut inside one, and a further sequence.
SENTENCE_PENALTY, INNER_PENALTY, SEQUENCE_CHARGE = 16, 256, 64
#: A run ends with the document that brings it to so many tokens.
RUN_TOKENS = 1_000_000
#: Bytes of a worker's store of pieces, at about PIECE_BYTES for each besides its tokens; bits of its table of first choices.
MOST_STORE_BYTES, PIECE_BYTES, SLOT_BITS = 64_000_000, 32, 21
SLICE_BYTES = 8_000_000

LAST = frozenset(".!?…。！？।\"'”’)]»")
END = re.compile(r"[.!?…。！？।]+[\"'”’)\]»]*$")

# Classes of bytes: white space but line breaks, line breaks, ASCII letters, other ASCII marks and digits.
_KIND = np.full(256, 4, np.uint8)
_KIND[[32, 9, 13]] = 0
_KIND[10] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[[*range(33, 65), *range(91, 97), *range(123, 127)]] = 3
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


@dataclass(frozen=True)
class Costs:
    capacity: int = CAPACITY
    sentence: int = SENTENCE_PENALTY
    inner: int = INNER_PENALTY
    sequence: int = SEQUENCE_CHARGE

    def padding(self, length: int) -> int:
        """Tokens added to a sequence: none to a full one or at a power of two, else up to the capacity."""
        return 0 if length & (length - 1) == 0 else self.capacity - length


def pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the pieces that are tokenised apart, of UTF-8 texts that lie one behind the other.

    Neither the vocabulary's normaliser nor its splitter joins anything across two of them. Texts are cut at white space, a line
    break being a piece, and behind an ASCII letter before another ASCII mark, where the splitter always ends a word. Only texts
    that may hold the name of a special token are cut at white space alone.
    """
    kind = _KIND[data]
    inside, line = kind > 0, kind == 1
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = (kind[:-1] == 2) & (kind[1:] == 3)
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for k in np.unique(np.searchsorted(bounds, marks, "right") - 1):
        cut[bounds[k] + 1 : bounds[k + 1]] = False
    cut[1:] |= np.append(line[1:], False) | line | ~inside
    cut[bounds] = True
    begins = np.flatnonzero(inside & cut[:-1])
    return begins, np.flatnonzero(inside & (cut[1:] | np.append(~inside[1:], True))) + 1


def hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each piece, eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left = ends - begins
    out = [left.astype(np.uint64) * m for m in _MIX]
    rows, at = np.arange(len(begins)), begins
    while len(rows):
        size = left[rows]
        word = eights[at] & (~np.uint64(0) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64)))
        for h, m in zip(out, _MIX[::-1]):
            x = (h[rows] ^ word) * m
            h[rows] = x ^ (x >> np.uint64(31))
        left[rows] -= 8
        more = size > 8
        rows, at = rows[more], at[more] + 8
    return out[0], out[1]


class Words:
    """Token numbers of pieces of texts, by the tokenizers library. Pieces repeat, so a bounded number of bytes of them is kept, known
    by 128 bits of hash; when it is used up those met least go."""

    def __init__(self, spec: str):
        self.tool = Tokenizer.from_str(spec)
        self.tool.no_truncation()
        self.tool.no_padding()
        self._keep(*[np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32, bool, np.int32, np.uint32)])

    def _keep(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, stop: np.ndarray, hits: np.ndarray, tokens: np.ndarray) -> None:
        """Store these pieces, ``tokens`` in their order; the last of each slot is found at once, the others by search."""
        self.key, self.check, self.size, self.stop, self.hits, self.tokens = key, check, size, stop, hits, tokens
        self.start = np.cumsum(size, dtype=np.int64) - size
        self.order = np.argsort(key)
        self.sorted = key[self.order]
        self.slots = np.zeros(1 << SLOT_BITS, np.int32)
        self.slots[(key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] = np.arange(len(key), dtype=np.int32)
        self.held = PIECE_BYTES * len(key) + 4 * len(tokens)

    def _forget_rare(self) -> None:
        order = np.argsort(-self.hits, kind="stable")
        keep = np.sort(order[np.cumsum(PIECE_BYTES + 4 * self.size[order]) <= MOST_STORE_BYTES // 2])
        self._keep(self.key[keep], self.check[keep], self.size[keep], self.stop[keep], self.hits[keep] // 2, self._tokens(keep))

    def _tokens(self, at: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.size[at], dtype=np.int64)
        return self.tokens[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[at] - (ends - self.size[at]), self.size[at])]

    def _find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Places in the store; -1: not there."""
        if not len(self.key):
            return np.full(len(key), -1)
        at = self.slots[(key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.int64)
        other = np.flatnonzero(self.key[at] != key)
        found = np.minimum(np.searchsorted(self.sorted, key[other]), len(self.sorted) - 1)
        at[other] = np.where(self.sorted[found] == key[other], self.order[found], -1)
        return np.where((at >= 0) & (self.check[at] == check), at, -1)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of the UTF-8 texts between ``bounds`` its token numbers, and the places behind the ends of sentences and lines."""
        if self.held > MOST_STORE_BYTES:
            self._forget_rare()
        begins, ends = pieces(data, bounds)
        key, check = hashes(data, begins, ends)
        at = self._find(key, check)
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            _, first = np.unique(key[unseen], return_index=True)
            new = unseen[first]
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(begins[new].tolist(), ends[new].tolist())]
            found = [e.ids for e in self.tool.encode_batch(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int32, len(found))
            tokens = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
            stops = np.array([w == "\n" or w[-1] in LAST and END.search(w) is not None for w in words], bool)
            more = key[new], check[new], sizes, stops, np.zeros(len(new), np.int32), tokens
            self._keep(*[np.concatenate(x) for x in zip((self.key, self.check, self.size, self.stop, self.hits, self.tokens), more)])
            at[unseen] = self._find(key[unseen], check[unseen])
        self.hits += np.bincount(at, minlength=len(self.hits)).astype(np.int32)
        tokens, upto, stop = self._tokens(at), np.cumsum(self.size[at], dtype=np.int64), np.flatnonzero(self.stop[at])
        edge = np.searchsorted(begins, bounds)
        token_bounds, cut = np.concatenate([[0], upto])[edge], np.searchsorted(stop, edge)
        return [(tokens[a:b], upto[stop[c:d]] - a) for a, b, c, d in zip(token_bounds, token_bounds[1:], cut, cut[1:])]


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow column of texts, and where each begins and the last ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def places(stops: list[np.ndarray], sizes: np.ndarray, costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of documents may be cut, ascending from 0 to its end, and each place's penalty.

    ``stops`` are the ends of sentences inside each document of ``sizes`` tokens. No two places are further apart than a window.
    """
    ends = np.cumsum(sizes)
    inside = np.concatenate([np.zeros(0, np.int64), *(s + (e - n) for s, e, n in zip(stops, ends, sizes))])
    known = np.union1d(np.append(ends, 0), inside)
    step = max(1, costs.capacity // 16)
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > costs.capacity)
    more = [np.arange(known[i] + step, known[i + 1], step) for i in wide]
    every = np.union1d(known, np.concatenate(more)) if more else known
    penalty = np.full(len(every), costs.inner, np.int64)
    penalty[np.isin(every, inside)] = costs.sentence
    penalty[np.isin(every, ends)] = 0
    return every, penalty


def cuts(place: np.ndarray, penalty: np.ndarray, costs: Costs) -> list[int]:
    """Places, from 0 to the last, that cut at the least sum of padding, penalties and charges.

    For a window from place i to place j the cost up to i and the padding make cost(i) + place(i) + capacity - place(j). So among the
    places within reach the one with the least cost(i) + place(i) is best for every j, and a queue of falling candidates gives it. Windows
    of a power of two, which need no padding, are the only others to be compared.
    """
    spots, last = place.tolist(), len(place) - 1
    lengths = 1 << np.arange(int(costs.capacity).bit_length())
    lengths = lengths[lengths <= costs.capacity]
    wanted = place[:, None] - lengths[None, :]
    found = np.searchsorted(place, wanted)
    hit = place[np.minimum(found, last)] == wanted
    exact, upto = found[hit].tolist(), np.cumsum(hit.sum(axis=1)).tolist()
    charge, reach = (penalty + costs.sequence).tolist(), costs.capacity
    cost, key, before = [0] * len(spots), [0] * len(spots), [0] * len(spots)
    queue = deque([0])
    for j in range(1, last + 1):
        spot = spots[j]
        while spot - spots[queue[0]] > reach:
            queue.popleft()
        best = queue[0]
        least = key[best] + reach - spot
        for i in exact[upto[j - 1] : upto[j]]:
            if cost[i] < least:
                best, least = i, cost[i]
        cost[j], before[j] = least + charge[j], best
        own = key[j] = cost[j] + spot
        while queue and key[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    path = [last]
    while path[-1]:
        path.append(before[path[-1]])
    return [spots[i] for i in reversed(path)]


class Run:
    """Documents that are packed together: tokens, sizes and ends of sentences."""

    def __init__(self) -> None:
        self.keys, self.tokens, self.stops, self.size = [], [], [], 0

    def add(self, key: pa.Array, tokens: np.ndarray, stops: np.ndarray) -> None:
        self.keys.append(key)
        self.tokens.append(tokens)
        self.stops.append(stops)
        self.size += len(tokens)

    def packed(self, first: int, costs: Costs, with_ids: bool) -> tuple[pa.RecordBatch, int]:
        """The run's pieces, sequences numbered from ``first``, and the next number."""
        sizes = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        stream, ends = np.concatenate(self.tokens).astype("<u4"), np.cumsum(sizes)
        place, penalty = places(self.stops, sizes, costs)
        windows = np.array(cuts(place, penalty, costs), np.int64)
        edges = np.union1d(windows, ends)
        begin, length = edges[:-1], np.diff(edges)
        document, window = np.searchsorted(ends, begin, "right"), np.searchsorted(windows, begin, "right") - 1
        bytes_ = memoryview(stream).cast("B")
        digests = [zlib.crc32(bytes_[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
        columns = {
            "key": pa.concat_arrays(self.keys).take(pa.array(document)),
            "start": pa.array(begin - (ends - sizes)[document]),
            "length": pa.array(length),
            "ids_crc32": pa.array(digests, pa.int64()),
            "doc_tokens": pa.array(sizes[document]),
            "sequence_id": pa.array(first + window),
            "offset": pa.array(begin - windows[window]),
        }
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(stream.astype(np.int32)))
        return pa.RecordBatch.from_pydict(columns), first + len(windows) - 1


_words: dict[int, Words] = {}


def _tool(spec: Broadcast) -> Words:
    """The tokeniser, made once per Python worker."""
    name = hash(spec.value)
    if name not in _words:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _words.clear()
        _words[name] = Words(spec.value)
    return _words[name]


def packed(documents: DataFrame, vocabulary_path: str, end: int, key: str = "doc_id", text: str = "text", costs: Costs = Costs(), run_tokens: int = RUN_TOKENS, with_ids: bool = True) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): the pieces of all documents.

    A document's tokens are those of its text (null: none) by the vocabulary, nothing added, then ``end``; each token lies in one piece.
    ``start`` counts the document's tokens before the piece, ``offset`` the sequence's; ``ids_crc32`` is of the little-endian 32-bit token
    numbers. Documents follow each other by key, missing ones first; repeated rows are documents of their own, rows of one key
    stand next to each other, by their text's hash. Other columns play no part. No documents: no pieces.
    """
    spec = vocabulary(documents, vocabulary_path)
    stop = np.array([end], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held, number = _tool(spec), Run(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                for i, (tokens, stops) in enumerate(tool.encode(*_bytes(part.column(1)))):
                    held.add(part.column(0)[i : i + 1], np.concatenate([tokens, stop]), stops)
                    if held.size >= run_tokens:
                        pieces, number = held.packed(number, costs, with_ids)
                        held = Run()
                        yield pieces
        if held.size:
            yield held.packed(number, costs, with_ids)[0]

    rows = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    schema = f"key {rows.schema['key'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(run, schema + ", ids array<int>" * with_ids)
