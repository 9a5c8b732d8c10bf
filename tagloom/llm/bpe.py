"""Byte-level BPE: greedy proposals, vectorised checks of adjacent tokens, exact merging only where a check fails.

A token sequence is the encoding of its bytes exactly if every two adjacent tokens are the encoding of their own joint
bytes. So each new word gets a proposal by longest match, all adjacent pairs of all new words are looked up at once in a
table of judged pairs, and only the words with a pair that fails are merged step by step. Words repeat, so a
worker keeps the encodings it has found in a bounded number of bytes; when these are used up the words met least go.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import batches_of, slices, values

# How the vocabulary's format splits text into words, and the printable stand-ins of its bytes.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

SHORT = 48
NO_MERGE = (1 << 62, -1)
#: Bytes of a worker's store of words, at about WORD_BYTES for each besides its spelling, and of judged pairs.
MOST_STORE_BYTES, WORD_BYTES = 24_000_000, 230
MOST_PAIRS = 500_000
MAX_VOCABULARY_BYTES = 64_000_000


def stand_ins() -> dict[str, int]:
    """Each printable character of the vocabulary file to the byte it stands for."""
    hidden = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """One vocabulary: ``spec`` is the text of a byte-level BPE file in the JSON form of public tokenizers."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        byte = stand_ins()
        spelt = {token: bytes(byte[c] for c in token) for token in parsed["model"]["vocab"]}
        self.ids = {spelt[token]: i for token, i in parsed["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        self.spelling = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(parsed["model"]["merges"]):
            a, b = (self.ids[spelt[x]] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[a << 32 | b] = rank, self.ids[self.spelling[a] + self.spelling[b]]
        self.letters = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(WORDS)
        names = sorted(self.special, key=len, reverse=True)
        self.cuts = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.room = MOST_STORE_BYTES
        self._reset_words()
        self._reset_pairs()

    def _reset_words(self) -> None:
        self.places: dict[str, int] = {}
        self.sizes, self.tokens = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.starts, self.hits, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _forget_rare(self) -> None:
        """Keep the words met most often, in half of the store."""
        words, order = list(self.places), np.argsort(-self.hits, kind="stable")
        cost = np.cumsum([len(words[k]) + WORD_BYTES for k in order])
        keep = np.sort(order[cost <= self.room // 2])
        tokens = [self.tokens[self.starts[k] : self.starts[k] + self.sizes[k]] for k in keep]
        hits, sizes = self.hits[keep] // 2, self.sizes[keep]
        self._reset_words()
        self.places = {words[k]: i for i, k in enumerate(keep)}
        self.hits, self.sizes, self.tokens = hits, sizes, np.concatenate([self.tokens, *tokens])
        self.starts = np.cumsum(sizes) - sizes
        self.held = sum(map(len, self.places)) + WORD_BYTES * len(self.places)

    def _reset_pairs(self) -> None:
        self.judged, self.good = np.zeros(0, np.int64), np.zeros(0, bool)

    def merged(self, word: bytes) -> list[int]:
        """Exact encoding: always the lowest-ranked merge, the leftmost of equals."""
        if len(word) > SHORT:
            return self._merged_long(word)
        tokens, merges = [self.letters[b] for b in word], self.merges
        found = [merges.get(a << 32 | b, NO_MERGE) for a, b in zip(tokens, tokens[1:])]
        while found:
            best = min(found)
            if best is NO_MERGE:
                break
            i = found.index(best)
            tokens[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = merges.get(tokens[i - 1] << 32 | best[1], NO_MERGE)
            if i < len(found):
                found[i] = merges.get(best[1] << 32 | tokens[i + 1], NO_MERGE)
        return tokens

    def _merged_long(self, word: bytes) -> list[int]:
        """The same by a heap over a linked list, so that a long word takes no quadratic time."""
        tokens: list[int | None] = [self.letters[b] for b in word]
        after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        heap = []

        def offer(i: int) -> None:
            if (j := after[i]) >= 0 and (found := self.merges.get(tokens[i] << 32 | tokens[j])):
                heap.append((found[0], i, tokens[i], tokens[j], found[1]))

        for i in range(len(word) - 1):
            offer(i)
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i] if tokens[i] == a else -1
            if j < 0 or tokens[j] != b:
                continue
            tokens[i], tokens[j], after[i] = whole, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (j := after[k]) >= 0 and (found := self.merges.get(tokens[k] << 32 | tokens[j])):
                    heapq.heappush(heap, (found[0], k, tokens[k], tokens[j], found[1]))
        return [t for t in tokens if t is not None]

    def proposed(self, word: bytes) -> list[int]:
        """Longest match from left to right."""
        out, at, ids = [], 0, self.ids
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at, -1):
                if (token := ids.get(word[at:end])) is not None:
                    out.append(token)
                    at = end
                    break
        return out

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair whether its joint bytes encode to it; right -1: whether the left token encodes to itself."""
        pairs = left.astype(np.int64) << 32 | (right.astype(np.int64) + 1)
        distinct, back = np.unique(pairs, return_inverse=True)
        spot = np.searchsorted(self.judged, distinct)
        known = spot < len(self.judged)
        known[known] = self.judged[spot[known]] == distinct[known]
        good = np.zeros(len(distinct), bool)
        good[known] = self.good[spot[known]]
        for k in np.flatnonzero(~known):
            a, b = int(distinct[k] >> 32), int(distinct[k] & 0xFFFFFFFF) - 1
            want = [a] if b < 0 else [a, b]
            good[k] = self.merged(b"".join(self.spelling[t] for t in want)) == want
        if len(self.judged) > MOST_PAIRS:
            self._reset_pairs()
            known[:] = False
        if not known.all():
            judged = np.concatenate([self.judged, distinct[~known]])
            order = np.argsort(judged)
            self.judged, self.good = judged[order], np.concatenate([self.good, good[~known]])[order]
        return good[back]

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before and keep their tokens."""
        spelt = [w.encode() for w in words]
        proposals = [self.proposed(w) for w in spelt]
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int32, int(sizes.sum()))
        ends = np.cumsum(sizes)
        right = np.append(flat[1:], -1)
        right[ends[sizes > 1] - 1] = -2  # no pair across words
        right[ends[sizes == 1] - 1] = -1
        inner = right != -2
        fine = np.ones(len(flat), bool)
        fine[inner] = self.compatible(flat[inner], right[inner])
        for k in np.flatnonzero(~np.logical_and.reduceat(fine, ends - sizes)):
            proposals[k] = self.merged(spelt[k])
        first = len(self.places)
        self.places.update((w, first + k) for k, w in enumerate(words))
        sizes = np.fromiter(map(len, proposals), np.int64, len(proposals))
        self.sizes = np.concatenate([self.sizes, sizes])
        self.tokens = np.concatenate([self.tokens, np.fromiter((t for p in proposals for t in p), np.int32, int(sizes.sum()))])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.hits = np.concatenate([self.hits, np.zeros(len(words), np.int64)])
        self.held += sum(map(len, words)) + WORD_BYTES * len(words)

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; a special token's string is a piece of its own."""
        if not self.cuts or not self.cuts.search(text):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.cuts.split(text):
            out += [part] if part in self.special else self.words.findall(part)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts per text, and all tokens in order."""
        if self.held > self.room:
            self._forget_rare()
        for name, token in self.special.items():
            if name not in self.places:
                self.places[name] = len(self.places)
                self.starts, self.sizes = np.append(self.starts, len(self.tokens)), np.append(self.sizes, 1)
                self.tokens, self.hits = np.append(self.tokens, np.int32(token)), np.append(self.hits, 0)
        words, counts = [], [0]
        for text in texts:
            words += self.pieces(text)
            counts.append(len(words))
        at = np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            self.learn(list({words[k] for k in unseen}))
            at[unseen] = [self.places[words[k]] for k in unseen]
        self.hits += np.bincount(at, minlength=len(self.hits))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        tokens = self.tokens[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - (ends - sizes), sizes)]
        return np.diff(np.concatenate([[0], ends])[counts]), tokens

    def decode(self, tokens: list[int]) -> str:
        """The text of a token sequence; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.spelling.__getitem__, tokens)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def codec(spec: Broadcast) -> Codec:
    """The vocabulary, parsed once per Python worker."""
    key = hash(spec.value)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec.value)
    return _codecs[key]


def vocabulary(df: DataFrame, path: str) -> Broadcast:
    """The vocabulary file at ``path`` on the driver, sent to the executors; its size is checked."""
    with open(path, encoding="utf-8") as file:
        spec = file.read(MAX_VOCABULARY_BYTES + 1)
    if not 0 < len(spec) <= MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary file has 1 to {MAX_VOCABULARY_BYTES} characters: {path}")
    return df.sparkSession.sparkContext.broadcast(spec)


def encode(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) per row, ``ids`` an array of token numbers; a null or empty text has none.

    Special tokens' strings in a text become their tokens, nothing is added, cut off or padded. Every row, repeated
    ones and those without a key too, gives one row; other columns play no part.
    """
    return _encoded(documents, vocabulary_path, key, text, False)


def round_trip(documents: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", store_bytes: int = MOST_STORE_BYTES) -> DataFrame:
    """(key, ids, text): each row's tokens as by ``encode``, and the text that ``decode`` makes of them, in one pass.

    ``store_bytes`` is the memory that a worker may spend on words met before: more of it saves work, the result is the same.
    """
    return _encoded(documents, vocabulary_path, key, text, True, store_bytes)


def _encoded(documents: DataFrame, vocabulary_path: str, key: str, text: str, back: bool, store_bytes: int = MOST_STORE_BYTES) -> DataFrame:
    spec = vocabulary(documents, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(spec)
        tool.room = store_bytes
        for batch in batches_of(batches):
            for part in slices(batch, 1):
                counts, tokens = tool.encode([t or "" for t in values(part.column(1))])
                ends = np.concatenate([[0], np.cumsum(counts)])
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens))]
                if back:
                    columns.append(pa.array((tool.decode(tokens[a:b].tolist()) for a, b in zip(ends, ends[1:])), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "text"][: len(columns)])

    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>" + ", text string" * back)


def decode(encoded: DataFrame, vocabulary_path: str, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, ids, text): the text that each token sequence stands for; no tokens: an empty one, null: null."""
    spec = vocabulary(encoded, vocabulary_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(spec)
        for batch in batches_of(batches):
            texts = pa.array((None if t is None else tool.decode(t) for t in values(batch.column(1))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], ["key", "ids", "text"])

    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, text string")
