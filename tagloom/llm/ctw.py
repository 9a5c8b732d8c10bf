"""Scores of texts under a language model by context-tree weighting over bytes, with a word-count baseline.

A text is its bytes with A-Z in lower case and an end mark. Each byte is eight binary decisions; a decision's contexts are the
last 0, 1, ... ``depth`` bytes together with the bits of the current byte so far. Every context has a Krichevsky-Trofimov
estimate from the training counts of its decision, and context-tree weighting mixes the estimates of all depths with the weight
that the training data give each: P_w = P_e / 2 + (product of the children's P_w) / 2. Below a context that training never saw,
the estimate of the last one that it saw holds.

The counts are those of all runs of ``depth + 1`` bytes in the training documents, summed by Spark; shorter runs are sums of
longer ones. No run is left out or merged with others, so the model grows with the corpus. The tree is never in one place: the
contexts that end with the same two bytes form a subtree, which one task weighs from the leaves up; the contexts of no or one
byte, at most 65,280 nodes, take the subtrees' sums and are sent to all. With them each subtree gives the probability of every run
that stands in any document, seen in training or not.

Scores of runs and counts of words have no bound. The most frequent go to the executors; occurrences of all others are joined
with theirs by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.store import held_out, slices, values, written

DEPTH = 5
SPLIT = 2  # bytes of context that name a subtree
HEAD_RUNS, SLOT_BITS = 1 << 20, 21
HEAD, HEAD_WORD_BYTES = 131_072, 64
END = 255  # no byte of UTF-8
SLICE_BYTES = 2_000_000
FLUSH = 1_500_000
LN_HALF = np.log(0.5)


def prepared(text: str | None) -> bytes:
    return (text or "").encode().lower()


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and end mark the run of it (lowest byte) and the bytes before it; and where each text begins."""
    gap = bytes(depth)
    joined = np.frombuffer(b"".join(x for t in texts for x in (gap, t, b"\xff")), np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    places = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(texts) + 1) * depth, sizes)
    out = np.zeros(len(places), np.uint64)
    for back in range(depth, -1, -1):
        out = (out << np.uint64(8)) | joined[places - back]
    return out, np.cumsum(sizes) - sizes


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series above 8, to which smaller arguments are raised."""
    shifted, less = x.copy(), np.zeros_like(x)
    for _ in range(8):
        small = shifted < 8
        less[small] += np.log(shifted[small])
        shifted[small] += 1
    series = 1 / (12 * shifted) - 1 / (360 * shifted**3) + 1 / (1260 * shifted**5)
    return (shifted - 0.5) * np.log(shifted) - shifted + 0.5 * np.log(2 * np.pi) + series - less


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability of a sequence with these counts under the Krichevsky-Trofimov estimate."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


#: Nodes of one depth: sorted keys (context and bits so far), counts of zeros and ones, weight of the own estimate and of what lies below.
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def log10_probability(levels: list[Level], grams: np.ndarray) -> np.ndarray:
    """Log10 probability of the last byte of each run after the others, by the levels of all depths from 0."""
    total = np.zeros(len(grams))
    symbol = grams & np.uint64(255)
    for bit in range(8):
        node = np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))
        one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)) == 1
        chance, known = np.full(len(grams), 0.5), np.zeros(len(grams), bool)
        for depth in range(len(levels) - 1, -1, -1):
            keys, zeros, ones, own, below = levels[depth]
            wanted = (((grams >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8)) | node
            at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
            here = keys[at] == wanted if len(keys) else np.zeros(len(grams), bool)
            if here.any():
                k = at[here]
                estimate = (np.where(one[here], ones[k], zeros[k]) + 0.5) / (zeros[k] + ones[k] + 1.0)
                chance[here] = own[k] * estimate + below[k] * np.where(known[here], chance[here], estimate)
            known = here
        total += np.log10(chance)
    return total


def _nodes(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, zeros and ones of the nodes of these runs."""
    context, symbol, found = grams >> np.uint64(8), grams & np.uint64(255), []
    for bit in range(8):
        node = (context << np.uint64(8)) | np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))
        one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)) == 1
        keys, at = np.unique(node, return_inverse=True)
        found.append((keys, *(np.bincount(at, np.where(side, counts, 0), len(keys)) for side in (~one, one))))
    keys, zeros, ones = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.argsort(keys)
    return keys[order], zeros[order], ones[order]


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """The keys of the same decisions after only ``depth`` bytes."""
    return ((keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)) << np.uint64(8) | (keys & np.uint64(255))


def _weighted(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, log_below: np.ndarray | None) -> tuple[Level, np.ndarray]:
    """The level, and the log of each node's weighted probability; ``log_below``: of the product of its children's."""
    log_own = log_kt(zeros, ones)
    if log_below is None:
        return (keys, zeros, ones, np.ones(len(keys)), np.zeros(len(keys))), log_own
    odds = log_below - log_own
    return (keys, zeros, ones, np.exp(-np.logaddexp(0.0, odds)), np.exp(-np.logaddexp(0.0, -odds))), LN_HALF + np.logaddexp(log_own, log_below)


def subtree(grams: np.ndarray, counts: np.ndarray, top: int, depth: int) -> tuple[list[Level], np.ndarray]:
    """Levels ``top`` to ``depth`` of the tree of these full runs, and the logs of its ``top`` nodes' weighted probabilities."""
    levels, logs, child = [], np.zeros(0), None
    for d in range(depth, top - 1, -1):
        short, at = np.unique(grams & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        keys, zeros, ones = _nodes(short, np.bincount(at, counts, len(short)))
        below = None if child is None else np.bincount(np.searchsorted(keys, _shorter(child, d)), logs, len(keys))
        level, logs = _weighted(keys, zeros, ones, below)
        levels.append(level)
        child = keys
    return levels[::-1], logs


def upper(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, logs: np.ndarray, depth: int) -> list[Level]:
    """Levels 0 to ``depth`` - 1 from sums over the nodes of depth ``depth``, already added up by their parents' ``keys``."""
    levels = []
    for d in range(depth - 1, -1, -1):
        if levels:
            keys, at = np.unique(_shorter(keys, d), return_inverse=True)
            zeros, ones, logs = (np.bincount(at, x, len(keys)) for x in (zeros, ones, logs))
        level, logs = _weighted(keys, zeros, ones, logs)
        levels.append(level)
    return levels[::-1]


class Scorer:
    """Log10 probabilities of texts: the sum over runs whose scores are at hand, and the other runs with their numbers."""

    def __init__(self, grams: np.ndarray, scores: np.ndarray, depth: int):
        """``grams`` by falling frequency; of those that share a slot the most frequent has it, the others are searched for."""
        self.depth = depth
        self.slot_keys, self.slot_scores = np.full(1 << SLOT_BITS, ~np.uint64(0)), np.zeros(1 << SLOT_BITS)
        slots = self._slots(grams[::-1])
        self.slot_keys[slots], self.slot_scores[slots] = grams[::-1], scores[::-1]
        order = np.argsort(grams)
        self.grams, self.scores = grams[order], scores[order]

    @staticmethod
    def _slots(grams: np.ndarray) -> np.ndarray:
        return (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums by text; and (text, run, number) of the runs not at hand."""
        grams, starts = runs(texts, self.depth)
        slots = self._slots(grams)
        scores, other = self.slot_scores[slots], np.flatnonzero(self.slot_keys[slots] != grams)
        at = np.minimum(np.searchsorted(self.grams, grams[other]), max(len(self.grams) - 1, 0))
        held = self.grams[at] == grams[other] if len(self.grams) else np.zeros(len(other), bool)
        scores[other] = np.where(held, self.scores[at], 0.0) if len(self.grams) else 0.0
        rest = other[~held]
        text, gram = np.searchsorted(starts, rest, "right") - 1, grams[rest]
        order = np.lexsort((gram, text))
        text, gram = text[order], gram[order]
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])])) if len(rest) else np.zeros(0, np.int64)
        return np.add.reduceat(scores, starts), text[first], gram[first], np.diff(np.append(first, len(rest)))


def _counts(depth: int):
    """(word, run, n, times) from rows (text, held_out): words and byte runs, ``n`` times in training rows, ``times`` in all."""

    def flush(words: Counter, parts: list) -> Iterator[pa.RecordBatch]:
        names = ["word", "run", "n", "times"]
        if words:
            spelt, n = pa.array([w.decode("utf-8", "replace") for w in words], pa.string()), pa.array(words.values(), pa.int64())
            yield pa.RecordBatch.from_arrays([spelt, pa.nulls(len(words), pa.int64()), n, n], names)
        if parts:
            grams, n, times = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n), pa.array(times)], names)

    def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return grams, *(np.bincount(at, np.concatenate([p[i] for p in parts]), len(grams)).astype(np.int64) for i in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        parts: list = []
        held = 0
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                apart = part.column(1).to_numpy(zero_copy_only=False)
                texts = [prepared(t) for t in values(part.column(0))]
                for learnt in (True, False):
                    chosen = [t for t, x in zip(texts, apart) if x != learnt]
                    if not chosen:
                        continue
                    for text in chosen if learnt else ():
                        words.update(text.split())
                    grams, times = np.unique(runs(chosen, depth)[0], return_counts=True)
                    parts.append((grams, times if learnt else np.zeros_like(times), times))
                    held += len(grams)
                if held > FLUSH:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                if held > FLUSH // 2 and len(parts) == 1 or len(words) > FLUSH // 2:
                    yield from flush(words, parts)
                    words, parts, held = Counter(), [], 0
        yield from flush(words, parts)

    return run


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["run"].to_numpy().astype(np.int64).view(np.uint64), table["n"].to_numpy().astype(np.float64)


def run_scores(counted: DataFrame, depth: int) -> DataFrame:
    """(run, times, score): log10 probability of the last byte of each run of the table (run, n, times), learnt from the ``n``.

    The subtrees of all contexts that end with the same ``SPLIT`` bytes are weighed apart, first for their sums, then for scores.
    """
    split = min(SPLIT, depth)
    rows = counted.withColumn("ending", F.shiftrightunsigned("run", 8).bitwiseAND(F.lit((1 << 8 * split) - 1)))

    def sums(table: pa.Table) -> pa.Table:
        grams, counts = _group(table)
        levels, logs = subtree(grams, counts, split, depth)
        keys, zeros, ones = levels[0][:3]
        keys = _shorter(keys, split - 1) if split else keys
        return pa.table({"key": keys.view(np.int64), "zeros": zeros, "ones": ones, "logs": logs})

    apart = rows.where("n > 0").groupBy("ending").applyInArrow(sums, "key long, zeros double, ones double, logs double")
    nodes = apart.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "logs")]).orderBy("key").toArrow() if split else None
    top = upper(nodes["key"].to_numpy().view(np.uint64), *(nodes[c].to_numpy() for c in ("zeros", "ones", "logs")), split) if split else []
    shared = counted.sparkSession.sparkContext.broadcast(top)

    def scores(table: pa.Table) -> pa.Table:
        grams, counts = _group(table)
        seen = counts > 0
        levels = subtree(grams[seen], counts[seen], split, depth)[0]
        return pa.table({"run": table["run"], "times": table["times"], "score": log10_probability([*shared.value, *levels], grams)})

    return rows.groupBy("ending").applyInArrow(scores, "run long, times long, score double")


def frequent(scores: DataFrame, most: int) -> pa.Table:
    """Runs met at least so often that at most ``most`` are, by falling frequency."""
    step = F.floor(4 * F.log2("times")).alias("step")
    least = 0
    total, held = 0, {r["step"]: r["n"] for r in scores.groupBy(step).agg(F.count(F.lit(1)).alias("n")).collect()}
    for power in sorted(held, reverse=True):
        total += held[power]
        if total > most:
            least = power + 1
            break
    table = scores.where(step >= least).toArrow()
    return table.take(compute.sort_indices(table, [("times", "descending"), ("run", "ascending")]))


def scored(documents: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 7, remainder: int = 2, depth: int = DEPTH, head_runs: int = HEAD_RUNS) -> DataFrame:
    """(key, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score) per row; scores are log10 probabilities.

    The model learns from the rows whose key's crc32 as text does not leave ``remainder`` by ``modulus``; rows without a key are
    learnt from. A null text is an empty one, which has the end mark alone. Every row gives a row and repeated rows count as often
    as they occur. Without training rows every bit has probability 1/2. An empty table gives an empty one.
    """
    if not 0 <= depth <= 6:
        raise ValueError("a run of bytes fits a signed number up to a depth of 6")
    spark = documents.sparkSession
    rows = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).withColumn("held_out", held_out(F.col("key"), modulus, remainder))
    raw = written(rows.select("text", "held_out").mapInArrow(_counts(depth), "word string, run bigint, n bigint, times bigint"), "counts")
    counted = written(raw.where("run is not null").groupBy("run").agg(F.sum("n").alias("n"), F.sum("times").alias("times")), "runs")
    scores = written(run_scores(counted, depth), "run_scores")
    shared = spark.sparkContext.broadcast([c.to_numpy() for c in frequent(scores, head_runs).select(["run", "score"]).combine_chunks().columns])

    words = written(raw.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = rows.where(~F.col("held_out")).count()
    known, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    train_tokens, distinct = tokens + ends, known + (ends > 0)
    top = words.where(F.octet_length("word") <= HEAD_WORD_BYTES).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    head = spark.sparkContext.broadcast({w.encode(): float(np.log10(n + 1)) for w, n in zip(top["word"].to_pylist(), top["n"].to_pylist())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, known = shared.value
        scorer, find = Scorer(grams.astype(np.int64).view(np.uint64), known, depth), head.value.get
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                texts = [prepared(t) for t in values(part.column(1))]
                n_words, n_head, sums, tails = [], [], [], []
                for t in texts:
                    split = t.split()
                    found = list(map(find, split))
                    tail = Counter(w for w, x in zip(split, found) if x is None)
                    n_words.append(len(split))
                    n_head.append(len(split) - sum(tail.values()))
                    sums.append(sum(x for x in found if x is not None))
                    tails.append([{"word": w.decode("utf-8", "replace"), "n": n} for w, n in tail.items()])
                score, text, gram, n = scorer.texts(texts)
                others = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["run", "n"])
                bounds = pa.array(np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(2), pa.array(map(len, texts), pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_head, pa.int64()),
                        pa.array(sums, pa.float64()), pa.array(score),
                        pa.array(tails, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))), pa.ListArray.from_arrays(bounds, others),
                    ],
                    ["key", "held_out", "n_bytes", "n_words", "n_head", "head_sum", "score", "tail", "others"],
                )

    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, n_bytes bigint, n_words bigint, n_head bigint, head_sum double, score double, tail array<struct<word:string,n:bigint>>, others array<struct<run:bigint,n:bigint>>"
    parts = written(rows.select("key", "text", "held_out").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    tail = parts.select("row", F.inline("tail")).withColumnRenamed("n", "times").join(words, "word")
    tail = tail.groupBy("row").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("tail_sum"))
    others = parts.select("row", F.inline("others")).withColumnRenamed("n", "often").join(scores.select("run", F.col("score").alias("each")), "run")
    others = others.groupBy("row").agg(F.sum(F.col("often") * F.col("each")).alias("others_sum"))
    both = parts.drop("tail", "others").join(tail, "row", "left").join(others, "row", "left")
    end_sum = float(np.log10(ends + 1))
    log_total = float(np.log10(train_tokens + distinct + 1))
    n_tokens = F.col("n_words") + 1
    base = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) + F.lit(end_sum) - n_tokens * F.lit(log_total)
    return both.select(
        "key", "held_out", "n_bytes", n_tokens.alias("n_tokens"),
        (F.col("n_head") + F.coalesce("times", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("others_sum", F.lit(0.0))).alias("score"),
    )
