"""Context-tree probabilities by recursion over the definition, counts and base scores by plain loops."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import ctw
from tagloom.llm.queries import QUERIES


class SlowTree:
    """The definition, node by node."""

    def __init__(self, texts, depth):
        self.depth, counts = depth, {}
        for t in texts:
            padded = bytes(depth) + t + b"\xff"
            for i in range(depth, len(padded)):
                for d in range(depth + 1):
                    c = padded[i - d : i]
                    for bit in range(8):
                        n = counts.setdefault((c, 1 << bit | padded[i] >> 8 - bit), [0, 0])
                        n[padded[i] >> 7 - bit & 1] += 1
        self.counts, self.memo, self.kids = counts, {}, defaultdict(list)
        for c, node in counts:
            if c:
                self.kids[c[1:], node].append(c)

    def kt(self, a, b):
        lg = math.lgamma
        return lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)

    def parts(self, c, node):
        """Log probability by the own estimate, and by the mix with the children."""
        if (c, node) not in self.memo:
            own = self.kt(*self.counts[c, node])
            below = sum(self.parts(kid, node)[1] for kid in self.kids[c, node])
            self.memo[c, node] = (own, own) if len(c) == self.depth else (own, math.log(0.5) + np.logaddexp(own, below))
        return self.memo[c, node]

    def one(self, past, node, d=0):
        c = past[len(past) - d :]
        a, b = self.counts[c, node]
        estimate = (b + 0.5) / (a + b + 1)
        if d == self.depth:
            return estimate
        own, both = self.parts(c, node)
        w = math.exp(math.log(0.5) + own - both)
        kid = past[len(past) - d - 1 :]
        return w * estimate + (1 - w) * (self.one(past, node, d + 1) if (kid, node) in self.counts else estimate)

    def log10(self, text):
        padded, total = bytes(self.depth) + text + b"\xff", 0.0
        for i in range(self.depth, len(padded)):
            for bit in range(8):
                node = 1 << bit | padded[i] >> 8 - bit
                p = self.one(padded[i - self.depth : i], node) if (b"", node) in self.counts else 0.5
                total += math.log10(p if padded[i] >> 7 - bit & 1 else 1 - p)
        return total


TEXTS = [b"the cat sat on the mat", b"the dog ate the cat", b"", b"caf\xc3\xa9 the\n the", b"aaaaaaaaaaaa"]
HELD = [b"the cat ate", b"", b"zebra \xe6\xbc\xa2", b"aaaa"]


def full_runs(texts, depth):
    grams, n = np.unique(ctw.runs(texts, depth)[0], return_counts=True)
    return grams, n.astype(float)


def split_levels(grams, counts, depth, split):
    """Levels made as Spark makes them: subtrees by the last bytes of the context, their sums, the top."""
    ending = (grams >> np.uint64(8)) & np.uint64((1 << 8 * split) - 1)
    parts = [ctw.subtree(grams[ending == e], counts[ending == e], split, depth) for e in np.unique(ending)]
    rows = [(ctw._shorter(levels[0][0], split - 1), levels[0][1], levels[0][2], logs) for levels, logs in parts]
    keys, zeros, ones, logs = (np.concatenate([r[i] for r in rows]) for i in range(4))
    keys, at = np.unique(keys, return_inverse=True)
    top = ctw.upper(keys, *(np.bincount(at, x) for x in (zeros, ones, logs)), split)
    joined = [tuple(np.concatenate([levels[d][i] for levels, _ in parts]) for i in range(5)) for d in range(depth - split + 1)]
    order = [np.argsort(level[0]) for level in joined]
    return top + [tuple(x[o] for x in level) for level, o in zip(joined, order)]


def text_scores(levels, texts, depth):
    grams, starts = ctw.runs(texts, depth)
    return np.add.reduceat(ctw.log10_probability(levels, grams), starts)


@pytest.mark.parametrize("depth, split", [(0, 0), (1, 0), (3, 0), (3, 1), (3, 2), (5, 2), (2, 2)])
def test_against_the_definition(depth, split):
    runs = full_runs(TEXTS, depth)
    levels = split_levels(*runs, depth, split) if split else ctw.subtree(*runs, 0, depth)[0]
    slow = SlowTree(TEXTS, depth)
    assert np.allclose(text_scores(levels, TEXTS + HELD, depth), [slow.log10(t) for t in TEXTS + HELD], rtol=1e-9)


@pytest.mark.parametrize("times", [1.0, 4e7, 1e9, 1e12])
def test_scores_stay_finite_and_add_up_to_one_at_any_count(times):
    grams, counts = full_runs(TEXTS, 3)
    levels = split_levels(grams, counts * times, 3, 2)
    assert np.isfinite(text_scores(levels, TEXTS + HELD, 3)).all()
    for context in (b"the", b"\0\0\0", b"qqq", b" ca"):
        base = int.from_bytes(context, "big") << 8
        symbols = ctw.log10_probability(levels, np.arange(base, base + 256, dtype=np.uint64))
        assert np.isfinite(symbols).all() and abs((10**symbols).sum() - 1) < 1e-9


def test_scorer_finds_frequent_runs_and_hands_on_the_others(monkeypatch):
    grams, starts = ctw.runs(TEXTS, 2)
    known, scores = np.unique(grams)[::2], np.arange(len(np.unique(grams)[::2]), dtype=float) + 1
    for bits in (1, 3, 20):  # few slots: most runs share one
        monkeypatch.setattr(ctw, "SLOT_BITS", bits)
        total, text, gram, n = ctw.Scorer(known, scores, 2).texts(TEXTS)
        value = dict(zip(known.tolist(), scores.tolist()))
        ends = [*starts.tolist()[1:], len(grams)]
        own = [Counter(grams[a:b].tolist()) for a, b in zip(starts.tolist(), ends)]
        assert total.tolist() == [sum(value.get(g, 0) * k for g, k in c.items()) for c in own]
        assert sorted(zip(text.tolist(), gram.tolist(), n.tolist())) == sorted((i, g, k) for i, c in enumerate(own) for g, k in c.items() if g not in value)


def test_runs_and_log_gamma():
    grams, starts = ctw.runs([b"ab", b"", b"c"], 2)
    assert [hex(g) for g in grams.tolist()] == ["0x61", "0x6162", "0x6162ff", "0xff", "0x63", "0x63ff"] and starts.tolist() == [0, 3, 4]
    x = np.array([0.5, 1, 1.5, 2, 7.9, 8, 33.5, 1e6, 1e12])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-8)


def slow_scores(rows, depth):
    """By row: held_out, tokens, known, all training tokens, base score, score."""
    def low(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", low(t))

    held = [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]
    training = [t for (_, t), h in zip(rows, held) if not h]
    counts = Counter(w for t in training for w in tokens(t))
    if training:
        counts[None] = len(training)
    total, distinct = sum(counts.values()), len(counts)
    slow = SlowTree([low(t).encode() for t in training], depth)
    out = []
    for (k, t), h in zip(rows, held):
        w = [*tokens(t), None]
        base = sum(math.log10((counts[x] + 1) / (total + 1 * (distinct + 1))) for x in w)
        out.append((k, h, len(w), sum(counts[x] > 0 for x in w), total, base, slow.log10(low(t).encode())))
    return sorted(out, key=lambda r: (str(r[0]), r[6]))


def compare(got, want):
    got = sorted((tuple(r) for r in got), key=lambda r: (str(r[0]), r[6]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


COLUMNS = ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(ctw, "HEAD", 3)
    monkeypatch.setattr(ctw, "HEAD_WORD_BYTES", 4)
    monkeypatch.setattr(ctw, "FLUSH", 20)
    rows = [(i, f"The cat {i % 4} sat\ton the mat\x1c {'é' * (i % 3)}") for i in range(25)]
    rows += [(50, None), (51, ""), (51, ""), (None, "No key HERE"), (52, "uncommon words É here"), (53, "x\x00y \x85 z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "n": F.lit(0), "row": F.lit(1)})
    compare(ctw.scored(df, depth=3).select(COLUMNS).collect(), slow_scores(rows, 3))
    assert ctw.scored(df.limit(0)).collect() == []
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    r = ctw.scored(spark.createDataFrame([(held, "a b")], "doc_id bigint, text string"), depth=2).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 3, 0, 0) and abs(r.score + 32 * math.log10(2)) < 1e-9 and r.base_score == 0


def test_long_text_and_hardly_any_runs_sent(spark):
    rows = [(i, "the cat sat on the mat " * 20) for i in range(10)] + [(99, "the cat sat " * 100_000), (98, "dogs")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [{r.key: r.score for r in ctw.scored(df, head_runs=n).collect()} for n in (0, 7, 1 << 20)]
    assert got[0].keys() == dict(rows).keys() and all(abs(a[k] - got[2][k]) < 1e-9 * abs(got[2][k]) for a in got for k in a)
    assert all(s < 0 for s in got[0].values())


def test_query_against_the_definition(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    compare(QUERIES["op9_lm_scoring"](spark, sf_dir).withColumnRenamed("doc_id", "key").select(COLUMNS).collect(), slow_scores(docs, ctw.DEPTH))


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op9_lm_scoring"](spark, sf_dir).collect()
    assert len(got) == len(docs) and len({r.train_tokens for r in got}) == 1
    test = [r for r in got if r.held_out]
    assert {r.doc_id for r in test} == {k for k, _ in docs if zlib.crc32(str(k).encode()) % 7 == 2}
    assert -sum(r.score for r in test) / math.log10(2) < 3.0 * sum(r.n_bytes for r in test)
    assert all(abs(r.bits_per_byte + r.score / math.log10(2) / (r.n_bytes + 1)) < 1e-9 for r in got)
