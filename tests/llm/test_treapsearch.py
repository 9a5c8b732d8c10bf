"""Ranked search against scores counted plainly in Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.llm import treapsearch
from tagloom.llm.queries import op13_ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(documents, items, k):
    """(item, rank, key, score) from all scores of all documents."""
    counts = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in documents]
    held = [c for _, c in counts if c]
    n, total = len(held), sum(sum(c.values()) for c in held)
    df = Counter(t for c in held for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    out = []
    for item, terms in asked.items():
        scores = []
        for key, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, key is None, key, score))
        out += [(item, rank, s[2], s[3]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, documents, items, k=5, **more):
    docs = spark.createDataFrame(documents, "doc_id long, text string").repartition(3).withColumns({"item": F.lit("x"), "block": F.lit(1), "term": F.lit(2), "keys": F.lit(0)})
    rows = treapsearch.ranked(docs, spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1)), k).collect()
    return sorted([(r["item"], r["rank"], r["key"], r["score"]) for r in rows], key=repr)


WORDS = [f"w{i}" for i in range(60)] + ["Été", "42", "日本"]


@pytest.fixture
def corpus():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=n))
    documents = [(i * 37 % 401, text(rng.randint(0, 40))) for i in range(400)]
    documents += [documents[3]] * 40 + [(None, documents[3][1]), (900, None), (901, ""), (902, "?!\x00\n"), (903, text(100_000)), (903, text(9))]
    items = [(f"i{i}", text(rng.randint(1, 30))) for i in range(12)] + [("none", None), ("empty", " .. "), ("unknown", "zzz"), ("W", "W1,w1;WÉ w2-été"), (None, "w3"), ("i1", "w50")]
    return documents, items


def test_against_all_scores(spark, corpus):
    assert found(spark, *corpus) == plain(*corpus, 5)


def test_small_blocks_many_sets_and_no_vocabulary_on_the_executors(spark, corpus, monkeypatch):
    monkeypatch.setattr(treapsearch, "JOB_TERMS", 50)
    monkeypatch.setattr(treapsearch, "MOST_VOCABULARY_BYTES", 0)
    assert found(spark, *corpus, k=5) == plain(*corpus, 5)


def test_no_documents_and_no_items(spark):
    assert found(spark, [], [("a", "w1")]) == found(spark, [(1, "w1")], []) == found(spark, [(1, None)], [("a", "w1")]) == []


@pytest.mark.parametrize("seed", range(6))
def test_treap_finds_the_largest_sums(seed):
    rng = np.random.default_rng(seed)
    rows, columns = rng.integers(2, 40), rng.integers(1, 900)
    grid = rng.integers(1, 6 if seed % 2 else 10**9, (rows, columns)) * (rng.random((rows, columns)) < 0.2)
    r, c = np.nonzero(grid)
    if not len(r):
        return
    treap = treapsearch.Treap(r, c, grid[r, c])
    assert treap.maxima[0] == grid.max()
    wanted = np.unique(r)[:: 1 + seed % 3]
    sums = grid[wanted].sum(axis=0)
    order = [x for x in np.lexsort((np.arange(columns), -sums)) if sums[x] > 0][:7]
    got, scores = treap.best(wanted, 7)
    assert got.tolist() == order and scores.tolist() == sums[order].tolist()


def test_blocks_are_bounded(spark, monkeypatch):
    block = treapsearch.Block()
    monkeypatch.setattr(treapsearch, "BLOCK_TERMS", 10)
    block.add(treapsearch.pa.array([1]), [b"a"] * 50, None)
    assert not block.full()  # one distinct term
    block.add(treapsearch.pa.array([2]), [b"%d" % i for i in range(10)], None)
    assert block.full() and block.batch(0).num_rows == 12


def test_query(spark, sf_dir):
    rows = lambda t, a: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(a, "text").collect()]
    got = sorted([tuple(r) for r in op13_ranked_search(spark, sf_dir).select("item_id", "rank", "doc_id", "score").collect()], key=repr)
    assert got == plain(rows("documents", "doc_id"), rows("benchmark", "item_id"), 10)
