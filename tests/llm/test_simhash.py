"""Fingerprints bit by bit, and components against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.llm.queries import QUERIES

FULL = (1 << 64) - 1


def slow_fingerprint(text, k):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lowered.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius):
    """rows: (key, fingerprint); key to smallest reachable key."""
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if bin(x ^ y).count("1") <= radius and (ra := find(a)) != (rb := find(b)):
                parent[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one TWO", "a b c", "É A  b\vC\n d é", "x y z " * 50, " a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == slow_fingerprint(text, 3)


def test_spark_hash_is_the_same(spark):
    text = "the quick brown"
    row = spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()
    assert row[0] & FULL == xxhash.xxh64_intdigest(text.encode(), 42) == simhash.fingerprint(text, 3)


def near(code, bits, rng):
    for b in rng.sample(range(64), bits):
        code ^= 1 << b
    return code


@pytest.mark.parametrize("radius, blocks", [(0, 1), (3, 4), (3, 5), (7, 9)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, radius, blocks):
    """Clusters larger than a chunk, so that crowded keys are cut; fingerprints with the top bit set."""
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(radius)
    codes = {0, FULL}
    for _ in range(12):
        centre = rng.getrandbits(64)
        codes |= {near(centre, rng.randrange(radius + 4), rng) for _ in range(40)}
    rows = list(enumerate(sorted(codes), 5))
    rng.shuffle(rows)
    nodes = spark.createDataFrame([(k, int(np.uint64(c).view(np.int64))) for k, c in rows], "node bigint, fp bigint")
    links = [tuple(r) for r in simhash.near_links(nodes, radius, blocks).collect()]
    code = dict(rows)
    want = slow_components(rows, radius)
    assert all(want[a] == want[b] for a, b in links)
    from tagloom.llm.components import components

    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()} if links else {}
    assert {k: got.get(k, k) for k in code} == want


def test_close_pairs_are_complete_and_not_repeated():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    codes = np.concatenate([base ^ np.uint64(1 << int(b)) for b in rng.integers(0, 60, 25)])
    groups = np.sort(rng.integers(0, 4, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes), groups))
    codes, groups = codes[order], groups[order]
    found = [(int(i), int(j)) for a, b in simhash.close_pairs(codes, groups, 3) for i, j in zip(a, b)]
    want = {
        (i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
        if groups[i] == groups[j] and np.bitwise_count(codes[i] ^ codes[j]) <= 3
    }
    assert len(found) == len(set(found)) and set(found) == want


def test_gray_neighbours_differ_in_one_bit():
    rank = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(rank ^ (rank >> np.uint64(1))) == rank).all()


def test_edge_rows(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [
        (5, None, "x"), (4, "", "x"), (9, " \n", None), (7, "same words here", "x"), (7, "same words here", "x"),
        (3, "Same words HERE", "y"), (20, long, "z"), (21, long, "z"), (None, "same words here", "q"), (None, "unkeyed only", "q"),
        (30, "first text of a key", "c"), (30, "second text, other words", "c"), (29, "second text, other words", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component string").withColumn("fp", F.lit("clash"))
    got = sorted((r.key, r.component) for r in simhash.near_duplicates(df).collect() if r.key is not None)
    assert got == [(3, 3), (4, 4), (5, 4), (7, 3), (7, 3), (9, 4), (20, 20), (21, 20), (29, 29), (30, 29), (30, 29)]
    unkeyed = [r.component for r in simhash.near_duplicates(df).collect() if r.key is None]
    assert sorted(unkeyed, key=str) == [3, None]
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = [(d.doc_id, slow_fingerprint(d.text, 3)) for d in docs]
    want = slow_components(rows, 3)
    got = QUERIES["op1_simhash_near_dedup"](spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted((k, f"{f:016x}", want[k]) for k, f in rows)
