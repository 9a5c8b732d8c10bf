"""Leaks against every window of every document, and against the check SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tagloom.llm import decontaminate as d
from tagloom.llm.queries import LEAKS_SQL, QUERIES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def slow(docs, items, similarity=0.8):
    """(document row number, item, similarity, start, words) by trying every window."""
    out = []
    for row, (_, text) in enumerate(docs):
        w = words(text)
        for name, item in items:
            v = words(item)
            if not v:
                continue
            k, size, best = min(5, len(v)), min(len(v), len(w)), None
            a = shingles(v, k)
            for start in range(max(1, len(w) - len(v) + 1)):
                b = shingles(w[start : start + size], k)
                common = sum((a & b).values())
                if b and (s := common / (sum(a.values()) + sum(b.values()) - common)) >= similarity and (best is None or s > best[0]):
                    best = (s, start, size)
            if best:
                out.append((docs[row][0], name, *best))
    return sorted(out, key=str)


def frames(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item": F.lit("clash"), "n": F.lit(0), "w": F.lit(0)}),
        spark.createDataFrame(items, "item_id bigint, text string").withColumns({"key": F.lit("clash"), "fp": F.lit(0)}),
    )


def run(spark, docs, items):
    rows = d.contaminated(*frames(spark, docs, items)).select("doc_id", "item", "similarity", "start", "words").collect()
    return sorted(map(tuple, rows), key=str)


def test_every_window(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(n))) for i, n in enumerate([5, 6, 12, 20, 30, 30, 57, 3, 1, 4])]
    items += [(20, "a b a b a b a b a b a b a b"), (21, items[4][1].upper() + "!!"), (None, items[3][1]), (22, None), (23, " ... "), (24, "")]
    docs = []
    for i in range(60):
        w = text(rng.randrange(0, 80))
        for _ in range(rng.randrange(3)):
            leak = words(rng.choice(items[:12])[1])
            if rng.random() < 0.6:
                leak[rng.choice([0, -1])] = "changed"
            cut = leak[: rng.randrange(max(1, len(leak) * 3 // 4), len(leak) + 1)] if rng.random() < 0.4 else leak
            at = rng.randrange(len(w) + 1)
            w[at:at] = cut
        docs.append((i, rng.choice([" ", "\n", "-- "]).join(w)))
    docs += [(100, None), (101, ""), (None, items[5][1]), (102, items[5][1]), (102, items[5][1]), (103, " ".join(["a b"] * 30)), (104, "a b a b a b a b a b a b a")]
    want = slow(docs, items)
    assert len(want) > 40 and len({w[2] for w in want}) > 5
    assert run(spark, docs, items) == want


def test_long_document_and_empty_tables(spark):
    item = " ".join(f"q{i}" for i in range(25))
    docs = [(1, "lorem ipsum dolor " * 30_000 + item + " sit amet" * 1000), (2, "clean")]
    assert run(spark, docs, [(9, item)]) == [(1, 9, 1.0, 90_000, 25)]
    assert run(spark, docs, []) == [] and run(spark, [], [(9, item)]) == []
    left, right = frames(spark, docs, [(9, item)])
    kept = d.clean(left, right)
    assert [r.doc_id for r in kept.collect()] == [2] and kept.columns == left.columns
    assert d.clean(*frames(spark, docs, [])).count() == 2


def test_blocks_meet_every_pair_within_the_radius(spark):
    """With a narrow radius only windows within it are verified, and all of them are."""
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(i, " ".join(["x"] * i + item.split()[i:])) for i in range(4)] + [(9, item)]
    left, right = frames(spark, docs, [(1, item)])
    assert [r.similarity for r in d.leaks(left, right, radius=0).collect()] == [1.0]  # two documents, one text
    assert len(d.leaks(left, right).collect()) == 3


@pytest.mark.parametrize("hashes", [[], [5], [-1, 3, 3], [1 << 62, -(1 << 63), 7]])
def test_fingerprint_bits(spark, hashes):
    got = spark.createDataFrame([(hashes,)], "h array<bigint>").select(d.fingerprint(F.col("h"))).first()[0]
    assert got & ((1 << 64) - 1) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_common_weight(spark):
    df = spark.createDataFrame([([1, 1, 2, 3, 3, 3], [1, 3, 3, 4]), ([], [1]), ([1], [])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(d.common_weight(F.col("a"), d._counted(F.col("b")))).collect()] == [3, 0, 0]


def test_no_python_in_the_plan(spark, sf_dir):
    plan = QUERIES["op7_benchmark_decontamination"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert sorted(map(tuple, QUERIES["op7_benchmark_decontamination"](spark, sf_dir).collect())) == sorted(con.execute(LEAKS_SQL).fetchall())
