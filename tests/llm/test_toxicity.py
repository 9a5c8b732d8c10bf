"""The fit coordinate by coordinate, the features by hand, accuracy on held-out rows."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import toxicity
from tagloom.llm.queries import QUERIES


def slow_ftrl(rows, alpha, beta, l1, l2, epochs):
    z, n, order = {}, {}, np.random.default_rng(0)

    def weight(i, l1):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            y, at = rows[k]
            w = {i: weight(i, l1) for i in at} | {"bias": weight("bias", 0.0)}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i, 0.0 if i == "bias" else l1) for i in z}


def test_ftrl_against_a_plain_loop():
    rng = np.random.default_rng(5)
    rows = [(int(i % 3 == 0), np.unique(rng.integers(0, 40, 6)).astype(np.int32)) for i in range(60)]
    model = toxicity.ftrl(rows, alpha=0.5, l1=0.3, l2=0.2, epochs=3, balance=0.0)
    want = slow_ftrl(rows, 0.5, 1.0, 0.3, 0.2, 3)
    assert abs(model.bias - want.pop("bias")) < 1e-9
    got = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    assert set(got) == {i for i, w in want.items() if w} and 0 < len(got) < 40
    assert all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_features_are_words_pairs_and_skipped_pairs():
    h = toxicity.WordHashes()
    f = lambda t: toxicity.features(t, h).tolist()
    assert f("One, two three") == f("one two THREE###") and len(f("one two three")) == 3 + 2 + 1
    assert f("one x two")[5] == f("one y two")[5] and f("one x two")[3] != f("one y two")[3]
    assert f(None) == f("") == f(" \n") == []
    assert f("a b")[2] != f("b a")[2]


def test_the_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_WORDS", 3)
    h = toxicity.WordHashes()
    text = "a b c d e f g a b"
    assert (toxicity.features(text, h) == toxicity.features(text, toxicity.WordHashes())).all() and len(h) <= 3


def test_scores_of_edge_rows(spark):
    long = "calm words here " * 40_000
    docs = [(i, ("you are scum " if i % 2 else "a calm day ") + f"w{i}", "k") for i in range(400)]
    edge = [(1000, None, "k"), (1001, "", "k"), (None, "you are scum", None), (1002, long, "k"), (7, "you are scum w7", "again")]
    df = spark.createDataFrame(docs + edge, "doc_id bigint, text string, label string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(400)] + [(3, 0), (3, None), (None, 1), (5000, 1)], "doc_id bigint, toxic int"
    ).withColumn("text", F.lit("clash"))
    model = toxicity.train(df, labels)
    assert len(toxicity.train(df, labels, most_rows=10).buckets) <= len(model.buckets) < 50
    rows = toxicity.scored(df, model).collect()
    assert len(rows) == 405 and rows[0].label == "k"
    got = {(r.doc_id, r.label): r.score for r in rows}
    assert all((got[i, "k"] >= 0.5) == bool(i % 2) for i in range(400))
    assert got[1000, "k"] == got[1001, "k"] == 1 / (1 + math.exp(-model.bias)) and 0 <= got[1002, "k"] < 0.5 <= got[None, None]
    assert toxicity.scored(df.limit(0), model).collect() == []


def test_no_labels_score_one_half(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    model = toxicity.train(df, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert toxicity.scored(df, model).first().score == 0.5


def test_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = QUERIES["op4_toxicity"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    test = [(truth[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = [s for y, s in test if y], [s for y, s in test if not y]
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros)) > 0.85
    assert sum(s >= 0.5 for s in zeros) <= 0.05 * len(zeros)


def test_labels_of_held_out_rows_do_not_matter(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.bias == b.bias and (a.buckets == b.buckets).all() and (a.weights == b.weights).all()
