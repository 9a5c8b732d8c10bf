"""Boosted trees of both folds from sums over binned rows: the library's trees, at a bounded number of jobs and bytes."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from tagloom.operators import boosting, models, trees

FEATURES = ["a", "b", "c", "d"]


def frame(spark, n, seed=1, odd=False):
    """Continuous, skewed, repeated and doubled features; ``odd`` adds very large values, negative zeros and missing numbers."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.exponential(size=n) * (rng.random(n) > 0.3), rng.integers(0, 50, n).astype(float)
    y = ((a > 0) ^ (b * c > 12) ^ (rng.random(n) < 0.1)).astype(float)
    data = [(i, *map(float, r)) for i, r in enumerate(zip(a, b, c, c / 25, y))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double")
    if odd:
        df = df.withColumn("b", F.expr("CASE WHEN id % 13 = 0 THEN -1e300 WHEN id % 17 = 0 THEN double('-0.0') ELSE b END"))
        df = df.withColumn("id", F.when(F.col("id") % 31 != 0, F.col("id")))
    return df


def library(df, number, rounds, depth, seed=42):
    work = models.assemble(df, FEATURES).select("_x", "y", F.pmod(F.col(number), F.lit(2)).alias("_p"))
    fit = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=rounds, maxDepth=depth, seed=seed)
    return {p: fit.fit(work.where(F.col("_p") != p)) for p in (0, 1)}


def settings(model):
    return {p.name: v for p, v in model.extractParamMap().items()}


def nodes(model, df):
    return [tuple(r) for r in trees.node_table(model, df).orderBy("tree", "node").collect()]


@pytest.mark.parametrize("n, odd, rounds, depth", [(1500, False, 4, 3), (1500, True, 4, 3), (40, True, 3, 4), (50000, True, 3, 3), (50000, False, 2, 1)])
def test_trees_are_those_of_the_library(spark, n, odd, rounds, depth):
    df = frame(spark, n, odd=odd).repartition(3, "a").cache()
    found = models.two_fold_models(df, FEATURES, "y", "id", trees=rounds, depth=depth)
    for p, other in library(df, "id", rounds, depth).items():
        mine, theirs = nodes(found[p], df), nodes(other, df)
        assert len(mine) == len(theirs) and found[p].treeWeights == other.treeWeights
        for x, y in zip(mine, theirs):
            assert x[:5] == y[:5] and x[5] == y[5] and x[8] == y[8], (x, y)
            assert x[6] == pytest.approx(y[6], abs=1e-9) and (x[7] is None) == (y[7] is None)
        assert found[p].featureImportances.toArray() == pytest.approx(other.featureImportances.toArray(), abs=1e-6)
        assert settings(found[p]) == settings(other)
        both = models.predict(found[p], models.predict(other, df, FEATURES, "theirs"), FEATURES, "mine")
        assert both.where("abs(mine - theirs) > 1e-9").count() == 0
    df.unpersist()


def test_a_level_is_one_job_whose_rows_are_bytes(spark, monkeypatch):
    calls, kept = [], []
    sums, lanes = boosting.vector_sums, boosting.lanes
    monkeypatch.setattr(boosting, "vector_sums", lambda *a: calls.append(a) or sums(*a))
    monkeypatch.setattr(boosting, "lanes", lambda *a: kept.append(lanes(*a)) or kept[0])
    df = frame(spark, 40000)
    models.two_fold_models(df, FEATURES, "y", "id", trees=3, depth=2)
    assert len(calls) == 6
    packed = kept[0][0].select(F.length("data").alias("n")).collect()
    assert sum(r["n"] for r in packed) == 40000 * (len(FEATURES) + 1) and max(r["n"] for r in packed) <= boosting.LANE_ROWS * (len(FEATURES) + 1)


def test_one_class_and_bad_rows(spark):
    df = frame(spark, 300)
    flat = df.withColumn("y", F.lit(1.0))
    for p, other in library(flat, "id", 2, 3).items():
        found = models.two_fold_models(flat, FEATURES, "y", "id", trees=2)[p]
        both = models.predict(found, models.predict(other, flat, FEATURES, "theirs"), FEATURES, "mine")
        assert found.getNumTrees == 2 and both.where("abs(mine - theirs) > 1e-12").count() == 0
    for wrong in (F.lit(None).cast("int"), F.lit(2)):
        with pytest.raises(ValueError):
            models.two_fold_models(df.withColumn("y", F.when(F.col("id") == 5, wrong).otherwise(F.col("y"))), FEATURES, "y", "id", trees=1)
    for wrong in (None, float("nan"), float("-inf")):
        with pytest.raises(ValueError):
            models.two_fold_models(df.withColumn("a", F.when(F.col("id") == 5, F.lit(wrong).cast("double")).otherwise(F.col("a"))), FEATURES, "y", "id", trees=1)
    with pytest.raises(ValueError):
        models.two_fold_models(df.where("id % 2 = 0"), FEATURES, "y", "id", trees=1)


@pytest.mark.parametrize("depth", [1, 2, 3, 4, 9])
def test_places_and_scores_of_many_trees(depth):
    rng = np.random.default_rng(depth)
    x, grown, at = rng.integers(0, 12, (4, 1003), dtype=np.uint8), [], []
    for _ in range(7):
        levels, live, walked = [], [0], np.zeros(1003, int)
        for _ in range(depth):
            levels.append([(n, int(rng.integers(4)), int(rng.integers(11))) for n in live if rng.random() < 0.8])
            live = [c for n, _, _ in levels[-1] for c in (2 * n, 2 * n + 1)]
            split = {n: (f, last) for n, f, last in levels[-1]}
            walked = np.array([2 * a + (a in split and x[split[a][0], i] > split[a][1]) for i, a in enumerate(walked)])
        grown.append((levels, rng.normal(size=1 << depth)))
        at.append(walked)
        assert np.array_equal(boosting.places(x, levels), walked)
    together = boosting.tables(grown)
    assert len(together) == (7 if depth > 4 else -(-7 // (8 // depth))) and all(len(v) <= max(boosting.MOST_VALUES, 1 << depth) for _, v in together)
    assert boosting.scores(x, together) == pytest.approx(sum(v[a] for (_, v), a in zip(grown, at)), abs=1e-12)


def test_partitions_are_whole_rounds_of_all_cores(spark, monkeypatch):
    monkeypatch.setattr(boosting, "LANE_ROWS", 100)
    monkeypatch.setattr(boosting, "MOST_LANES", 2)
    rows = frame(spark, 2000).selectExpr(*FEATURES, "y", "CAST(id % 2 AS DOUBLE) AS apart")
    cuts = {f: [np.array([0.0])] * len(FEATURES) for f in (0, 1)}
    packed, parts = boosting.lanes(rows, cuts, 2000)
    cores = spark.sparkContext.defaultParallelism
    assert parts >= 10 and parts % cores == 0 and packed.rdd.getNumPartitions() == parts
    assert sum(len(r["data"]) for r in packed.collect()) == 2000 * (len(FEATURES) + 1)
