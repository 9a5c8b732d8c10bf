"""Node tables, path limits and compiled ensembles against the fitted models."""

import re

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.sql import functions as F

from tagloom.operators import models, trees
from tagloom.plans import model_queries

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(800, 3)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.2)).astype(float)
    data = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y double").cache()


def test_limits_lead_every_row_to_its_leaf(spark, sample):
    work = models.assemble(sample, FEATURES)
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="y", maxDepth=5, seed=1).fit(work)
    nodes = trees.node_table(model, sample)
    assert nodes.count() == model.numNodes
    limits = trees.path_limits(nodes, model.depth).collect()
    by_leaf = {}
    for r in limits:
        by_leaf.setdefault(r["node"], []).append(r)
    assert len(by_leaf) == (model.numNodes + 1) // 2 and all(len({r["feature"] for r in rows}) == len(rows) for rows in by_leaf.values())
    for row in model.transform(work).collect():
        reached = [rows for rows in by_leaf.values() if all((r["above"] is None or row[FEATURES[r["feature"]]] > r["above"]) and (r["upto"] is None or row[FEATURES[r["feature"]]] <= r["upto"]) for r in rows)]
        assert len(reached) == 1 and reached[0][0]["prediction"] == row["prediction"]
    lines = trees.cut_lines(trees.path_limits(nodes, model.depth), FEATURES, 6)
    assert lines.count() == len(by_leaf)
    for r in lines.collect():
        assert sample.where(r["line"].replace("&", "AND")).count() > 0


def test_a_tree_of_one_leaf(spark, sample):
    work = models.assemble(sample.withColumn("y", F.lit(1.0)), FEATURES)
    model = DecisionTreeClassifier(featuresCol="_x", labelCol="y").fit(work)
    limits = trees.path_limits(trees.node_table(model, sample), model.depth).collect()
    assert [(r["prediction"], r["feature"], r["above"], r["upto"]) for r in limits] == [(1.0, None, None, None)]
    paths = models.tree_paths(model, sample, FEATURES, ["bg", "sig"])
    assert list(paths) == ["sig"] and len(paths["sig"]) == 1


def test_compiled_ensemble_equals_the_library(spark, sample):
    gaps = sample.withColumns({f: F.when(F.col("id") % k != 0, F.col(f)) for f, k in (("a", 7), ("b", 11))}).withColumn("c", F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("c")))
    model = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=20, maxDepth=3, seed=2).fit(models.assemble(sample, FEATURES))
    for df in (sample, gaps):
        both = models.predict(model, df, FEATURES, "library").withColumn("compiled", F.expr(trees.compiled(model, df, FEATURES)))
        assert both.agg(F.max(F.abs(F.col("library") - F.col("compiled")))).first()[0] < 1e-12
    plan = sample.withColumn("s", F.expr(trees.compiled(model, sample, FEATURES)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_tests_as_columns_give_the_same_scores(spark, sample):
    gaps = sample.withColumns({f: F.when(F.col("id") % k != 0, F.col(f)) for f, k in (("a", 7), ("b", 11))}).withColumn("c", F.when(F.col("id") % 13 == 0, float("nan")).otherwise(F.col("c")))
    model = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=8, maxDepth=3, seed=2).fit(models.assemble(sample, FEATURES))
    text = trees.compiled(model, sample, FEATURES, tests := {})
    assert "<=" not in text and len(set(tests.values())) == len(tests) == len(set(re.findall(r"WHEN (_test\d+) THEN", text)))
    for df in (sample, gaps):
        both = trees.with_tests(df, tests).withColumns({"short": F.expr(text), "long": F.expr(trees.compiled(model, df, FEATURES))})
        assert both.count() == 800 and both.where("short = long").count() == 800
    assert trees.with_tests(sample, {}).columns == sample.columns


def test_the_comparison_of_scores_takes_each_test_once(spark, sf_dir):
    found = model_queries.compiled_equals_library(spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    tests = re.findall(r"\((B_Tr_T_\w+#\d+ <= [^()]+)\)", plan)
    assert tests and len(tests) == len(set(tests))
    tracks, differing = found.first()
    assert tracks == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() and differing == 0


def test_too_large_an_ensemble_is_refused(spark, sample, monkeypatch):
    model = GBTClassifier(featuresCol="_x", labelCol="y", maxIter=2, maxDepth=2).fit(models.assemble(sample, FEATURES))
    monkeypatch.setattr(trees, "MOST_NODES", 5)
    with pytest.raises(ValueError):
        trees.compiled(model, sample, FEATURES)
