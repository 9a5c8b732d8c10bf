"""Trees as tables of nodes: limits of every path by level-wise joins, and scores as one JVM expression.

A fitted model is stored once and its nodes are read back as rows (tree, node, left, right, feature, threshold, prediction, gain,
rows). Everything else is joins and sums over these, or an expression made from them: no model has to travel to the executors, and
the same expression runs in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tagloom.session import shared_dir

#: An expression with more nodes would be no smaller than the model.
MOST_NODES = 20_000


def node_table(model: Model, df: DataFrame) -> DataFrame:
    """Nodes of a tree or an ensemble; leaves have no feature and the children -1. ``df`` gives the session."""
    path = shared_dir(df.sparkSession, "model")
    model.write().save(path)
    stored = df.sparkSession.read.parquet(f"{path}/data")
    flat = stored.select(F.col("treeID").alias("tree"), "nodeData.*") if "treeID" in stored.columns else stored.withColumn("tree", F.lit(0))
    inner = F.col("leftChild") >= 0
    return flat.select(
        "tree", F.col("id").alias("node"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        "prediction", F.when(inner, F.col("gain")).alias("gain"), F.col("rawCount").alias("rows"),
    )


def path_limits(nodes: DataFrame, depth: int) -> DataFrame:
    """(tree, node, prediction, feature, above, upto): what a row must meet to reach a leaf, the tests of one feature merged.

    A leaf is reached if feature > above and feature <= upto; a missing limit is null. A tree of a single leaf gives one row
    without a feature. Paths grow by one level a join, ``depth`` levels at most.
    """
    inner = nodes.where("left >= 0")
    side = F.explode(F.array(F.struct(F.col("left").alias("child"), F.lit(True).alias("passed")), F.struct(F.col("right").alias("child"), F.lit(False).alias("passed"))))
    edges = inner.select("tree", F.col("node").alias("parent"), "feature", "threshold", side.alias("s")).select(
        "tree", "parent", "feature", F.col("s.child").alias("child"),
        F.when(~F.col("s.passed"), F.col("threshold")).alias("above"), F.when(F.col("s.passed"), F.col("threshold")).alias("upto"),
    )
    leaves = nodes.where("left < 0").select("tree", "node", "prediction")
    at = leaves.select("tree", "node", F.col("node").alias("child"))
    found = None
    for _ in range(depth):
        step = at.join(edges, ["tree", "child"]).select("tree", "node", "parent", "feature", "above", "upto")
        found = step if found is None else found.unionByName(step)
        at = step.select("tree", "node", F.col("parent").alias("child"))
    if found is None:
        return leaves.withColumns({"feature": F.lit(None).cast("int"), "above": F.lit(None).cast("double"), "upto": F.lit(None).cast("double")})
    merged = found.groupBy("tree", "node", "feature").agg(F.max("above").alias("above"), F.min("upto").alias("upto"))
    return leaves.join(merged, ["tree", "node"], "left")


def cut_lines(limits: DataFrame, features: Sequence[str], digits: int = 4) -> DataFrame:
    """(tree, node, prediction, line): the limits of a leaf as a cut text, features in their order; no limit: a true text."""
    name = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("feature") + 1)
    number = lambda c: F.format_string(f"%.{digits}f", F.col(c))
    low = F.when(F.col("above").isNotNull(), F.concat(F.lit("("), name, F.lit(" > "), number("above"), F.lit(")")))
    high = F.when(F.col("upto").isNotNull(), F.concat(F.lit("("), name, F.lit(" <= "), number("upto"), F.lit(")")))
    parts = F.sort_array(F.collect_list(F.struct("feature", F.concat_ws(" & ", low, high).alias("text"))))
    lines = limits.groupBy("tree", "node", "prediction").agg(parts.alias("parts"))
    text = F.array_join(F.filter(F.transform("parts", lambda p: p["text"]), lambda t: t != ""), " & ")
    return lines.select("tree", "node", "prediction", text.alias("line"))


def tree_text(rows: Mapping[int, Row], features: Sequence[str], value: str = "prediction", node: int = 0, tests: dict[str, str] | None = None) -> str:
    """One tree as nested CASE expressions; a missing or non-comparable input fails every test, as in the library.

    With ``tests`` the text refers to each test by a column's name, kept there, see ``with_tests``."""
    row = rows[node]
    if row["left"] < 0:
        return f"{row[value]:.17e}"
    passed, failed = (tree_text(rows, features, value, row[side], tests) for side in ("left", "right"))
    test = f"{features[row['feature']]} <= {row['threshold']:.17e}"
    if tests is not None:
        test = tests.setdefault(test, f"_test{len(tests)}")
    return f"CASE WHEN {test} THEN {passed} ELSE {failed} END"


def ensemble_text(nodes: Sequence[Row], weights: Sequence[float], features: Sequence[str], tests: dict[str, str] | None = None) -> str:
    """Positive-class probability of boosted trees, as SQL text over the columns ``features`` or those of ``tests``."""
    trees: dict[int, dict[int, Row]] = {}
    for row in nodes:
        trees.setdefault(row["tree"], {})[row["node"]] = row
    terms = [f"{weights[t]:.17e} * ({tree_text(trees[t], features, tests=tests)})" for t in sorted(trees)]
    return f"1e0 / (1e0 + exp(-2e0 * ({' + '.join(terms)})))"


def with_tests(df: DataFrame, tests: Mapping[str, str]) -> DataFrame:
    """The tests of ensembles as columns, one each.

    Trees share many tests. Taken once a row, they leave a shorter expression. Spelled out next to the library's score, that of 20
    trees ran six times slower in a session without ``RECOMMENDED``: the JVM does not compile methods above 8000 bytes.
    """
    return df.withColumns({name: F.expr(test) for test, name in tests.items()})


def compiled(model: Model, df: DataFrame, features: Sequence[str], tests: dict[str, str] | None = None) -> str:
    """``ensemble_text`` of a fitted boosted classifier."""
    table = node_table(model, df)
    if (number := table.count()) > MOST_NODES:
        raise ValueError(f"{number} nodes are too many for one expression")
    return ensemble_text(table.collect(), list(model.treeWeights), features, tests)
