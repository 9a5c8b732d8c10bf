"""Tree and linear models on Spark ML, tree-to-cut export, and two-fold scoring."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    DecisionTreeClassifier,
    LogisticRegression,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators import boosting, trees
from tagloom.operators.cuts import SIMULATION_SIGNAL_TERM, cut_predicate, gated_score
from tagloom.operators.ranking import bounded_local, join_null_safe


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x", handleInvalid="keep").transform(df)


def class_codes(names: Sequence[str], column: Column) -> Column:
    """Numeric label of a class name: its position in ``names``."""
    chain = F
    for i, name in enumerate(names):
        chain = chain.when(column == name, F.lit(float(i)))
    return chain


def class_names(names: Sequence[str], code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), code.cast("int") + 1)


def class_weights(df: DataFrame, label: str, out: str = "class_weight") -> DataFrame:
    """Balanced weights N / (k * N_class); the class table has one row per class."""
    sizes = bounded_local(df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    rows, classes = sizes.agg(F.sum("_n"), F.count(F.lit(1))).first()
    weights = sizes.select(label, (F.lit(rows / classes) / F.col("_n")).alias(out))
    return join_null_safe(df, weights, [label])


def train_tree(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    depth: int = 6,
    min_gain: float = 0.009,
    balanced: bool = True,
    seed: int = 42,
    bins: int = 32,
) -> DecisionTreeClassificationModel:
    """Class-balanced decision tree; rows stay distributed, splits come from statistics in ``bins`` bins a feature.

    A feature with no more distinct values than bins is split exactly."""
    work = class_weights(df, label) if balanced else df.withColumn("class_weight", F.lit(1.0))
    work = assemble(work, features).select("_x", label, "class_weight")
    tree = DecisionTreeClassifier(
        featuresCol="_x", labelCol=label, weightCol="class_weight", maxDepth=depth, minInfoGain=min_gain, maxBins=bins, seed=seed
    )
    return tree.fit(work)


def tree_paths(model: DecisionTreeClassificationModel, df: DataFrame, features: Sequence[str], names: Sequence[str]) -> dict[str, list[str]]:
    """Root-to-leaf conditions by predicted class, thresholds with four decimals, all tests of one feature merged.

    Every path ends with the term that excludes the signal's own tracks. ``df`` gives the session; a tree has few leaves.
    """
    lines = trees.cut_lines(trees.path_limits(trees.node_table(model, df), model.depth), features)
    paths: dict[str, list[str]] = {}
    for row in lines.orderBy("node").collect():
        text = " & ".join([row["line"], SIMULATION_SIGNAL_TERM] if row["line"] else [SIMULATION_SIGNAL_TERM])
        paths.setdefault(names[int(row["prediction"])], []).append(text)
    return paths


def cut_texts(paths: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """One cut text per class, alternatives joined by OR lines."""
    return {name: "\nOR\n".join(lines) for name, lines in paths.items()}


def apply_cut_texts(df: DataFrame, texts: Mapping[str, str], out: str = "cut_class") -> DataFrame:
    """Class whose cut text a track passes; the texts of one tree are disjoint."""
    chain = F
    for name in sorted(texts):
        chain = chain.when(F.expr(cut_predicate(texts[name])), name)
    return df.withColumn(out, chain.otherwise("none"))


def positive_probability(df: DataFrame, out: str, vector: str = "probability") -> DataFrame:
    return df.withColumn(out, vector_to_array(vector).getItem(1))


def predict(model: Model, df: DataFrame, features: Sequence[str], out: str = "score") -> DataFrame:
    """Positive-class probability and predicted label next to the original columns."""
    scored = positive_probability(model.transform(assemble(df, features)), out)
    return scored.select(*df.columns, out, F.col("prediction").alias(f"{out}_label"))


def feature_importances(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    values = model.featureImportances.toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def logistic_on_score(df: DataFrame, score: str, label: str):
    """Logistic regression of the label on one score."""
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0, tol=1e-10, maxIter=200)
    return model.fit(assemble(df, [score]).select("_x", F.col(label).cast("double").alias(label)))


def two_fold_models(df: DataFrame, features: Sequence[str], label: str, number: str, trees: int = 20, depth: int = 3, seed: int = 42):
    """One boosted classifier per parity of the event number, each trained on the other parity."""
    return boosting.fit(df, features, label, F.pmod(F.col(number), F.lit(2)), (0, 1), trees, depth, seed)


def two_fold_score(df: DataFrame, models: Mapping[int, Model], features: Sequence[str], number: str, passed: Column, out: str = "score") -> DataFrame:
    """Score every row with the model that did not see its parity; gated rows get the default.

    Both ensembles are expressions over the features, so it is one projection of one scan. A row without a number counts as odd.
    """
    parity = F.coalesce(F.pmod(F.col(number), F.lit(2)), F.lit(1))
    named = [f"`{f}`" for f in features]
    score = [F.expr(trees.compiled(models[p], df, named)) for p in (0, 1)]
    return df.withColumn(out, gated_score(F.when(parity == 0, score[0]).otherwise(score[1]), passed))
