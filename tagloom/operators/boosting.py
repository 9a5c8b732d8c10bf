"""Boosted classification trees of several folds at once, level by level from sums over binned rows.

Every row is kept as one byte a feature, its bin between the candidate thresholds, and one for its label, in lanes of bounded size.
A level of a tree is one job: each partition adds count, sum and squares of the residuals by node, feature and bin, for all folds;
the driver sees these sums only and picks the splits. A residual follows from the trees grown so far, so nothing but the bins is
kept between jobs. Loss (logistic), impurity (variance), candidate thresholds and ties follow Spark ML's boosted classifier, and
the result is a model of that library with the same trees.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.training import vector_sums
from tagloom.session import shared_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a lane (its numbers stay in a core's cache) and lanes of a partition (a task has a start-up cost at every level).
LANE_ROWS, MOST_LANES = 16_384, 512
#: Values of a table of several trees, so that a place in it is one byte; a tree of more has one of its own.
MOST_VALUES = 256
#: Bins of a feature (a sample's shares may come to a few more), rows that candidate thresholds are taken from (expected), and the weight of a tree after the first.
BINS, SAMPLE_ROWS, RATE = 32, 10_000, 0.1
NODES = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double,"
    " leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)


@dataclass
class Node:
    """Count, sum and squares of the residuals, and the split: feature, bin that still goes left, gain."""

    stats: np.ndarray
    split: tuple[int, int, float] | None = None

    def impurity(self) -> float:
        return float(_variance(*self.stats))

    def prediction(self) -> float:
        return float(self.stats[1] / self.stats[0])


@dataclass
class Tree:
    """Nodes by level and place; a leaf's rows stay at the left-most place below it."""

    depth: int
    levels: list[dict[int, Node]] = field(default_factory=list)

    def splits(self, upto: int) -> list[list[tuple[int, int, int]]]:
        levels = [*self.levels, *[{}] * upto][:upto]
        return [[(at, *node.split[:2]) for at, node in level.items() if node.split] for level in levels]

    def values(self, weight: float) -> np.ndarray:
        """Weighted predictions by the place of a row after ``depth`` levels."""
        out = np.zeros(1 << self.depth)
        for k, level in enumerate(self.levels):
            for at, node in level.items():
                if node.split is None:
                    out[at << (self.depth - k)] = node.prediction() * weight
        return out


def _variance(n, s, q):
    return np.where(n > 0, (q - s * s / np.maximum(n, 1)) / np.maximum(n, 1), 0.0)


def thresholds(values: np.ndarray, expected: float, bins: int = BINS) -> np.ndarray:
    """Candidate thresholds of a feature from its sampled values; ``expected``: the expected number of samples.

    Midpoints of neighbouring values, of all if these are no more than the bins, else of those nearest to equal shares. As in the
    library, values other than zero are counted and zero stands for what is missing from the expected number.
    """
    other = values[values != 0]
    if not len(other):
        return np.empty(0)
    found, counts = np.unique(other, return_counts=True)
    counts = counts.astype(float)
    if expected - len(other) > np.finfo(float).eps * len(other) * 100:
        place = int(np.searchsorted(found, 0.0))
        found, counts = np.insert(found, place, 0.0), np.insert(counts, place, expected - len(other))
    middle = (found[:-1] + found[1:]) / 2
    if len(middle) <= bins - 1:
        return middle
    out, target, stride, reached = [], expected / bins, expected / bins, counts[0]
    for i in range(1, len(found)):
        before, reached = reached, reached + counts[i]
        if abs(before - target) < abs(reached - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _sampled(df: DataFrame, rows: int, most: int, seed: int) -> tuple[np.ndarray, float]:
    """About ``most`` of the rows, by column, and their expected number; the draw is the library's, so thresholds are the same."""
    if rows <= most:
        return _columns(df), float(rows)
    spark, share = df.sparkSession, most / rows
    draw = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    drawn = df._jdf.toJavaRDD().sample(False, share, draw)
    return _columns(DataFrame(spark._jsparkSession.createDataFrame(drawn, df._jdf.schema()), spark)), share * rows


def _columns(df: DataFrame) -> np.ndarray:
    table = df.toArrow()
    return np.array([table[c].to_numpy() for c in table.column_names])


def lanes(rows: DataFrame, cuts: dict[int, list[np.ndarray]], number: int) -> tuple[DataFrame, int]:
    """(fold, data) and its partitions: bins by feature, then the label, of at most ``LANE_ROWS`` rows, a byte each.

    ``rows`` has the features, the label and, last, the column that differs from a fold in the rows it learns from.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[np.ndarray]] = {f: [] for f in cuts}
        first, made = TaskContext.get().partitionId(), 0

        def out(fold: int, all_rows: bool) -> Iterator[pa.RecordBatch]:
            nonlocal made
            if sum(k.shape[1] for k in kept[fold]) < (1 if all_rows else LANE_ROWS):
                return
            whole = np.concatenate(kept[fold], axis=1)
            end = whole.shape[1] if all_rows else whole.shape[1] // LANE_ROWS * LANE_ROWS
            kept[fold] = [whole[:, end:]]
            for start in range(0, end, LANE_ROWS):
                data = whole[:, start : min(start + LANE_ROWS, end)].tobytes()
                yield pa.RecordBatch.from_pydict({"fold": pa.array([fold], pa.int32()), "place": pa.array([first + made], pa.int32()), "data": pa.array([data], pa.binary())})
                made += 1

        for batch in batches:
            *inputs, y, apart = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for fold, limits in cuts.items():
                mine = apart != fold
                kept[fold].append(np.array([*(np.searchsorted(t, x[mine]) for t, x in zip(limits, inputs)), y[mine]], dtype=np.uint8))
                yield from out(fold, False)
        for fold in cuts:
            yield from out(fold, True)

    cores = max(rows.sparkSession.sparkContext.defaultParallelism, 1)
    parts = -(-max(number, 1) // (LANE_ROWS * MOST_LANES * cores)) * cores  # whole rounds of all cores
    packed = rows.mapInArrow(pack, "fold int, place int, data binary")
    return packed.repartitionById(parts, F.col("place") % parts).select("fold", "data"), parts


def _chosen(right: list[np.ndarray | None], way: Sequence[np.ndarray]) -> np.ndarray | None:
    """For each row the test of its node, eight rows a byte: ``right`` has those of all nodes of a level, ``way`` the bits that led there."""
    for bit in reversed(way):
        pairs, right = zip(right[::2], right[1::2]), []
        for a, b in pairs:
            if a is None or b is None:
                right.append(b & bit if b is not None else None if a is None else a & ~bit)
            else:
                right.append(a ^ ((a ^ b) & bit))
    return right[0]


def places(x: np.ndarray, splits: Sequence[Sequence[tuple[int, int, int]]], tests: dict | None = None) -> np.ndarray:
    """Place of each row after the levels of ``splits``; ``tests`` keeps the outcome of a test for other trees."""
    tests, way = {} if tests is None else tests, []
    at = np.zeros(x.shape[1], np.min_scalar_type(max((1 << len(splits)) - 1, 1)))
    for k, level in enumerate(splits):
        right: list[np.ndarray | None] = [None] * (1 << k)
        for node, feature, last in level:
            if (feature, last) not in tests:
                tests[feature, last] = np.packbits(x[feature] > last)
            right[node] = tests[feature, last]
        bit = _chosen(right, way)
        way.append(np.zeros(-(-x.shape[1] // 8), np.uint8) if bit is None else bit)
        at += at
        at |= np.unpackbits(way[-1], count=x.shape[1])
    return at


def tables(grown: Sequence[tuple]) -> list[tuple[list, np.ndarray]]:
    """Neighbouring trees with one table of their summed values by all their places: one look-up for several trees."""
    out: list[tuple[list, np.ndarray]] = []
    for levels, values in grown:
        if out and len(out[-1][1]) * len(values) <= MOST_VALUES:
            out[-1] = [*out[-1][0], levels], np.add.outer(out[-1][1], values).ravel()
        else:
            out.append(([levels], values))
    return out


def scores(x: np.ndarray, grown: Sequence[tuple[list, np.ndarray]], tests: dict | None = None) -> np.ndarray:
    """Sum of the trees' values by row, from ``tables``."""
    total, tests = np.zeros(x.shape[1]), {} if tests is None else tests
    for together, values in grown:
        at = places(x, together[0], tests)
        for levels in together[1:]:
            for _ in levels:
                at += at
            at |= places(x, levels, tests)
        total += values.take(at)
    return total


def level_sums(x: np.ndarray, y: np.ndarray, bins: int, grown: Sequence[tuple[list, np.ndarray]], splits: Sequence) -> np.ndarray:
    """Count, sum and squares of the residuals by node of the next level, feature and bin; ``y`` is -1 or 1, ``grown`` from ``tables``."""
    r, tests = y, {}
    if grown:
        with np.errstate(over="ignore"):
            r = 4 * y / (1 + np.exp(2 * y * scores(x, grown, tests)))
    squares, size = r * r, bins << len(splits)
    start = places(x, splits, tests).astype(np.intp) * bins
    out = np.empty((3, len(x), size))
    for f, found in enumerate(x):
        key = start + found
        out[0, f], out[1, f], out[2, f] = np.bincount(key, minlength=size), np.bincount(key, r, size), np.bincount(key, squares, size)
    return out.reshape(3, len(x), -1, bins).transpose(2, 0, 1, 3)


def best_split(sums: np.ndarray, splits: Sequence[int], stats: np.ndarray) -> tuple[tuple[int, int, float], np.ndarray, np.ndarray] | None:
    """The split of largest gain, the first of equals, with both sides' statistics; None: no split gains."""
    best = None
    for f, count in enumerate(splits):
        if not count:
            continue
        upto = np.cumsum(sums[:, f], axis=1)
        left, all_rows = upto[:, :count], upto[:, count : count + 1]
        right = all_rows - left
        total = left[0] + right[0]
        gain = _variance(*stats) - left[0] / total * _variance(*left) - right[0] / total * _variance(*right)
        gain = np.where((left[0] >= 1) & (right[0] >= 1), gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > 0 and (best is None or gain[at] > best[0][2]):
            best = (f, at, float(gain[at])), left[:, at], right[:, at]
    return best


def _grow(tree: Tree, found: np.ndarray, splits: Sequence[int]) -> None:
    """One more level of ``tree`` from the sums of its nodes."""
    k = len(tree.levels) - 1
    if k < 0:
        tree.levels.append({0: Node(np.cumsum(found[0, :, 0], axis=1)[:, -1])})
        k = 0
    below: dict[int, Node] = {}
    for at, node in tree.levels[k].items():
        if k >= tree.depth or (k and abs(node.impurity()) < np.finfo(float).eps):
            continue
        if best := best_split(found[at], splits, node.stats):
            node.split = best[0]
            below |= {2 * at: Node(best[1]), 2 * at + 1: Node(best[2])}
    tree.levels.append(below)


def _open(tree: Tree) -> bool:
    return not tree.levels or (len(tree.levels) <= tree.depth and any(abs(n.impurity()) >= np.finfo(float).eps for n in tree.levels[-1].values()))


def fit(df: DataFrame, features: Sequence[str], label: str, apart: Column, folds: Sequence[int], trees: int = 20, depth: int = 3, seed: int = 42) -> dict[int, GBTClassificationModel]:
    """One model a fold, learned from the rows in which ``apart`` is known and differs from the fold. Labels are 0 and 1."""
    names = [f"x{i}" for i in range(len(features))]
    inputs = [F.col(f).cast("double").alias(n) for f, n in zip(features, names)]
    rows = df.select(*inputs, F.col(label).cast("double").alias("y"), apart.cast("double").alias("apart")).where("apart IS NOT NULL")
    right = F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(False))
    for name in names:
        right = right & F.coalesce(F.abs(name) < float("inf"), F.lit(False))  # NaN is the largest number
    *counts, bad = rows.agg(*[F.count_if(F.col("apart") != f) for f in folds], F.count_if(~right)).first()
    if bad or not all(counts):
        raise ValueError(f"{bad} rows with a missing or infinite feature or a label other than 0 and 1" if bad else "a fold has no rows to learn from")
    cuts: dict[int, list[np.ndarray]] = {}
    for fold, count in zip(folds, counts):
        values, expected = _sampled(rows.where(F.col("apart") != fold).select(*names), count, SAMPLE_ROWS, seed)
        cuts[fold] = [thresholds(v, expected, min(BINS, count)) for v in values]
    packed, parts = lanes(rows, cuts, sum(counts))
    packed = packed.persist()
    try:
        grown = _boost(packed, parts, cuts, trees, depth)
    finally:
        packed.unpersist()
    shared = {"featuresCol": "_x", "labelCol": label, "maxDepth": depth, "seed": seed}
    whole = _settings(df.sparkSession, GBTClassifier(maxIter=trees, **shared))
    single = _settings(df.sparkSession, DecisionTreeRegressor(**shared))
    return {fold: _model(df.sparkSession, grown[fold], cuts[fold], whole, single) for fold in folds}


def _boost(packed: DataFrame, parts: int, cuts: dict[int, list[np.ndarray]], trees: int, depth: int) -> dict[int, list[Tree]]:
    width, bins = len(next(iter(cuts.values()))), 1 + max(len(c) for found in cuts.values() for c in found)
    grown: dict[int, list[Tree]] = {f: [] for f in cuts}
    done: dict[int, list[tuple]] = {f: [] for f in cuts}
    for t in range(trees):
        tree = {f: Tree(depth) for f in cuts}
        while live := [f for f in cuts if _open(tree[f])]:
            work = {f: (tables(done[f]), tree[f].splits(max(len(tree[f].levels) - 1, 0))) for f in live}

            def run(batches: Iterator[pa.RecordBatch], work=work) -> Iterator[pa.RecordBatch]:
                sums: dict[int, np.ndarray] = {}
                for batch in batches:
                    for fold, data in zip(batch["fold"].to_pylist(), batch["data"]):
                        if fold in work:
                            bytes_ = np.frombuffer(data.as_buffer(), dtype=np.uint8).reshape(width + 1, -1)
                            made = level_sums(bytes_[:-1], bytes_[-1] * 2.0 - 1.0, bins, *work[fold]).ravel()
                            sums[fold] = sums[fold] + made if fold in sums else made
                part = TaskContext.get().partitionId()
                for fold, made in sums.items():
                    yield pa.RecordBatch.from_pydict({"grp": pa.array([fold], pa.int32()), "lane": pa.array([part], pa.int32()), "sums": pa.array([made], pa.list_(pa.float64()))})

            numbers = sum(3 * width * bins << len(splits) for _, splits in work.values())
            found = vector_sums(packed.mapInArrow(run, "grp int, lane int, sums array<double>"), parts, numbers)
            for f in live:
                _grow(tree[f], found[f].reshape(-1, 3, width, bins), [len(c) for c in cuts[f]])
        for f in cuts:
            grown[f].append(tree[f])
            done[f].append((tree[f].splits(depth), tree[f].values(RATE if t else 1.0)))
    return grown


def _node_rows(number: int, tree: Tree, cuts: Sequence[np.ndarray]) -> list[tuple]:
    """Nodes in the library's order: a node, all below its left side, all below its right."""
    rows: list[tuple | None] = []

    def add(k: int, at: int) -> int:
        node, mine = tree.levels[k][at], len(rows)
        rows.append(None)
        gain, left, right, split = -1.0, -1, -1, (-1, [], -1)
        if node.split:
            feature, last, gain = node.split
            left, right = add(k + 1, 2 * at), add(k + 1, 2 * at + 1)
            split = (feature, [float(cuts[feature][last])], -1)
        rows[mine] = (number, (mine, node.prediction(), node.impurity(), node.stats.tolist(), int(node.stats[0]), gain, left, right, split))
        return mine

    add(0, 0)
    return rows


def _settings(spark: SparkSession, estimator) -> dict:
    """What the library stores of an estimator's parameters."""
    path = shared_dir(spark, "estimator")
    estimator.write().save(path)
    return json.loads(spark.read.text(f"{path}/metadata").first()[0])


def _model(spark: SparkSession, grown: Sequence[Tree], cuts: Sequence[np.ndarray], whole: dict, single: dict) -> GBTClassificationModel:
    """The trees as a model of the library, through its own storage format."""
    path, number = shared_dir(spark, "boosted"), len(grown)
    whole = json.dumps({**whole, "class": "org.apache.spark.ml.classification.GBTClassificationModel", "numFeatures": len(cuts), "numTrees": number})
    single = json.dumps({**single, "class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel"})
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    weights = [(t, single, RATE if t else 1.0) for t in range(number)]
    spark.createDataFrame(weights, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    nodes = [row for t, tree in enumerate(grown) for row in _node_rows(t, tree, cuts)]
    spark.createDataFrame(nodes, NODES).coalesce(1).write.parquet(f"{path}/data")
    return GBTClassificationModel.load(path)
