"""Edge rules of event reductions, joins and ranking, against brute force on small frames."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tagloom.functions import tagging as tag
from tagloom.operators import events, joins, ranking, stats


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_best_track_ties_and_unselected(spark):
    df = spark.createDataFrame(
        [(1, 1, 1, 0.3), (1, 2, 1, 0.3), (1, 3, 0, 0.1), (2, 1, 0, 0.5), (2, 2, 0, 0.5)],
        "entry long, sub int, selected int, eta double",
    )
    best = events.best_track_per_event(df, ["entry"], "selected", "eta", ["sub"])
    assert rows(best, "entry") == [(1, 1, 1, 0.3), (2, 1, 0, 0.5)]


def test_flip_rule(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 1), (1, 0.49, 1), (1, 0.0, 1), (-1, 1.0, 1), (1, 0.2, 0), (1, 0.9, None)],
        "d int, prob double, selected int",
    )
    out = df.select(
        tag.final_decision(F.col("d"), F.col("prob"), F.col("selected")).alias("d"),
        F.round(tag.final_mistag(F.col("prob"), F.col("selected")), 10).alias("eta"),
    )
    assert rows(out) == [(1, 0.5), (-1, 0.49), (-1, 0.0), (-1, 0.0), (0, 0.5), (0, 0.5)]


def test_two_candidates_compare_within_event(spark):
    # entry 7 is the second candidate of (1, 1) but the only one of (1, 2): it must stay there
    df = spark.createDataFrame([(1, 1, 5), (1, 1, 7), (1, 2, 7)], "run int, event int, entry long")
    kept = events.drop_multiple_candidates(df, ["run", "event"], "entry")
    assert sorted(rows(kept)) == [(1, 1, 5), (1, 2, 7)]


def test_outer_join_gap_and_first_row(spark):
    a = spark.createDataFrame([("x", 1, 0.2, 1), ("x", -1, 0.1, 2), ("y", 1, 0.4, 1)], "key string, d int, eta double, pos int")
    b = spark.createDataFrame([("z", -1, 0.3, 1)], "key string, d int, eta double, pos int")
    wide = joins.outer_join_taggers({"A": a, "B": b}, "key", order=["pos"])
    assert rows(wide.select("key", "A_d", "A_eta", "B_d", "B_eta"), "key") == [
        ("x", 1, 0.2, None, None), ("y", 1, 0.4, None, None), ("z", None, None, -1, 0.3),
    ]
    plain = joins.outer_join_taggers({"A": a.filter("pos = 1"), "B": b}, "key")
    assert rows(plain.select("key", "A_d", "B_d"), "key") == [("x", 1, None), ("y", 1, None), ("z", None, -1)]


def test_attach_by_key_fails_on_missing_partner(spark):
    df = spark.createDataFrame([(1,), (2,)], "k int")
    extra = spark.createDataFrame([(1, 0.5)], "k int, w double")
    with pytest.raises(PySparkException):
        joins.attach_by_key(df, extra, "k").collect()
    assert rows(joins.attach_by_key(df, extra, "k", check=False), "k") == [(1, 0.5), (2, None)]


def test_minimum_per_event_with_hot_event(spark):
    rng = random.Random(1)
    data = [(0 if rng.random() < 0.4 else rng.randrange(1, 50), rng.uniform(-3, 3)) for _ in range(3000)]
    df = spark.createDataFrame(data, "entry int, x double")
    got = events.min_abs_per_event(df, "x", ["entry"], "m").toPandas()
    want = pd.DataFrame(data, columns=["entry", "x"])
    want["m"] = want.x.abs().groupby(want.entry).transform("min")
    assert len(got) == len(want)
    merged = got.groupby("entry").m.first()
    assert np.allclose(merged.sort_index(), want.groupby("entry").m.first().sort_index())


def test_dense_ids_match_group_numbers(spark):
    rng = random.Random(2)
    data = [(rng.randrange(0, 40), rng.randrange(-30, 30)) for _ in range(800)]
    df = spark.createDataFrame(data, "run int, event int")
    got = ranking.dense_ids(df, "run", "event", "id").distinct().toPandas()
    want = {k: i for i, k in enumerate(sorted(set(data)))}
    assert {(r.run, r.event): r.id for r in got.itertuples()} == want


@pytest.mark.parametrize("hot", [False, True])
def test_running_sums_and_quantile(spark, hot):
    rng = random.Random(3)
    values = [5.0 if hot and i % 3 == 0 else round(rng.gauss(0, 10), 3) for i in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counted = df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.running_sums(counted, "x", ["n"], ranking.value_edges(df, "x", 16)).toPandas().sort_values("x")
    assert (got.n_before.to_numpy() == np.concatenate([[0], np.cumsum(got.n.to_numpy())[:-1]])).all()
    assert (got.n_total == 2000).all()
    for q in (0.0, 0.31, 0.995, 1.0):
        assert ranking.exact_quantile(df, "x", q).first()[0] == pytest.approx(np.quantile(values, q))


def test_roc_area_with_ties(spark):
    rng = random.Random(4)
    data = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(1500)]
    df = spark.createDataFrame(data, "s double, y int")
    pos = np.array([s for s, y in data if y]), np.array([s for s, y in data if not y])
    pairs = pos[0][:, None] - pos[1][None, :]
    want = ((pairs > 0).sum() + 0.5 * (pairs == 0).sum()) / pairs.size
    assert stats.roc_auc(df, "s", "y").first()["auc"] == pytest.approx(want)


def test_count_events(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "event int, selected int")
    assert rows(events.count_events(df, "event", "selected")) == [(3, 2, 4, 2)]


def test_mask_overlap(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (None, 1)], "a int, b int")
    assert rows(joins.mask_overlap(df, F.col("a") == 1, F.col("b") == 1)) == [(1, 2, 1, False)]
