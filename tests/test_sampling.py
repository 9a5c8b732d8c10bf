"""Splits and balancing: exact sizes, whole events, strictness, hot groups."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tagloom.operators import sampling
from tagloom.operators.ranking import bounded_local, hash_cut_points, order_hash


def tracks(spark, n=2000, hot=0.35, seed=5):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        event = 0 if rng.random() < hot else rng.randrange(1, 200)
        data.append((i, event, int(rng.random() < 0.7), rng.choice([521, 521, 521, -521]), int(rng.random() < 0.8)))
    return spark.createDataFrame(data, "row long, event long, selected int, B_ID int, label int")


def md5(*parts):
    return hashlib.md5("_".join(map(str, parts)).encode()).hexdigest()


def test_cut_points_are_the_kth_hash(spark):
    df = tracks(spark).withColumn("h", order_hash(["row"], 3))
    for digits in (1, 2, 4):
        cut = hash_cut_points(df, "h", {"c": F.lit(137)}, digits=digits).first()
        assert cut["cut_hash"] == sorted(md5(i, 3) for i in range(2000))[136]
    assert hash_cut_points(df, "h", {"c": F.lit(0)}).collect() == []


def test_split_sizes_and_event_integrity(spark):
    df = tracks(spark)
    got = sampling.split_by_event(df, "event", train_val_fraction=0.6).toPandas()
    assert (got.groupby("event").subset.nunique() == 1).all()
    events = sorted(set(got.event), key=lambda e: md5(e, 3))
    both = int(0.6 * len(events))
    train = int(0.8 * both)
    sizes = got.groupby("subset").event.nunique().to_dict()
    assert sizes == {"train": train, "val": both - train, "test": len(events) - both}
    assert set(got[got.subset == "train"].event) == set(events[:train])


def test_split_honours_seed(spark):
    df = tracks(spark)
    a, b = (sampling.split_by_event(df, "event", seed=s).filter("subset = 'train'").select("event").distinct() for s in (3, 4))
    assert a.exceptAll(b).count() > 0


def test_four_bins_are_equal_and_strict(spark):
    df = tracks(spark).filter("selected = 1").withColumn("sign", (F.col("B_ID") > 0).cast("int"))
    kept = sampling.balance_classes(df, ["sign", "label"], ["row"], expected=4)
    counts = [r["count"] for r in kept.groupBy("sign", "label").count().collect()]
    smallest = min(r["count"] for r in df.groupBy("sign", "label").count().collect())
    assert counts == [smallest] * 4
    assert kept.select("row").distinct().count() == 4 * smallest
    with pytest.raises(ValueError):
        sampling.balance_classes(df.filter("NOT (sign = 0 AND label = 0)"), ["sign", "label"], ["row"], expected=4)
    soft = sampling.balance_classes(df.filter("NOT (sign = 0 AND label = 0)"), ["sign", "label"], ["row"])
    assert soft.groupBy("sign", "label").count().count() == 3


@pytest.mark.parametrize("level", [0, 1, 2])
def test_balanced_sets(spark, level):
    df = sampling.split_by_event(tracks(spark, hot=0.0), "event", train_val_fraction=0.6)
    out = sampling.balanced_sets(df, level, "subset", "selected", "B_ID", "label", ["row"]).toPandas()
    whole = df.toPandas()
    assert (out[out.subset != "test"].selected == 1).all()
    test_rows = out[out.subset == "test"]
    assert len(test_rows[test_rows.selected == 0]) == len(whole[(whole.subset == "test") & (whole.selected == 0)])
    for name in ["train", "val"] + (["test"] if level == 0 else []):
        part = out[(out.subset == name) & (out.selected == 1)]
        keys = [part.label] if level == 2 else [part.label, part.B_ID > 0]
        assert part.groupby(keys).size().nunique() == 1
    if level:
        assert len(test_rows) == len(whole[whole.subset == "test"])


def test_downsample_and_head(spark):
    df = tracks(spark)
    out = sampling.downsample_class(df, "label", 1, 10, ["row"])
    assert out.filter("label = 1").count() == 10
    assert out.filter("label = 0").count() == df.filter("label = 0").count()
    assert sampling.downsample_class(df, "label", 0, 10**9, ["row"]).count() == df.count()
    swapped = df.withColumn("label", 1 - F.col("label"))
    even = sampling.balance_head(swapped, "label", ["row"]).groupBy("label").count().collect()
    assert len({r["count"] for r in even}) == 1


def test_hash_split_covers_all_rows(spark):
    out = sampling.hash_split(tracks(spark), ["row"], {"train": 0.7, "test": 0.3}, 42)
    counts = {r["subset"]: r["count"] for r in out.groupBy("subset").count().collect()}
    assert sum(counts.values()) == 2000 and abs(counts["train"] - 1400) < 100


def test_bounded_local_keeps_large_tables_distributed(spark):
    df = spark.range(50)
    assert bounded_local(df, 10) is df
    assert bounded_local(df, 100).count() == 50
