"""Missing and repeated keys, values that are no numbers, appends, splits and fits at their limits."""

import math

import pytest
from pyspark.sql import functions as F

from tagloom.operators import cuts, events, expressions, joins, models, preprocessing, sampling, stats
from tagloom.operators.ranking import dense_ids
from tagloom.session import shared_root
from tagloom.sources import stages
from tagloom.streaming import incremental


def test_appends_add_and_repeats_replace(spark, tmp_path):
    path = str(tmp_path / "out")
    first, second = spark.range(100).toDF("k"), spark.range(1000, 1100).toDF("k")
    stages.append_in_chunks(first, "k", 10, path, "a")
    stages.append_in_chunks(second, "k", 10, path, "b")
    read = lambda: stages.read_batches(spark, path, "k long")
    assert read().count() == 200
    stages.append_in_chunks(second, "k", 10, path, "b")
    back = read()
    assert back.count() == 200 and back.select("batch", "chunk").distinct().count() == 20
    keyless = spark.createDataFrame([(None,), (5,)], "k long")
    stages.append_in_chunks(keyless, "k", 3, path, "c")
    assert read().count() == 202 and read().where("chunk = -1").count() == 1


def test_a_run_that_dies_before_publication_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    assert stages.read_batches(spark, path, "k long").collect() == []
    stages.append_in_chunks(spark.range(5).toDF("k"), "k", 2, path, "a")
    late = stages.write_chunks(spark.range(50, 70).toDF("k"), "k", 2, path, "a")  # and then the run dies
    stages.write_chunks(spark.range(90, 95).toDF("k"), "k", 2, path, "b")
    keys = lambda: sorted(r["k"] for r in stages.read_batches(spark, path, "k long").collect())
    assert keys() == [0, 1, 2, 3, 4]
    stages.publish(spark, path, "a", late)
    assert keys() == list(range(50, 70))


def test_a_half_written_set_is_built_again(spark, tmp_path):
    root = tmp_path / "sets"
    build = lambda: spark.range(4).withColumn("subset", F.lit("train"))
    build().limit(1).write.partitionBy("subset").parquet(str(root))
    (root / "_SUCCESS").unlink()
    assert stages.cached_sets(spark, str(root), build).count() == 4


def test_split_bounds(spark):
    df = spark.range(1000).toDF("k")
    counts = lambda parts: {r.subset: r["count"] for r in sampling.hash_split(df, ["k"], parts, 3).groupBy("subset").count().collect()}
    found = counts({"train": 0.7, "val": 0.3, "test": 0.0})
    assert set(found) == {"train", "val"} and abs(found["train"] - 700) < 60
    assert counts({"train": 1.0, "test": 0.0}) == {"train": 1000} and counts({"train": 0.0, "test": 1.0}) == {"test": 1000}
    for wrong in ({"a": 0.5, "b": 0.6}, {"a": 1.5, "b": -0.5}):
        with pytest.raises(ValueError):
            sampling.hash_split(df, ["k"], wrong, 3)


def test_shared_root():
    assert shared_root("hdfs://c", None, "yarn") == "hdfs://c"
    assert shared_root(None, "s3a://w/", "spark://h:1") == "s3a://w/_tagloom"
    assert shared_root(None, "file:/w", "local[4]") is None
    for master in ("yarn", "spark://h:1", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_root(None, "file:/w", master)


def test_missing_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, 2, -3.0), (1, 1, 2.0), (None, 7, 4.0), (None, 5, -1.0)], "e long, c long, v double")
    low = {(r.e, r.v): r.m for r in events.min_abs_per_event(df, "v", ["e"], "m").collect()}
    assert low == {(1, -3.0): 2.0, (1, 2.0): 2.0, (None, 4.0): 1.0, (None, -1.0): 1.0}
    kept = {(r.e, r.c) for r in events.drop_multiple_candidates(df, ["e"], "c").collect()}
    assert kept == {(1, 1), (None, 5)}
    ids = dense_ids(df, "e", "c", "id").collect()
    assert sorted(r.id for r in ids) == [0, 1, 2, 3]
    shares = {(r.e, r.c): r.percent for r in stats.value_counts(df, ["e", "c"], ["e"]).collect()}
    assert len(shares) == 4 and set(shares.values()) == {50.0}
    assert sum(r.percent for r in stats.value_counts(df, ["e"]).collect()) == 100.0
    weights = {(r.e, r.c): r.class_weight for r in models.class_weights(df, "e").collect()}
    assert len(weights) == 4 and set(weights.values()) == {1.0}


def test_scores_that_are_no_numbers_have_no_rank(spark):
    rows = [(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1), (float("nan"), 1), (None, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert stats.roc_auc(df, "s", "y").first().auc == pytest.approx(3.5 / 4)
    curve = sorted((r.fpr, r.tpr) for r in stats.roc_curve(df, "s", "y").collect())
    assert curve == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_outer_join_keeps_pairs_together(spark):
    a = spark.createDataFrame([(1, -1, 0.4), (None, 1, 0.2)], "e long, d int, eta double")
    b = spark.createDataFrame([(1, 1, 0.3), (2, 1, 0.1), (None, -1, 0.3)], "e long, d int, eta double")
    got = {tuple(r) for r in joins.outer_join_taggers({"A": a, "B": b}, "e").collect()}
    assert got == {(1, -1, 0.4, 1, 0.3), (2, None, None, 1, 0.1), (None, 1, 0.2, None, None), (None, None, None, -1, 0.3)}
    ordered = joins.outer_join_taggers({"A": a.union(a.selectExpr("e", "-d", "eta + 0.05")), "B": b}, "e", order=["eta"])
    assert (1, -1, 0.4, 1, 0.3) in {tuple(r) for r in ordered.collect()} and ordered.count() == 6 - 1
    with pytest.raises(Exception, match="several rows"):
        joins.outer_join_taggers({"A": a.union(a), "B": b}, "e").collect()


def test_attached_weights_are_unique(spark):
    df, twice = spark.range(3).toDF("k"), spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0), (2, 1.0)], "k long, w double")
    with pytest.raises(Exception, match="listed twice"):
        joins.attach_by_key(df, twice, "k").collect()
    assert joins.attach_by_key(df, twice.where("w < 3"), "k").count() == 3


def test_unknown_names_are_errors(spark):
    df = spark.createDataFrame([(2.0, 5)], "x double, FillNumber int")
    with pytest.raises(ValueError):
        cuts.keep_block(df, "FillNumber", "2-3")
    assert cuts.keep_block(df, "FillNumber", "all").count() == 1
    for text in ("nope > 1", "x; drop", "x > (SELECT 1)", "java_method('a')", "x > 'a'", "reflect(x)", "x.y", "1x"):
        with pytest.raises(ValueError):
            expressions.derive(df, {"out": text})
        with pytest.raises(ValueError):
            cuts.keep_passing(df, text)
    got = expressions.derive(df, {"a": "max(x, 3) / .5 - pow(x, 2)", "b": "!(x == 2) | FillNumber >= 5 & x < 3e0"}).first()
    assert (got.a, got.b) == (2.0, True)


def test_powers_converge_and_leave_the_first_range(spark):
    rows = [(math.exp(3 + 0.02 * math.sin(i * 1.7)) - 1, float(i % 7), 4.0) for i in range(300)]
    df = spark.createDataFrame(rows, "far double, near double, constant double")
    found = preprocessing.fit_powers(df, ["far", "near", "constant"])
    assert found["constant"][0] == 1.0
    for f in ("far", "near"):
        power, best = found[f]
        around = [power - 1e-3, power, power + 1e-3]
        near = preprocessing.log_likelihoods(df, [f], {f: around})[f]
        assert near[1] >= max(near) - 1e-9 and best == pytest.approx(near[1])


def test_many_files_replay_as_one_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.range(60).selectExpr("id % 3 AS k", "timestamp_seconds((60 - id) * 86400) AS ts").repartition(30).write.parquet(source)
    stream = incremental.file_stream(spark, source, "k long, ts timestamp")
    incremental.run_available(incremental.dedupe_events(stream, ["k"], "ts", "100 days"), out, state)
    assert spark.read.parquet(out).count() == 3


@pytest.mark.parametrize("weight", [None, "w"])
def test_windows_left_open_come_from_the_state(spark, tmp_path, weight):
    from tagloom.operators import stats

    rows = spark.range(40).selectExpr("timestamp_seconds(id * 21600) AS ts", "CAST(1 AS INT) AS d", "id / 100.0D AS eta", "521 AS f", "1 + id / 10.0D AS w")
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.write.parquet(source)
    stream = incremental.file_stream(spark, source, rows.schema)
    incremental.run_available(incremental.windowed_performance(stream, "ts", "1 hour", "1 day", "d", "eta", "f", weight), out, state)
    closed = spark.read.parquet(out)
    both = closed.unionByName(incremental.open_windows(spark, state))
    assert closed.count() < 10 == both.count() and both.agg(F.sum("n")).first()[0] == 40
    whole = stats.tagging_performance(rows.withColumn("day", F.date_trunc("day", "ts")), "d", "eta", "f", weight, ["day"]).withColumnsRenamed({"tagging_power": "p", "n_eff": "e"})
    joined = both.join(whole, F.col("window_start") == F.col("day"))
    assert joined.count() == 10 and joined.where("abs(tagging_power - p) > 1e-12 or abs(n_eff - e) > 1e-9").count() == 0


def test_yields_are_at_the_optimum_and_weights_add_up(spark):
    from tagloom.operators import weights

    rows = [(5200.0 + (i * 37 % 2000) / 10.0,) for i in range(800)] + [(5280.0 + math.sin(i) * 12,) for i in range(300)]
    shape = weights.Shape(mean=5280.0)
    df = weights.with_densities(spark.createDataFrame(rows, "m double").where("m > 5200 and m < 5400"), "m", shape)
    ns, nb = weights.fit_yields(df)
    mix = F.col("f_sig") * ns + F.col("f_bkg") * nb
    slopes = df.agg(F.sum(F.col("f_sig") / mix), F.sum(F.col("f_bkg") / mix)).first()
    assert slopes[0] == pytest.approx(1.0, abs=1e-9) and slopes[1] == pytest.approx(1.0, abs=1e-9)
    made = weights.sweights(df, (ns, nb))
    total = F.col("signal_weights") + F.col("background_weights") - 1
    assert made.agg(F.max(F.abs(total))).first()[0] < 1e-9
    assert weights.fit_yields(df.limit(0)) == (0.0, 0.0)
    with pytest.raises(ArithmeticError):
        weights.fit_yields(df, (1.0, 1.0), iterations=2)


def test_calibration_says_what_did_not_converge(spark):
    from tagloom.operators import calibration

    rows = [("a", 1 if i % 3 else -1, 0.1 + (i % 30) / 100.0, 521 if i % 7 < 4 else -521, 1.0) for i in range(300)]
    rows += [("zero", 1, 0.2, 521 if i % 2 else -521, 1.0 if i % 4 < 2 else -1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "tagger string, d int, eta double, f int, w double")
    fit = lambda **k: {(r.tagger, r.converged) for r in calibration.calibrate(df, "tagger", "d", "eta", "f", "w", **k).parameter_table(spark).collect()}
    assert fit() == {("a", True), ("zero", False)} and fit(iterations=2) == {("a", False), ("zero", False)}
    low = spark.createDataFrame([("a", 1, 0.002, 521 if i % 500 else -521, 1.0) for i in range(1000)], df.schema)
    assert calibration.calibrate(low, "tagger", "d", "eta", "f", npar=1).centres["a"] == pytest.approx(math.log(0.002 / 0.998))


def test_polynomial_order_by_prefix_and_generation():
    from tagloom.plans.chains import parameters_of

    assert [parameters_of(t, "logit") for t in ("OSKaon", "OSKaon_new", "OSElectron", "SSPion")] == [4, 4, 2, 2]
    assert [parameters_of(t, "logit", older=True) for t in ("OSKaon", "OSElectronLatest", "OSMuon")] == [4, 3, 2]
    assert parameters_of("OSKaon", "mistag", older=True) == 2


def test_integer_bins_are_bounded(spark):
    from tagloom.operators import hist

    df = spark.createDataFrame([(0, "a"), (2, "a"), (2, "b")], "v int, s string")
    assert hist.histogram_common(df, "v", "s", integer=True).count() == 6
    assert hist.histogram_common(df.limit(0), "v", "s", integer=True).count() == 0
    with pytest.raises(ValueError, match="unit bins"):
        hist.histogram_common(df.unionByName(spark.createDataFrame([(10**9, "a")], "v int, s string")), "v", "s", integer=True)
