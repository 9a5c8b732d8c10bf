"""Networks, trees, preprocessing, sources and streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import models, networks, preprocessing
from tagloom.sources import results, stages, tables
from tagloom.streaming import incremental


def frame(spark, n=1500, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 > 0.3).astype(int)
    data = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, y int")


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(1)
    net = networks.Network.initial(3, [4, 3], seed=2)
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    _, g = networks.gradient(net.layers, x, y)
    theta = net.flat()
    for i in range(0, theta.size, 5):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        up = networks.gradient(net.with_flat(theta + step).layers, x, y)[0]
        down = networks.gradient(net.with_flat(theta - step).layers, x, y)[0]
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_scores_agree_between_udf_and_columns(spark):
    df, net = frame(spark, 200), networks.Network.initial(3, [4, 4], seed=3)
    both = networks.score_columns(networks.score(df, ["a", "b", "c"], net, "p"), ["a", "b", "c"], net, "q")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12
    vector = df.select(F.array("a", "b", "c").alias("v"), "id")
    scored = networks.score_vector(vector, "v", net, "r").join(both, "id")
    assert scored.agg(F.max(F.abs(F.col("p") - F.col("r")))).first()[0] < 1e-12


def test_training_lowers_the_loss_and_stops_early(spark):
    df = frame(spark).withColumn("held", (F.col("id") % 4 == 0).cast("int")).repartition(20)
    run = networks.train(df, ["a", "b", "c"], "y", "held", hidden=(8,), learning_rate=0.05, epochs=12)
    assert run.losses[-1][1] < 0.8 * run.losses[0][1]
    short = networks.train(df, ["a", "b", "c"], "y", "held", hidden=(4,), learning_rate=0.0, epochs=10, patience=2)
    assert len(short.losses) == 3  # the first epoch is the best, then two without gain
    whole = df.toPandas()
    part = whole[whole.held == 0]
    net = networks.Network.initial(3, [4], seed=6)
    loss, _ = networks.gradient(net.layers, part[["a", "b", "c"]].to_numpy(), part.y.to_numpy(float))
    assert short.losses[0][1] == pytest.approx(loss / len(part))


def test_tree_cuts_reproduce_the_tree(spark):
    df = frame(spark).withColumn("B_Tr_T_Origin_Flag", F.lit(1)).withColumn("code", F.col("y").cast("double"))
    model = models.train_tree(df, ["a", "b", "c"], "code", depth=4, min_gain=0.0)
    texts = models.cut_texts(models.tree_paths(model, df, ["a", "b", "c"], ["bg", "sig"]))
    scored = model.transform(models.assemble(models.apply_cut_texts(df, texts), ["a", "b", "c"]))
    wrong = scored.filter(F.col("cut_class") != models.class_names(["bg", "sig"], F.col("prediction"))).count()
    assert wrong <= 3  # thresholds are written with four decimals
    assert all(line.endswith("(B_Tr_T_Origin_Flag !=0)") for t in texts.values() for line in t.split("\nOR\n"))


def test_class_weights_balance(spark):
    sums = models.class_weights(frame(spark), "y").groupBy("y").agg(F.sum("class_weight").alias("s")).collect()
    assert sums[0]["s"] == pytest.approx(sums[1]["s"]) and sum(r["s"] for r in sums) == pytest.approx(1500)


def test_two_fold_uses_the_other_parity_and_the_gate(spark):
    df = frame(spark)
    fitted = models.two_fold_models(df, ["a", "b", "c"], "y", "id", trees=2, depth=2)
    out = models.two_fold_score(df, fitted, ["a", "b", "c"], "id", F.col("c") > 0)
    assert out.count() == 1500
    gated = out.filter("c <= 0").select("score").distinct().collect()
    assert [r["score"] for r in gated] == [-2.0]
    direct = models.predict(fitted[1], df, ["a", "b", "c"]).filter("id % 2 = 1 AND c > 0").select("id", F.col("score").alias("s"))
    joined = out.join(direct, "id")
    assert joined.filter("abs(score - s) > 1e-12").count() == 0 and joined.count() > 0


def test_scaler_and_powers(spark):
    df = frame(spark, 800).withColumn("k", F.lit(3.0)).withColumn("e", F.exp("a"))
    scaler = preprocessing.fit_scaler(df, ["a", "k"])
    assert scaler["k"] == (3.0, 1.0)
    found = preprocessing.fit_powers(df, ["e", "b"])
    x = df.select("e").toPandas().e.to_numpy()

    def llf(p):
        t = np.log1p(x) if p == 0 else ((x + 1) ** p - 1) / p
        return -0.5 * len(x) * np.log(t.var()) + (p - 1) * np.log1p(x).sum()

    best = max(np.linspace(-3, 1, 4001), key=llf)
    assert found["e"][0] == pytest.approx(best, abs=0.02) and found["e"][1] == pytest.approx(llf(found["e"][0]))


def test_flatten_shapes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3, 4]), (2, [], []), (3, [5.0], [6])], "e int, x array<double>, q array<int>")
    assert [tuple(r) for r in tables.flatten(df, ["x", "q"]).collect()] == [(1, 0, 1.0, 3), (1, 1, 2.0, 4), (3, 0, 5.0, 6)]
    nested = df.select("e", F.arrays_zip("x", "q").alias("t"))
    assert tables.flatten(nested, ["t"]).columns == ["e", "subentry", "x", "q"]


def test_stage_tables_are_restartable(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    root = str(tmp_path / "s")
    for _ in range(2):
        stages.write_stage(df, root, {"decay": "x", "tagger": "a"})
    stages.write_stage(df.limit(3), root, {"decay": "x", "tagger": "b"})
    assert stages.read_stage(spark, root, tagger="a").count() == 10 and stages.read_stage(spark, root).count() == 13
    for _ in range(2):
        stages.append_in_chunks(df, "k", 3, str(tmp_path / "c"), "first")
    back = stages.read_batches(spark, str(tmp_path / "c"), "k long")
    assert back.count() == 10 and back.select("chunk").distinct().count() == 3
    calls = []

    def build():
        calls.append(1)
        return df.withColumn("subset", F.lit("train"))

    for overwrite in (False, False, True):
        assert stages.cached_sets(spark, str(tmp_path / "p"), build, overwrite=overwrite).count() == 10
    assert len(calls) == 2


def test_results_from_nested_json_and_path(spark, tmp_path):
    good = {"calibrated": {"selected": {"tagging_power": [0.02, 0.001, 0.002], "tag_efficiency": [0.5, 0.01]}}}
    for seed, body in ((45, good), (46, {"calibrated": {"selected": {}}})):
        folder = tmp_path / str(seed) / "lr0.001_bs4096_nL3_nN256" / "asym_level1" / "calibration_npar3" / "mistag"
        folder.mkdir(parents=True)
        (folder / "taggingInfo_mistag.json").write_text(json.dumps(body, indent=2))
    out = results.selected_figures(results.scan_results(spark, str(tmp_path), results.CALIBRATION_SCHEMA)).orderBy("seed").collect()
    assert [(r["seed"], r["learning_rate"], r["batch_size"], r["numlayers"], r["numneurons"], r["npar"], r["function"]) for r in out] == [
        (45, 0.001, 4096, 3, 256, 3, "mistag"), (46, 0.001, 4096, 3, 256, 3, "mistag"),
    ]
    assert out[0]["tagging_power_err"] == pytest.approx((0.001**2 + 0.002**2) ** 0.5) and out[1]["tagging_power"] is None


def test_stream_appends_only_new_files(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for batch in range(2):
        spark.range(batch * 5, batch * 5 + 5).write.mode("append").parquet(source)
        stream = incremental.file_stream(spark, source, "id long")
        derived = incremental.incremental_features(stream, lambda d: d.withColumn("twice", F.col("id") * 2))
        incremental.run_available(derived, out, state)
    got = sorted((r["id"], r["twice"]) for r in spark.read.parquet(out).collect())
    assert got == [(i, 2 * i) for i in range(10)]


def test_scoring_functions_travel_without_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    file = tmp_path / "f.bin"
    file.write_bytes(cloudpickle.dumps(networks.forward))
    code = (
        "import pickle, numpy as np; f = pickle.load(open('f.bin', 'rb'));"
        "print(f([(np.ones((1, 2)), np.zeros(1))], np.zeros((1, 2)))[0])"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.strip() == "0.5", out.stderr
