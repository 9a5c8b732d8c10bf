"""The end-to-end chains on a small nested sample."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import events, features, networks, weights
from tagloom.plans import chains
from tagloom.sources.tables import flatten

TRACK = ["PX", "PY", "PZ", "P", "PT", "Eta", "Phi", "X", "Y", "Z", "firstZ", "OWNPV_Z", "OWNPVIP", "OWNPVIPCHI2", "PROBNN_K"]
SIGNAL = ["PX", "PY", "PZ", "P", "M", "ENERGY", "ETA", "PHI", "OWNPV_Z", "ENDV_X", "ENDV_Y", "ENDV_Z"]
CUT = "(B_Tr_T_PROBNN_K > 0.4) & (B_Tr_T_Origin_Flag !=0)"
INPUTS = ["B_Tr_T_PROBNN_K", "B_Tr_T_OWNPVIPSig"]


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(11)
    fields = [f"B_Tr_T_{n} double" for n in TRACK] + [f"B_Tr_T_{n} int" for n in ("Charge", "IsInTree", "Origin_Flag", "TRUE_PARTICLE_ID")]
    schema = "entry long, RUNNUMBER long, EVENTNUMBER long, B_TRUEID int, B_ID int, " + ", ".join(f"B_{n} double" for n in SIGNAL)
    schema += f", tracks array<struct<{', '.join(f.replace(' ', ':') for f in fields)}>>"
    data = []
    for e in range(300):
        flavour = int(rng.choice([521, -521, 531]))
        s = [*rng.normal(0, 2000, 2), *rng.uniform(2e4, 6e4, 2), 5279.0, 9e4, rng.uniform(2, 5), rng.uniform(-3, 3), *rng.normal(0, 1, 4)]
        rows = []
        for _ in range(int(rng.integers(1, 8))):
            t = [*rng.normal(0, 500, 2), *rng.uniform(2e3, 2e4, 2), 700.0, rng.uniform(2, 5), rng.uniform(-3, 3), *rng.normal(0, 1, 3), 5.0, 0.1, 0.2, rng.uniform(0, 9), rng.uniform()]
            t = [float(v) for v in t]
            if rng.uniform() < 0.05:
                t[3] = float("nan")
            rows.append((*t, int(rng.choice([1, -1])), int(rng.uniform() < 0.1), int(rng.integers(0, 4)), 321))
        data.append((e, 1, e, flavour, flavour, *[float(v) for v in s], rows))
    return spark.createDataFrame(data, schema)


def test_nested_minimum_equals_flat_minimum(spark, raw):
    nested = chains.track_table(raw, "Bu2JpsiK")
    assert nested.filter("abs(B_TRUEID) <> 521").count() == 0
    flat = events.min_abs_per_event(nested.drop("B_Tr_T_minPhiDistance"), "B_Tr_T_PhiDistance", ["entry"], "m")
    joined = flat.join(nested.select("entry", "subentry", "B_Tr_T_minPhiDistance"), ["entry", "subentry"])
    assert joined.filter(F.abs(F.col("m") - F.col("B_Tr_T_minPhiDistance")) > 1e-12).count() == 0
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert set(features.feature_columns()) <= set(nested.columns)
    assert nested.count() < flatten(raw.filter("abs(B_TRUEID) = 521"), ["tracks"]).count()  # incomplete tracks are gone


@pytest.mark.parametrize("data", [False, True])
def test_tagging_chain(spark, raw, data):
    net = networks.Network.initial(2, [3], seed=1)
    out = chains.tag_events(raw, "Bu2JpsiK", "OSKaon", CUT, net, INPUTS, data=data)
    rows = out.collect()
    assert len({r["entry"] for r in rows}) == len(rows) > 100
    for r in rows:
        assert r["OSKaon_TagDec"] in (-1, 0, 1) and 0 <= r["OSKaon_Eta"] <= 0.5
        assert (r["OSKaon_TagDec"] == 0) == (r["OSKaon_Eta"] == 0.5)


def test_combination_chain(spark):
    rng = np.random.default_rng(3)
    n, tables = 4000, {}
    flavour = rng.choice([521, -521], n)
    for t in ("OSKaon", "OSMuon"):
        eta = rng.uniform(0.1, 0.45, n)
        wrong = rng.uniform(size=n) < eta
        d = np.where(wrong, -np.sign(flavour), np.sign(flavour))
        seen = rng.uniform(size=n) < 0.8
        data = [(f"s_1_{i}", int(d[i]), float(eta[i]), int(flavour[i]), 1.0) for i in range(n) if seen[i]]
        tables[t] = spark.createDataFrame(data, f"key string, {t}_TagDec int, {t}_Eta double, B_ID int, w double")
    made = chains.combine_and_calibrate(tables, "key", "B_ID", "w")
    assert len(made.single.fits[("OSKaon", 1)].values) == 4 and len(made.single.fits[("OSMuon", 1)].values) == 2
    row = made.performance("B_ID").first()
    alone = tables["OSMuon"].selectExpr("key", "OSMuon_TagDec AS d", "OSMuon_Eta AS eta", "B_ID")
    assert row["tag_efficiency"] > 0.85 and row["tagging_power"] > 0.2
    assert row["mistag_rate"] < 0.3 < 0.31 and alone.count() < row["n"]


def test_weighting_and_trend_chain(spark):
    rng = np.random.default_rng(4)
    mass = np.concatenate([rng.normal(5280, 7, 3000), rng.uniform(5200, 5400, 3000)])
    data = [(float(m), 1 if i < 3000 else -1, 0.2, 521, float(rng.uniform(0, 25000)), 9950) for i, m in enumerate(mass)]
    df = spark.createDataFrame(data, "m double, d int, eta double, B_ID int, B_PT double, FillNumber int")
    simulation = spark.createDataFrame([(float(m),) for m in rng.normal(5280, 7, 3000)], "m double")
    made, fit = chains.weight_events(df, "m", simulation, weights.Shape(mean=5279.0), "FillNumber", "2")
    assert fit.yields[0] == pytest.approx(3000, rel=0.08)
    out = chains.trends(made, {"B_PT": [0, 5000, 10000, 25000]}, "d", "eta", "B_ID", "signal_weights").collect()
    assert sorted(r["bin"] for r in out) == [0, 1, 2] and all(abs(r["value"] - 36.0) < 1e-6 for r in out)
    # the signal is always tagged right and the background always wrong: weights undo the background
    wrong = made.agg(F.sum(F.when(F.col("d") < 0, F.col("signal_weights"))).alias("w"), F.sum("signal_weights").alias("s")).first()
    assert abs(wrong["w"] / wrong["s"]) < 0.08


def test_nested_events_shuffle_only_the_lines(spark, tmp_path):
    """Equal to roles made before the grouping; signal roles and the choice of species need no shuffle."""
    from tagloom.plans import bindings as b
    from tagloom.plans import model_queries as q

    rows = [(k if k % 11 else None, 7 * k % 31, k % 9, k % 3, None if k % 17 == 0 else k % 50 + 0.5, 900.0 * k, k % 11 / 100, k % 9 / 100, "NRA"[k % 3], "OF"[k % 2]) for k in range(200)]
    rows += [(e, *r[1:]) for r in rows[:60] for e in (r[0], 5)] + [r[:8] + ("A", "F") for r in rows[:20]] + [r[:8] + ("N", "F") for r in rows[:20]]
    kinds = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/lineitem.parquet")

    df = b.tracks(spark, str(tmp_path), *q.CHAIN_SIGNAL, *[f"B_Tr_T_{n}" for n in q.CHAIN_TRACK])
    whole = ("Charge", "IsInTree", "Origin_Flag", "TRUE_PARTICLE_ID")
    track = F.struct("subentry", "track_part", "track_supp", *[F.col(f"B_Tr_T_{n}").cast("int" if n in whole else "double").alias(f"B_Tr_T_{n}") for n in q.CHAIN_TRACK])
    plain = df.groupBy("entry").agg(*[F.first(c).alias(c) for c in q.CHAIN_SIGNAL], F.sort_array(F.collect_list(track)).alias("tracks"))
    plain = plain.withColumns({"tracks": F.transform("tracks", lambda t: t.dropFields("subentry", "track_part", "track_supp")), "RUNNUMBER": F.lit(1), "EVENTNUMBER": F.col("entry")})
    made = q.nested_events(spark, str(tmp_path))
    assert made.dtypes == plain.dtypes
    key = lambda r: str(r["entry"])
    assert sorted(made.collect(), key=key) == sorted(plain.collect(), key=key)

    plan = made.where("abs(B_TRUEID) = 521")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(plan) if "Aggregate [" in line)
    below = "\n".join(plan[at + 1 :])
    assert not any("Filter" in line for line in plan[:at]) and "Filter" in below and "% 3" in below and "AS B_" not in below.replace("AS B_Tr_T_Charge", "").replace("AS B_Tr_T_IsInTree", "")
