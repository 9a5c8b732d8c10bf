"""Performance identities, calibration optimality, combination, sWeights and mass fit."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import performance as perf
from tagloom.operators import calibration as cal
from tagloom.operators import hist, stats, weights


def sample(spark, n=6000, slope=0.8, shift=0.1, seed=1, tagger="T", signed=False):
    """Rows whose true mistag follows a known logit-linear calibration."""
    rng = np.random.default_rng(seed)
    eta = rng.uniform(0.05, 0.49, n)
    x = np.log(eta / (1 - eta))
    omega = 1 / (1 + np.exp(-(shift + slope * x)))
    flavour = rng.choice([521, -521], n)
    wrong = rng.uniform(size=n) < omega
    d = np.where(wrong, -np.sign(flavour), np.sign(flavour))
    w = np.where(rng.uniform(size=n) < 0.2, -0.5, 1.2) if signed else np.ones(n)
    data = [(i, tagger, int(a), float(e), int(f), float(v)) for i, (a, e, f, v) in enumerate(zip(d, eta, flavour, w))]
    return spark.createDataFrame(data, "event long, tagger string, d int, eta double, B_ID int, w double")


def test_stored_identities(spark):
    """Counts and derived figures of a published combination."""
    n, nt, omega, effective = 135587.0, 118258.0, 0.4982242216171422, 0.49725053307457207
    eff = nt / n
    assert eff == pytest.approx(0.8721927618429496, rel=1e-12)
    assert math.sqrt(eff * (1 - eff) / n) == pytest.approx(0.0009067236391328416, rel=1e-10)
    assert math.sqrt(omega * (1 - omega) / nt) == pytest.approx(0.0014539584653704056, rel=1e-10)
    assert eff * (1 - 2 * effective) ** 2 == pytest.approx(2.637360327391607e-05, rel=1e-10)
    row = spark.range(1).select(
        perf.power_error(F.lit(2.637360327391607e-05), F.lit(eff), F.lit(0.0009067236391328416), F.lit(effective), F.lit(2.6909110406451873e-06)).alias("e")
    ).first()
    assert row["e"] == pytest.approx(5.845300907227486e-08, rel=1e-6)
    plus, minus = [1.2362797610218346, 88.81512751734068], [-1.2535272098682668, -98.67552470969127]
    cov_plus = [[9.825338435191204e-05, 0.0015130750539136379], [0.001513075053913638, 7.277188091913721]]
    cov_minus = [[9.886812097036764e-05, 0.0022035828191647303], [0.0022035828191647303, 7.846864087609796]]
    values, cov = cal.delta_parameters(np.array(plus), np.array(minus), cov_plus, cov_minus)
    assert values == pytest.approx([-0.008623724423216128, -4.930198596175295, 2.4898069708901014, 187.49065222703194], rel=1e-9)
    assert cov[0, 0] == pytest.approx(4.928037633056992e-05) and cov[1, 3] == pytest.approx(-0.28483799784803754)
    # the stored basis is shifted by about the link of the mean mistag
    assert cal._link_value("logit", 0.4973602516117375) == pytest.approx(-0.0105590616836151, rel=1e-5)


def test_performance_by_hand(spark):
    df = spark.createDataFrame([(1, 0.1, 521), (-1, 0.3, 521), (0, 0.5, -521), (1, 0.5, 521)], "d int, eta double, B_ID int")
    row = stats.tagging_performance(df, "d", "eta", "B_ID").first()
    assert (row["n"], row["n_tagged"]) == (4, 2)
    assert row["tag_efficiency"] == 0.5 and row["mistag_rate"] == 0.5
    assert row["tagging_power"] == pytest.approx((0.8**2 + 0.4**2) / 4)
    assert row["effective_mistag"] == pytest.approx(0.5 - 0.5 * math.sqrt(row["tagging_power"] / 0.5))


def test_negative_weights_and_empty_bin(spark):
    df = spark.createDataFrame([(1, 0.1, 521, 2.0, 1.0), (1, 0.2, -521, -0.5, 1.0), (0, 0.5, 521, 1.0, 9.0)], "d int, eta double, B_ID int, w double, x double")
    row = stats.tagging_performance(df, "d", "eta", "B_ID", "w").first()
    assert row["tag_efficiency"] == pytest.approx(1.5 / 2.5) and row["mistag_rate"] == pytest.approx(-0.5 / 1.5)
    out = stats.binned_performance(df, "x", [0, 5, 8, 10], "d", "eta", "B_ID", overall=True).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in out] == [(-1, 3), (0, 2), (2, 1)]
    trend = stats.trend_deviation(stats.binned_performance(df, "x", [0, 5, 10], "d", "eta", "B_ID", overall=True), "tag_efficiency", "tag_efficiency_err")
    assert [r["bin"] for r in trend.orderBy("bin").collect()] == [0, 1]


@pytest.mark.parametrize("signed", [False, True])
def test_logit_fit_recovers_and_satisfies_score_equations(spark, signed):
    df = sample(spark, signed=signed)
    fit = cal.calibrate(df, "tagger", "d", "eta", "B_ID", "w")
    local = df.toPandas()
    for sign in (1, -1):
        group = fit.fits[("T", sign)]
        assert group.converged
        part = local[np.sign(local.B_ID) == sign]
        x = np.log(part.eta / (1 - part.eta)) - fit.centres["T"]
        omega = 1 / (1 + np.exp(-(group.values[0] + group.values[1] * x)))
        wrong = (part.d * sign < 0).astype(float)
        assert abs((part.w * (wrong - omega)).sum()) < 1e-6
        assert abs((part.w * (wrong - omega) * x).sum()) < 1e-6
        assert abs(group.values[1] - 0.8) < 0.25
    slope, offset = group.values[1], cal.offset_parameters(group.values, fit.centres["T"])
    assert offset[1] == pytest.approx(slope - 1)


def test_mistag_link_orders_and_fallback(spark):
    df = sample(spark).unionByName(sample(spark, seed=9, tagger="U"))
    fit = cal.calibrate(df, "tagger", "d", "eta", "B_ID", links={"T": "mistag", "U": "logit"}, npar={"T": 2, "U": 3})
    assert len(fit.fits[("T", 1)].values) == 2 and len(fit.fits[("U", -1)].values) == 3
    assert all(g.converged for g in fit.fits.values())
    styles = fit.parameter_table(spark).groupBy("tagger", "style").count().collect()
    assert {(r["tagger"], r["style"]): r["count"] for r in styles} == {
        ("T", "flavour"): 4, ("T", "delta"): 4, ("U", "flavour"): 6, ("U", "delta"): 6,
    }
    quick = cal.calibrate(df, "tagger", "d", "eta", "B_ID", links="mistag", iterations=1)
    assert set(quick.links.values()) == {"logit"}


def test_mixing_fit_undoes_the_dilution(spark):
    rng = np.random.default_rng(7)
    df = sample(spark, n=20000, seed=3).toPandas()
    chi = rng.uniform(0, 0.3, len(df))
    mixed = rng.uniform(size=len(df)) < chi
    df["B_ID"] = np.where(mixed, -df.B_ID, df.B_ID)
    df["chi"] = chi
    fit = cal.calibrate(spark.createDataFrame(df), "tagger", "d", "eta", "B_ID", mixing=F.col("chi"))
    mean = fit.mean_parameters("T")
    assert mean[1] == pytest.approx(0.8, abs=0.12)


def test_apply_calibration_untags_at_one_half(spark):
    df = spark.createDataFrame([(1, "T", 1, 0.1), (2, "T", -1, 0.45), (3, "T", 0, 0.5), (4, "T", 1, 0.5)], "event long, tagger string, d int, eta double")
    fit = cal.Calibration({"T": "mistag"}, {"T": 0.3})
    fit.fits = {("T", s): cal.GroupFit(np.array([0.3, 1.5]), np.zeros((2, 2)), True) for s in (1, -1)}
    got = [(r["d_cal"], round(r["omega"], 9)) for r in cal.apply_calibration(df, fit, "tagger", "d", "eta").orderBy("event").collect()]
    assert got == [(1, 0.0), (0, 0.5), (0, 0.5), (0, 0.5)]


def test_combination_by_products(spark):
    rng = random.Random(5)
    data = [(e, rng.choice([-1, 0, 1]), rng.uniform(0.01, 0.5)) for e in range(60) for _ in range(rng.randrange(1, 4))]
    df = spark.createDataFrame(data, "event long, d int, eta double")
    got = {r["event"]: (r["d"], r["eta"]) for r in cal.combine_taggers(df, "event", "d", "eta").collect()}
    for event in range(60):
        pb = pa = 1.0
        for e, d, eta in data:
            if e == event:
                pb *= (1 + d) / 2 - d * (1 - eta)
                pa *= (1 - d) / 2 + d * (1 - eta)
        a, b = pa / (pa + pb), pb / (pa + pb)
        assert got[event][1] == pytest.approx(1 - max(a, b), abs=1e-12)
        if abs(a - b) > 1e-12:
            assert got[event][0] == (1 if a > b else -1)


def test_equal_yield_curve(spark):
    out = cal.calibration_curve(sample(spark, n=5000), "d", "eta", "B_ID", bins=10).orderBy("bin").collect()
    assert [r["n"] for r in out] == [500] * 10
    assert all(a["mean_eta"] < b["mean_eta"] for a, b in zip(out, out[1:]))


def test_histogram_edges_and_gaps(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (10.0,), (-0.1,), (10.1,), (float("nan"),), (None,)], "x double")
    got = {r["bin"]: r["n"] for r in hist.histogram(df, "x", 0.0, 10.0, 5).collect()}
    want, _ = np.histogram([0.0, 1.0, 2.5, 10.0], bins=5, range=(0, 10))
    assert [got[i] for i in range(5)] == list(want)


def test_pulls(spark):
    df = spark.createDataFrame([(4, 2.0), (0, 1.0)], "n long, m double")
    assert [r["pull"] for r in hist.pulls(df, "n", "m").collect()] == [1.0, None]


def spectrum(spark, n_sig=4000, n_bkg=6000, seed=2):
    rng = np.random.default_rng(seed)
    mass = np.concatenate([rng.normal(5280, 7, n_sig), rng.uniform(5200, 5400, n_bkg)])
    return spark.createDataFrame([(i, float(m)) for i, m in enumerate(mass)], "id long, mass double")


def test_densities_are_normalised():
    s = weights.Shape(mean=5285.0, fraction=0.7, alpha_l=1.1, n_l=2.5)
    x = np.linspace(s.low, s.high, 40001)
    assert np.trapezoid(weights.signal_density(x, s, weights._Arrays), x) == pytest.approx(1.0, abs=1e-6)
    assert np.trapezoid(weights.background_density(x, s), x) == pytest.approx(1.0, abs=1e-9)
    left = weights._crystal_ball(np.array([5285.0 - 8 * 1.1 - 1e-6, 5285.0 - 8 * 1.1 + 1e-6]), s, weights._Arrays)
    assert left[0] == pytest.approx(left[1], rel=1e-5)  # continuous at the junction


def test_mass_fit_and_sweights(spark):
    df = spectrum(spark)
    start = weights.Shape(mean=5278.0, alpha_l=2.5, alpha_r=2.5, n_l=5.0, n_r=5.0)
    fit = weights.fit_mass(df, "mass", start)
    assert fit.shape.mean == pytest.approx(5280, abs=0.5)
    assert fit.yields[0] == pytest.approx(4000, abs=4 * fit.errors["yield_signal"])
    dens = weights.with_densities(df, "mass", fit.shape)
    found = weights.fit_yields(dens, fit.yields, iterations=300)
    assert sum(found) == pytest.approx(10000, rel=1e-6)
    made = weights.sweights(dens, found)
    row = made.agg(
        F.sum("signal_weights").alias("s"),
        F.max(F.abs(F.col("signal_weights") + F.col("background_weights") - 1)).alias("gap"),
        F.min("signal_weights").alias("low"),
    ).first()
    assert row["s"] == pytest.approx(found[0], rel=1e-4) and row["gap"] < 1e-4 and row["low"] < 0
    assert made.count() == df.count()


def test_error_rounding(spark):
    df = spark.createDataFrame([(0.020163, 0.0002, 0.00012), (0.5, float("inf"), 0.1), (0.5, 0.1, None)], "v double, a double, b double")
    out = stats.combine_errors(df, "v", ["a", "b"]).collect()
    assert out[0]["value_rounded"] == pytest.approx(2.02) and out[0]["error_rounded"] == pytest.approx(0.02)
    assert math.isnan(out[1]["error_scaled"]) and math.isnan(out[2]["value_rounded"])
