"""Fits of many groups against single fits, and propagated errors against finite differences."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.operators import calibration, stats
from tagloom.operators import group_calibration as gc


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        eta, b = float(rng.uniform(0.1, 0.499)), int(rng.choice([521, -521]))
        d = 0 if rng.random() < 0.2 else (1 if rng.random() > 0.1 + 0.8 * eta else -1) * (1 if b > 0 else -1)
        rows.append((i, d, eta, b, ["x", "y", None][i % 3], int(i % 4), float(rng.normal(1, 0.4))))
    return spark.createDataFrame(rows, "id long, d int, eta double, B_ID int, tag string, bin int, w double").cache()


@pytest.mark.parametrize("link, npar, weight", [("logit", 2, "w"), ("logit", 3, None), ("mistag", 2, None)])
def test_every_group_equals_its_single_fit(spark, sample, link, npar, weight):
    found = gc.calibrate_groups(sample, ["tag", "bin"], "d", "eta", "B_ID", weight, link, npar, tolerance=1e-9)
    assert found.keys.num_rows == 12 and found.converged.all()
    for i, key in enumerate(found.keys.to_pylist()):
        part = sample.where(F.col("tag").eqNullSafe(F.lit(key["tag"])) & (F.col("bin") == key["bin"])).withColumn("t", F.lit("one"))
        single = calibration.calibrate(part, "t", "d", "eta", "B_ID", weight, link, npar, tolerance=1e-9, fallback=False)
        assert found.centres[i] == pytest.approx(single.centres["one"], rel=1e-9)
        for s, sign in enumerate((1, -1)):
            assert np.allclose(found.values[i, s], single.fits[("one", sign)].values, rtol=1e-6, atol=1e-8)
            assert np.allclose(found.covariance[i, s], single.fits[("one", sign)].covariance, rtol=1e-5)
        if i < 2:
            a = gc.apply_groups(part, found, ["tag", "bin"], "d", "eta").select("id", "d_cal", "omega")
            b = calibration.apply_calibration(part, single, "t", "d", "eta").select("id", F.col("d_cal").alias("d2"), F.col("omega").alias("o2"))
            assert a.join(b, "id").where("d_cal <> d2 or abs(omega - o2) > 1e-7").count() == 0
    assert gc.apply_groups(sample, found, ["tag", "bin"], "d", "eta").count() == 6000


def test_errors_from_the_calibration_equal_finite_differences(spark, sample):
    fit = gc.calibrate_groups(sample, ["tag"], "d", "eta", "B_ID")
    row = gc.calibrated_performance(sample, fit, ["tag"], "d", "eta", "B_ID").where("tag = 'x'").first()
    i = fit.keys["tag"].to_pylist().index("x")
    keep = gc.apply_groups(sample, fit, ["tag"], "d", "eta").where("omega < 0.45 or omega = 0.5").drop("d_cal", "omega")  # no row crosses one half
    inner = gc.calibrated_performance(keep, fit, ["tag"], "d", "eta", "B_ID").where("tag = 'x'").first()

    def figures(values):
        shifted = replace(fit, values=values)
        made = gc.apply_groups(keep.where("tag = 'x'"), shifted, ["tag"], "d", "eta")
        r = stats.tagging_performance(made, "d_cal", "omega", "B_ID").first()
        return np.array([r["tagging_power"], r["effective_mistag"]])

    slopes = []
    for k in range(2):
        up, down = fit.values.copy(), fit.values.copy()
        up[i, :, k] += 1e-5
        down[i, :, k] -= 1e-5
        slopes.append((figures(up) - figures(down)) / 2e-5)
    slopes = np.array(slopes)
    wanted = np.sqrt(np.einsum("ki,kl,li->i", slopes, fit.mean_covariance()[i], slopes))
    assert np.allclose([inner["tagging_power_cal_err"], inner["effective_mistag_cal_err"]], wanted, rtol=1e-4)
    assert row["tagging_power_cal_err"] > 0 and row["n"] == 2000


def test_groups_without_a_fit_and_no_rows(spark, sample):
    more = sample.unionByName(sample.limit(1).withColumns({"tag": F.lit("few"), "d": F.lit(1), "eta": F.lit(0.2)}))
    found = gc.calibrate_groups(more, ["tag"], "d", "eta", "B_ID", least=50)
    at = found.keys["tag"].to_pylist().index("few")
    assert np.isnan(found.values[at]).all() and not found.converged[at].any()
    made = gc.apply_groups(more, found, ["tag"], "d", "eta").where("tag = 'few'").first()
    assert (made["d_cal"], made["omega"]) == (0, 0.5)
    none = gc.calibrate_groups(sample.limit(0), ["tag"], "d", "eta", "B_ID")
    assert none.keys.num_rows == 0 and none.table(sample).count() == 0
    whole = gc.calibrate_groups(sample, [], "d", "eta", "B_ID")
    assert whole.values.shape == (1, 2, 2) and gc.calibrated_performance(sample, whole, [], "d", "eta", "B_ID").count() == 1


def test_too_many_groups_is_an_error(spark, sample, monkeypatch):
    monkeypatch.setattr(gc, "MOST_GROUPS", 3)
    with pytest.raises(ValueError):
        gc.calibrate_groups(sample, ["tag", "bin"], "d", "eta", "B_ID")
