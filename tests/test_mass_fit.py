"""The unbinned mass fit against a likelihood written in NumPy."""

from dataclasses import replace

import numpy as np
import pytest

from tagloom.operators import weights
from tagloom.operators.weights import Shape, ShapeFit

TRUE = Shape(mean=5281.0, sigma=7.0, g_sigma=12.0, fraction=0.7, c0=-0.3, c1=0.05, c2=0.0)


def drawn(rng, n_signal, n_background):
    x = np.linspace(TRUE.low, TRUE.high, 20_001)
    out = []
    for n, density in ((n_signal, weights.signal_density(x, TRUE, weights._Arrays)), (n_background, weights.background_density(x, TRUE))):
        total = np.cumsum(density)
        out.append(np.interp(rng.random(n), total / total[-1], x))
    return np.concatenate(out)


def log_likelihood(x, names, values, simulation):
    shapes = [n for n in names if not n.startswith("yield")]
    shape, yields = replace(TRUE, **dict(zip(shapes, values))), values[len(shapes) :]
    return np.log(weights._mixture(x, shape, yields, simulation, weights._Arrays)).sum() - sum(yields)


@pytest.mark.parametrize("simulation", [False, True])
def test_gradient_vanishes_and_truth_is_found(spark, simulation):
    x = drawn(np.random.default_rng(4), 6000, 0 if simulation else 4000)
    df = spark.createDataFrame([(float(v),) for v in x] + [(5100.0,), (None,), (float("nan"),)], "m double").repartition(5)
    start = weights.fit_mass(df, "m", replace(TRUE, mean=5279.0), simulation)
    found = weights.fit_unbinned(df, "m", start, simulation)
    names = [n for n, _ in found.pulls]
    value = lambda f: np.array([f.yields[("yield_signal", "yield_background").index(n)] if n.startswith("yield") else getattr(f.shape, n) for n in names])
    theta, errors = value(found), np.array([found.errors[n] for n in names])
    best = log_likelihood(x, names, theta, simulation)
    assert best >= log_likelihood(x, names, value(start), simulation) and found.deviance == pytest.approx(-2 * best, rel=1e-9)
    for k, name in enumerate(names):
        if name not in found.at_bound and errors[k] > 0:
            h = errors[k] * 1e-3
            up, down = theta.copy(), theta.copy()
            up[k], down[k] = theta[k] + h, theta[k] - h
            slope = (log_likelihood(x, names, up, simulation) - log_likelihood(x, names, down, simulation)) / (2 * h)
            assert abs(slope * errors[k]) < 0.01, name
    assert sum(found.yields) == pytest.approx(len(x), rel=1e-4)
    assert abs(found.shape.mean - TRUE.mean) < 5 * found.errors["mean"] and abs(found.yields[0] - 6000) < 5 * found.errors["yield_signal"]


def test_the_mixture_s_column_is_its_formula(spark):
    from pyspark.sql import functions as F

    x = np.linspace(5200.0, 5400.0, 101)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for simulation in (False, True):
        numbers = weights._numbers(TRUE, (300.0, 200.0), simulation)
        got = [r[0] for r in df.orderBy("x").select(weights._mixture_column(F.col("x"), F.lit(np.array(numbers)))).collect()]
        assert np.allclose(got, weights._mixture(x, TRUE, (300.0, 200.0), simulation, weights._Arrays), rtol=1e-12)


def test_a_bound_holds_and_no_rows_is_an_error(spark):
    x = drawn(np.random.default_rng(5), 300, 0)
    df = spark.createDataFrame([(float(v),) for v in x], "m double")
    found = weights.fit_unbinned(df, "m", ShapeFit(replace(TRUE, fraction=1.0), (300.0, 10.0), {}, 0.0))
    assert all(weights.LIMITS[n][0] <= getattr(found.shape, n) <= weights.LIMITS[n][1] for n in weights.SHAPE_ONLY) and found.yields[1] >= 0
    with pytest.raises(ValueError):
        weights.fit_unbinned(df.limit(0), "m", ShapeFit(TRUE, (1.0, 1.0), {}, 0.0))
