"""Feature scaling and power transforms fitted by aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.functions.transforms import standardise, yeo_johnson, yeo_johnson_log
from tagloom.session import spread


MOST_ROUNDS = 60
#: From this grid step on the next range is centred on the parabola through the best point and its neighbours, and so much smaller.
STEEP, CLOSER = 0.1, 20.0


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population standard deviation) per feature; a constant feature gets scale 1."""
    stats = [F.avg(f).alias(f"m_{i}") for i, f in enumerate(features)]
    stats += [F.stddev_pop(f).alias(f"s_{i}") for i, f in enumerate(features)]
    row = df.agg(*stats).first()
    return {f: (float(row[f"m_{i}"]), float(row[f"s_{i}"]) or 1.0) for i, f in enumerate(features)}


def apply_scaler(df: DataFrame, scaler: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: standardise(F.col(f), m, s) for f, (m, s) in scaler.items()})


def apply_power(df: DataFrame, powers: Mapping[str, float]) -> DataFrame:
    return df.withColumns({f: yeo_johnson(F.col(f).cast("double"), p) for f, p in powers.items()})


#: Features whose candidates are folded in one aggregation; more of them would make its code too large.
TOGETHER = 4


def log_likelihoods(df: DataFrame, features: Sequence[str], grids: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """Profile log-likelihood of every candidate power of every feature.

    llf = -n/2 log(var(transformed)) + (power - 1) sum sign(x) log(1 + |x|); the variance comes from
    the built-in merging moments, so wide value ranges stay stable. Every candidate is an aggregate of its own over the same
    scan; its power comes from a literal array, so each round runs the code compiled for the first.
    """
    out: dict[str, list[float]] = {}
    for start in range(0, len(features), TOGETHER):
        some = list(features[start : start + TOGETHER])
        parts = {}
        for i, f in enumerate(some):
            parts[f"s_{i}"], parts[f"v_{i}"] = F.signum(f), F.log1p(F.abs(F.col(f)))
        rows = df.select(*[c.alias(n) for n, c in parts.items()])
        sums = []
        for i, f in enumerate(some):
            powers, sign, size = F.lit(np.array(grids[f], dtype=float)), F.col(f"s_{i}"), F.col(f"v_{i}")
            sums += [F.count(size).alias(f"n_{i}"), F.sum(sign * size).alias(f"j_{i}")]
            sums += [F.var_pop(yeo_johnson_log(sign, size, powers[k])).alias(f"x_{i}_{k}") for k in range(len(grids[f]))]
        row = rows.agg(*sums).first()
        for i, f in enumerate(some):
            variances = np.array([row[f"x_{i}_{k}"] for k in range(len(grids[f]))], dtype=float)
            out[f] = (-0.5 * row[f"n_{i}"] * np.log(variances) + (np.array(grids[f]) - 1.0) * row[f"j_{i}"]).tolist()
    return out


def fit_powers(
    df: DataFrame, features: Sequence[str], low: float = -2.0, high: float = 4.0, points: int = 13, tolerance: float = 1e-6
) -> dict[str, tuple[float, float]]:
    """(power, log-likelihood) per feature by repeated grid refinement around the best point.

    A feature is done when its grid step is below ``tolerance``; near the optimum the likelihood is a parabola, whose top the next
    range is laid around. A best point on the edge of the grid moves the range outwards first. All features share one pass per round, so the number of scans does not grow with their
    number; a feature that is done takes part no more. A feature without spread has no optimum and gets the power 1.
    """
    spans = {f: (low, high) for f in features}
    best: dict[str, tuple[float, float]] = {}
    slim = spread(df.select(*[F.col(f).cast("double").alias(f) for f in features])).persist()
    try:
        for f, same in slim.agg(*[F.coalesce(F.min(f) == F.max(f), F.lit(True)).alias(f) for f in features]).first().asDict().items():
            if same:
                best[f] = (1.0, float("nan"))
                del spans[f]
        for _ in range(MOST_ROUNDS):
            if not spans:
                return best
            grids = {f: [round(a + (b - a) * k / (points - 1), 12) for k in range(points)] for f, (a, b) in spans.items()}
            found = log_likelihoods(slim, list(spans), grids)
            for f, (a, b) in list(spans.items()):
                k = max(range(points), key=lambda j: found[f][j])
                best[f] = (grids[f][k], found[f][k])
                step = (b - a) / (points - 1)
                if k in (0, points - 1):  # the optimum may lie outside
                    spans[f] = (grids[f][k] - (b - a) / 2, grids[f][k] + (b - a) / 2)
                elif step < tolerance:
                    del spans[f]
                else:
                    below, here, above = found[f][k - 1 : k + 2]
                    bend = below - 2.0 * here + above
                    near = 0.5 * step * (below - above) / bend if step <= STEEP and bend < 0 else 0.0
                    reach = step / CLOSER if step <= STEEP and bend < 0 else step
                    spans[f] = (grids[f][k] + near - reach, grids[f][k] + near + reach)
        raise ArithmeticError(f"no optimal power found for {sorted(spans)}")
    finally:
        slim.unpersist()
    return best
