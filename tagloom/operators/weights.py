"""Mass model, yields and sWeights.

Shapes start from a fit of a binned spectrum (Spark counts, at most a few hundred bins reach the driver) and are then fitted
to the rows without binning: the derivatives of the likelihood to all parameters are columns, and one aggregation per
step gives the gradient and the information matrix. Yields for fixed shapes are fitted the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.hist import histogram
from tagloom.session import spread


@dataclass(frozen=True)
class Shape:
    """Signal: fraction * double-sided Crystal Ball + rest Gauss, common mean. Background: Chebyshev."""

    low: float = 5200.0
    high: float = 5400.0
    mean: float = 5300.0
    sigma: float = 8.0
    g_sigma: float = 8.0
    fraction: float = 0.5
    alpha_l: float = 1.4
    n_l: float = 2.2
    alpha_r: float = 1.4
    n_r: float = 2.2
    c0: float = 0.1
    c1: float = -0.2
    c2: float = 0.03


class _Arrays:
    exp = staticmethod(np.exp)
    where = staticmethod(np.where)
    power = staticmethod(np.power)
    largest = staticmethod(np.maximum)


class _Columns:
    exp = staticmethod(F.exp)
    power = staticmethod(lambda x, n: F.pow(x, F.lit(float(n))))
    largest = staticmethod(lambda x, y: F.greatest(x, F.lit(float(y))))

    @staticmethod
    def where(condition, yes, no):
        return F.when(condition, yes).otherwise(no)


def _crystal_ball(x, s: Shape, ops):
    """Unnormalised: Gaussian core, power-law tails beyond alpha on either side."""
    t = (x - s.mean) / s.sigma

    def tail(distance, alpha: float, n: float):
        # distance is positive on the tail's side; the base is clamped where the core applies
        base = ops.largest(1.0 + (distance - alpha) * (alpha / n), 1e-12)
        return ops.power(base, -n) * float(np.exp(-0.5 * alpha * alpha))

    core = ops.exp(t * t * -0.5)
    right = ops.where(t > s.alpha_r, tail(t, s.alpha_r, s.n_r), core)
    return ops.where(t < -s.alpha_l, tail(-t, s.alpha_l, s.n_l), right)


def _gauss(x, s: Shape, ops):
    t = (x - s.mean) / s.g_sigma
    return ops.exp(t * t * -0.5)


def _chebyshev(x, s: Shape):
    u = (x - s.low) * (2.0 / (s.high - s.low)) - 1.0
    return 1.0 + u * s.c0 + (u * u * 2.0 - 1.0) * s.c1 + (u * u * u * 4.0 - u * 3.0) * s.c2


def norms(s: Shape, points: int = 4001) -> tuple[float, float, float]:
    """Integrals of the three unnormalised shapes over the window (parameters only, no data)."""
    x = np.linspace(s.low, s.high, points)
    return (
        float(np.trapezoid(_crystal_ball(x, s, _Arrays), x)),
        float(np.trapezoid(_gauss(x, s, _Arrays), x)),
        (s.high - s.low) * (1.0 - s.c1 / 3.0),
    )


def signal_density(x, s: Shape, ops=_Columns, integrals: tuple[float, float, float] | None = None):
    ball, gauss, _ = integrals or norms(s)
    return _crystal_ball(x, s, ops) * (s.fraction / ball) + _gauss(x, s, ops) * ((1.0 - s.fraction) / gauss)


def background_density(x, s: Shape, integrals: tuple[float, float, float] | None = None):
    return _chebyshev(x, s) / (integrals or norms(s))[2]


@dataclass(frozen=True)
class ShapeFit:
    shape: Shape
    yields: tuple[float, float]
    errors: dict[str, float]
    deviance: float
    at_bound: tuple[str, ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        values = {**asdict(self.shape), "yield_signal": self.yields[0], "yield_background": self.yields[1]}
        rows = [(n, float(v), float(self.errors.get(n, 0.0)), n in self.at_bound) for n, v in values.items()]
        return spark.createDataFrame(rows, "name string, value double, error double, at_bound boolean")


# Allowed parameter ranges of the mass model; of a tail's start only the distance counts, so it is positive here.
LIMITS = {
    "mean": (5200.0, 5400.0),
    "sigma": (0.1, 20.0),
    "g_sigma": (0.1, 20.0),
    "fraction": (0.0, 1.0),
    "alpha_l": (0.05, 5.0),
    "alpha_r": (0.05, 5.0),
    "n_l": (0.1, 200.0),
    "n_r": (0.1, 200.0),
    "c0": (-np.inf, np.inf),
    "c1": (-np.inf, np.inf),
    "c2": (-np.inf, np.inf),
}
SHAPE_ONLY = ("mean", "sigma", "g_sigma", "fraction")
TAILS = ("alpha_l", "n_l", "alpha_r", "n_r")
BACKGROUND = ("c0", "c1", "c2")


def fit_spectrum(
    counts: Sequence[float], start: Shape, simulation: bool = False, steps: int = 200
) -> ShapeFit:
    """Extended Poisson fit of a binned spectrum by damped Fisher scoring.

    Simulation: no background, tails float. Data: tails stay at the values of ``start``.
    """
    n = np.asarray(counts, dtype=float)
    free = [*SHAPE_ONLY, *(TAILS if simulation else BACKGROUND)]
    edges = np.linspace(start.low, start.high, len(n) + 1)
    width = edges[1] - edges[0]
    nodes = np.linspace(start.low, start.high, 2 * len(n) + 1)  # bin edges and centres

    def expected(theta: np.ndarray) -> np.ndarray:
        s = replace(start, **dict(zip(free, map(float, theta))))
        integrals = norms(s, 2001)
        density = theta[len(free)] * signal_density(nodes, s, _Arrays, integrals)
        if not simulation:
            density = density + theta[len(free) + 1] * background_density(nodes, s, integrals)
        simpson = density[:-2:2] + 4.0 * density[1:-1:2] + density[2::2]
        return np.maximum(simpson * (width / 6.0), 1e-9)

    def deviance(mu: np.ndarray) -> float:
        return float(2.0 * np.sum(mu - n + np.where(n > 0, n * np.log(np.maximum(n, 1e-300) / mu), 0.0)))

    total = float(n.sum())
    theta = np.array([getattr(start, f) for f in free] + ([total] if simulation else [0.8 * total, 0.2 * total]))
    low = np.array([LIMITS[f][0] for f in free] + [0.0] * (1 if simulation else 2))
    high = np.array([LIMITS[f][1] for f in free] + [total] * (1 if simulation else 2))
    scale = np.maximum(np.abs(theta), 1.0) * 1e-5
    mu, damping = expected(theta), 1e-3
    best = deviance(mu)
    for _ in range(steps):
        slopes = np.column_stack([(expected(theta + e) - mu) / e.sum() for e in np.diag(scale)])
        information = slopes.T @ (slopes / mu[:, None])
        gradient = slopes.T @ ((n - mu) / mu)
        ridge = information + damping * np.diag(np.diag(information) + 1e-12)
        trial = np.clip(theta + np.linalg.solve(ridge, gradient), low, high)
        trial_mu = expected(trial)
        value = deviance(trial_mu)
        if value < best:
            gain, theta, mu, best = best - value, trial, trial_mu, value
            damping = max(damping / 5.0, 1e-12)
            if gain < 1e-9 * max(best, 1.0):
                break
        else:
            damping *= 10.0
            if damping > 1e12:
                break
    slopes = np.column_stack([(expected(theta + e) - mu) / e.sum() for e in np.diag(scale)])  # at the solution
    errors = np.sqrt(np.maximum(np.diag(np.linalg.pinv(slopes.T @ (slopes / mu[:, None]))), 0.0))
    names = [*free, "yield_signal", *([] if simulation else ["yield_background"])]
    shape = replace(start, **dict(zip(free, map(float, theta))))
    yields = (float(theta[len(free)]), 0.0 if simulation else float(theta[len(free) + 1]))
    at_bound = tuple(n for n, x, a, b in zip(names, theta, low, high) if x in (a, b))
    return ShapeFit(shape, yields, dict(zip(names, map(float, errors))), best, at_bound)


def fit_mass(df: DataFrame, mass: str, start: Shape, simulation: bool = False, bins: int = 100) -> ShapeFit:
    """Count the spectrum with Spark, fit the shapes on the counts."""
    counted = histogram(df, mass, start.low, start.high, bins).collect()
    counts = [0.0] * bins
    for row in counted:
        counts[row["bin"]] = float(row["n"])
    return fit_spectrum(counts, start, simulation)


def _mixture(x, shape: Shape, yields: Sequence[float], simulation: bool, ops=_Columns):
    """Expected rows per unit of mass."""
    integrals = norms(shape)
    density = signal_density(x, shape, ops, integrals) * float(yields[0])
    return density if simulation else density + background_density(x, shape, integrals) * float(yields[1])


def _numbers(shape: Shape, yields: Sequence[float], simulation: bool) -> list[float]:
    """The constants of the mixture: a step changes only these, so the compiled code of its aggregation is used again."""
    ball, gauss, flat = norms(shape)
    tails = [(a, n, float(np.exp(-0.5 * a * a)), a / n) for a, n in ((shape.alpha_l, shape.n_l), (shape.alpha_r, shape.n_r))]
    scales = [yields[0] * shape.fraction / ball, yields[0] * (1.0 - shape.fraction) / gauss, 0.0 if simulation else yields[1] / flat]
    return [float(v) for v in (shape.mean, shape.sigma, shape.g_sigma, *tails[0], *tails[1], *scales, shape.low, 2.0 / (shape.high - shape.low), shape.c0, shape.c1, shape.c2)]


def _mixture_column(x: Column, numbers: Column) -> Column:
    """``_mixture`` with its constants taken from an array of ``_numbers``."""
    mean, sigma, g_sigma, a_l, n_l, e_l, r_l, a_r, n_r, e_r, r_r, ball, gauss, flat, low, scale, c0, c1, c2 = (numbers[k] for k in range(19))
    t, g, u = (x - mean) / sigma, (x - mean) / g_sigma, (x - low) * scale - 1.0
    tail = lambda distance, a, n, e, r: F.pow(F.greatest(1.0 + (distance - a) * r, F.lit(1e-12)), -n) * e
    core = F.exp(t * t * -0.5)
    peak = F.when(t < -a_l, tail(-t, a_l, n_l, e_l, r_l)).when(t > a_r, tail(t, a_r, n_r, e_r, r_r)).otherwise(core)
    slope = 1.0 + u * c0 + (u * u * 2.0 - 1.0) * c1 + (u * u * u * 4.0 - u * 3.0) * c2
    return peak * ball + F.exp(g * g * -0.5) * gauss + slope * flat


def _score_sums(slim: DataFrame, names: Sequence[str], theta: np.ndarray, start: Shape, simulation: bool) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, its gradient and its information matrix at ``theta``, in one aggregation of the masses ``_x``."""
    shapes = len(names) - (1 if simulation else 2)

    def mixture(values: np.ndarray) -> Column:
        shape = replace(start, **dict(zip(names[:shapes], map(float, values))))
        return _mixture_column(F.col("_x"), F.lit(np.array(_numbers(shape, values[shapes:], simulation))))

    steps = np.maximum(np.abs(theta), 1e-2) * 1e-5
    steps[0] = 1e-5 * (start.high - start.low)  # the mean moves in the window
    made, widths = {"_m": F.greatest(mixture(theta), F.lit(1e-300))}, []
    for k in range(len(names)):
        up, down = theta.copy(), theta.copy()
        up[k] += steps[k]
        down[k] -= steps[k]
        made[f"_d{k}"] = mixture(up) - mixture(down)
        widths.append(float(up[k] - down[k]))
    rows = slim.select(*[c.alias(n) for n, c in made.items()])
    ratios = rows.select(F.log("_m").alias("_l"), *[(F.col(f"_d{k}") / F.col("_m")).alias(f"_r{k}") for k in range(len(names))])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    sums = ratios.agg(
        F.sum("_l"), *[F.sum(f"_r{k}") for k in range(len(names))], *[F.sum(F.col(f"_r{i}") * F.col(f"_r{j}")) for i, j in pairs]
    ).first()
    width = np.array(widths)
    gradient, matrix = np.array(sums[1 : len(names) + 1], dtype=float) / width, np.zeros((len(names), len(names)))
    for (i, j), value in zip(pairs, sums[len(names) + 1 :]):
        matrix[i, j] = matrix[j, i] = value / (width[i] * width[j])
    gradient[shapes:] -= 1.0
    return float(sums[0]) - float(theta[shapes:].sum()), gradient, matrix


@dataclass(frozen=True)
class UnbinnedFit(ShapeFit):
    """``deviance`` is minus twice the log-likelihood; ``pulls`` are what remains of the gradient, each in units
    of the error that the parameter has while the others are fixed."""

    pulls: tuple[tuple[str, float], ...] = ()


def fit_unbinned(df: DataFrame, mass: str, start: ShapeFit, simulation: bool = False, steps: int = 100, tolerance: float = 1e-7) -> UnbinnedFit:
    """Extended unbinned maximum-likelihood fit of shapes and yields, from a (binned) ``start``.

    Damped Newton steps with the information matrix; a parameter at a bound that the gradient pushes outwards stays there. The fit ends
    when a full step would gain less than ``tolerance`` in log-likelihood, and raises if it does not get there.
    """
    shape = start.shape
    free = [*SHAPE_ONLY, *(TAILS if simulation else BACKGROUND)]
    names = [*free, "yield_signal", *([] if simulation else ["yield_background"])]
    slim = spread(df.select(F.col(mass).cast("double").alias("_x")).filter((F.col("_x") > shape.low) & (F.col("_x") < shape.high))).persist()
    try:
        total = float(slim.count())
        if not total:
            raise ValueError("no rows in the mass window")
        low = np.array([LIMITS[f][0] for f in free] + [0.0] * (len(names) - len(free)))
        high = np.array([LIMITS[f][1] for f in free] + [2.0 * total] * (len(names) - len(free)))
        theta = np.clip(np.array([getattr(shape, f) for f in free] + list(start.yields[: len(names) - len(free)])), low, high)
        best, gradient, matrix = _score_sums(slim, names, theta, shape, simulation)
        damping, done = 1e-6, False
        for _ in range(steps):
            stuck = ((theta <= low) & (gradient < 0)) | ((theta >= high) & (gradient > 0))
            live = np.flatnonzero(~stuck)
            inner = matrix[np.ix_(live, live)]
            step = np.zeros(len(theta))
            step[live] = np.linalg.solve(inner + damping * np.diag(np.diag(inner) + 1e-12), gradient[live])
            trial = np.clip(theta + step, low, high)
            if 0.5 * float(gradient[live] @ np.linalg.pinv(inner) @ gradient[live]) < tolerance:
                done = True
                break
            value, slope, curve = _score_sums(slim, names, trial, shape, simulation)
            if value > best - 1e-12 * abs(best):
                theta, best, gradient, matrix, damping = trial, value, slope, curve, max(damping / 10.0, 1e-12)
            else:
                damping = max(damping * 10.0, 1e-4)
                if damping > 1e12:
                    break
        if not done:
            raise ArithmeticError(f"the unbinned fit did not converge in {steps} steps")
        covariance = np.linalg.pinv(matrix)
        errors = np.sqrt(np.maximum(np.diag(covariance), 0.0))
        at_bound = tuple(n for n, x, a, b in zip(names, theta, low, high) if x in (a, b))
        pulls = tuple((n, 0.0 if n in at_bound else float(g / max(np.sqrt(i), 1e-300))) for n, g, i in zip(names, gradient, np.diag(matrix)))
        fitted = replace(shape, **dict(zip(free, map(float, theta))))
        yields = (float(theta[len(free)]), 0.0 if simulation else float(theta[len(free) + 1]))
        return UnbinnedFit(fitted, yields, dict(zip(names, map(float, errors))), -2.0 * best, at_bound, pulls)
    finally:
        slim.unpersist()


def with_densities(df: DataFrame, mass: str, shape: Shape) -> DataFrame:
    """Add the normalised densities ``f_sig`` and ``f_bkg``."""
    x = F.col(mass).cast("double")
    return df.withColumns({"f_sig": signal_density(x, shape), "f_bkg": background_density(x, shape)})


def fit_yields(
    df: DataFrame, start: tuple[float, float] | None = None, iterations: int = 100, tolerance: float = 1e-10
) -> tuple[float, float]:
    """Unbinned extended yields for fixed densities: Newton's method on the two yields.

    Each step is one map-side combined aggregation; five sums reach the driver. A step that would leave the positive
    range, or more than halve or double a yield, is replaced by one of expectation-maximisation. Ends when no yield moves by more than
    ``tolerance`` of the rows, and raises if it does not get there. Without a positive ``start`` both yields begin at half the rows.
    """
    slim = df.select("f_sig", "f_bkg").persist()
    s, b = F.col("f_sig"), F.col("f_bkg")
    try:
        rows = slim.count()
        if not rows:
            return 0.0, 0.0
        yields = np.array(start if start and min(start) > 0.0 else (rows / 2.0, rows / 2.0), dtype=float)
        for _ in range(iterations):
            mix = s * float(yields[0]) + b * float(yields[1])
            sums = slim.agg(
                F.sum(s / mix).alias("s"), F.sum(b / mix).alias("b"), F.sum(s * s / (mix * mix)).alias("ss"),
                F.sum(s * b / (mix * mix)).alias("sb"), F.sum(b * b / (mix * mix)).alias("bb"),
            ).first()
            slope = np.array([sums["s"], sums["b"]])
            curve = np.array([[sums["ss"], sums["sb"]], [sums["sb"], sums["bb"]]])
            moved = yields * slope
            if np.linalg.det(curve) > 0:
                trial = yields + np.linalg.solve(curve, slope - 1.0)
                if (trial > 0.5 * yields).all() and (trial < 2.0 * yields).all():
                    moved = trial
            change, yields = np.abs(moved - yields).max(), moved
            if change <= tolerance * rows:
                return float(yields[0]), float(yields[1])
        raise ArithmeticError(f"yields still move by {change:g} after {iterations} steps")
    finally:
        slim.unpersist()


def sweights(df: DataFrame, yields: tuple[float, float], out: tuple[str, str] = ("signal_weights", "background_weights")) -> DataFrame:
    """Per-row sWeights from the densities and yields.

    At the maximum-likelihood yields both weights add up to one on every row and the signal weights
    sum to the signal yield.

    Inverse covariance V^-1_ij = sum f_i f_j / (sum_k N_k f_k)^2 is one aggregation, used as a scalar
    subquery; w_i = sum_j V_ij f_j / sum_k N_k f_k.
    """
    ns, nb = map(float, yields)
    s, b = F.col("f_sig"), F.col("f_bkg")
    mix = s * ns + b * nb
    inverse = df.agg(
        F.struct(
            F.sum(s * s / (mix * mix)).alias("ss"),
            F.sum(s * b / (mix * mix)).alias("sb"),
            F.sum(b * b / (mix * mix)).alias("bb"),
        ).alias("v")
    ).scalar()
    with_matrix = df.withColumn("_v", inverse)

    def element(name: str) -> Column:
        return F.col(f"_v.{name}")

    determinant = element("ss") * element("bb") - element("sb") * element("sb")
    signal = (element("bb") * s - element("sb") * b) / (determinant * mix)
    background = (element("ss") * b - element("sb") * s) / (determinant * mix)
    return with_matrix.withColumns({out[0]: signal, out[1]: background}).drop("_v")
