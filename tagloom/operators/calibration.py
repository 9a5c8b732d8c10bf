"""Mistag calibration: weighted polynomial fits in a link space, for all taggers at once.

Model, per tagger and production flavour: link(omega) = sum_k p_k (link(eta) - c)^k with
c = link(weighted mean eta), so p = (c, 1, 0, ...) is "already calibrated". The fit is Fisher scoring from a flat
curve. A step needs, per group, only power sums of the centred link value, i.e. one combinable aggregation
over the rows; the driver sees (taggers x 2) rows of at most 3 * npar sums and solves npar x npar
systems. Weights enter as plain sums and may be negative.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.transforms import inverse_link, link
from tagloom.operators.ranking import running_sums, value_edges
from tagloom.session import local_table

MARGIN = 1e-9  # keeps probabilities inside the open unit interval
FLAVOURS = (1, -1)


@dataclass
class GroupFit:
    """Parameters of one tagger and flavour."""

    values: np.ndarray
    covariance: np.ndarray
    converged: bool = False
    loss: float = float("inf")
    previous: np.ndarray | None = None


@dataclass
class Calibration:
    """Fitted parameters by tagger and flavour sign, with link and centre per tagger."""

    links: dict[str, str]
    centres: dict[str, float]
    fits: dict[tuple[str, int], GroupFit] = field(default_factory=dict)

    def delta_style(self, tagger: str) -> tuple[np.ndarray, np.ndarray]:
        """(p, Dp) with p the flavour mean and Dp the flavour difference, and their covariance."""
        plus, minus = self.fits[(tagger, 1)], self.fits[(tagger, -1)]
        return delta_parameters(plus.values, minus.values, plus.covariance, minus.covariance)

    def mean_parameters(self, tagger: str) -> np.ndarray:
        found = [self.fits[(tagger, s)].values for s in FLAVOURS if (tagger, s) in self.fits]
        return np.mean(found, axis=0)

    def parameter_table(self, spark: SparkSession) -> DataFrame:
        """Rows (tagger, style, name, value, error, converged): flavour and delta parameters.

        A group that ran out of steps, or whose weights do not add up to more than zero, is not converged; the
        latter has no values.
        """
        rows = []
        for (tagger, sign), fit in sorted(self.fits.items()):
            errors = np.sqrt(np.maximum(np.diag(fit.covariance), 0.0))
            for k, (value, error) in enumerate(zip(fit.values, errors)):
                rows.append((tagger, "flavour", f"p{k}{'+' if sign > 0 else '-'}", float(value), float(error), fit.converged))
        for tagger in sorted(self.links):
            if all((tagger, s) in self.fits for s in FLAVOURS):
                values, covariance = self.delta_style(tagger)
                errors = np.sqrt(np.maximum(np.diag(covariance), 0.0))
                half = len(values) // 2
                for k, (value, error) in enumerate(zip(values, errors)):
                    name = f"p{k}" if k < half else f"Dp{k - half}"
                    rows.append((tagger, "delta", name, float(value), float(error), all(self.fits[(tagger, s)].converged for s in FLAVOURS)))
        return spark.createDataFrame(rows, "tagger string, style string, name string, value double, error double, converged boolean")


def delta_parameters(plus, minus, cov_plus, cov_minus) -> tuple[np.ndarray, np.ndarray]:
    n = len(plus)
    eye = np.eye(n)
    turn = np.block([[eye / 2, eye / 2], [eye, -eye]])
    zero = np.zeros((n, n))
    joint = np.block([[np.asarray(cov_plus), zero], [zero, np.asarray(cov_minus)]])
    return turn @ np.concatenate([plus, minus]), turn @ joint @ turn.T


def offset_parameters(values: np.ndarray, centre: float) -> np.ndarray:
    """The same polynomial written as link(eta) + sum_k q_k (link(eta) - c)^k."""
    shifted = np.array(values, dtype=float)
    shifted[0] -= centre
    if len(shifted) > 1:
        shifted[1] -= 1.0
    return shifted


def clipped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0 - MARGIN)), F.lit(MARGIN))


def link_of(mistag: Column, name: str) -> Column:
    """Link value of a mistag kept inside the open unit interval."""
    return link(name, clipped(mistag))


def polynomial(x: Column, coefficients: list[Column]) -> Column:
    """Horner form."""
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = out * x + c
    return out


def fit_rows(
    df: DataFrame, tagger: str, decision: str, mistag: str, flavour: str, weight: str | None, mixing: Column | None
) -> DataFrame:
    """The columns the fit needs, of tagged rows only; the logarithm is taken once, not per step."""
    d, eta = F.col(decision), F.col(mistag)
    return df.filter((d != 0) & (eta < 0.5)).select(
        F.col(tagger).alias("tagger"),
        F.signum(F.col(flavour)).cast("int").alias("sign"),
        (d * F.signum(F.col(flavour)) < 0).cast("double").alias("wrong"),
        clipped(eta).alias("eta"),
        link_of(eta, "logit").alias("log_odds"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
        (mixing if mixing is not None else F.lit(0.0)).alias("chi"),
    )


def calibrate(
    df: DataFrame,
    tagger: str,
    decision: str,
    mistag: str,
    flavour: str,
    weight: str | None = None,
    links: str | Mapping[str, str] = "logit",
    npar: int | Mapping[str, int] = 2,
    iterations: int = 100,
    tolerance: float = 1e-10,
    mixing: Column | None = None,
    fallback: bool = True,
) -> Calibration:
    """Fit all (tagger, flavour) groups together.

    ``mixing`` is the per-row probability that a neutral meson decayed with flipped flavour; the
    observed disagreement then has probability omega (1 - chi) + (1 - omega) chi. A tagger whose
    mistag-link fit fails is refitted with the logit link when ``fallback`` is set.
    """
    rows = fit_rows(df, tagger, decision, mistag, flavour, weight, mixing)
    means = _group_means(rows)
    names = sorted({tagger for tagger, _ in means})
    link_by = {n: links if isinstance(links, str) else links[n] for n in names}
    npar_by = {n: npar if isinstance(npar, int) else npar[n] for n in names}
    fit = Calibration(link_by, {})
    if not means:
        return fit
    numbers = {group: k for k, group in enumerate(sorted(means))}
    keys = pa.table({"tagger": [t for t, _ in numbers], "sign": pa.array([s for _, s in numbers], pa.int32()), "_k": pa.array(range(len(numbers)), pa.int32())})
    rows = rows.join(local_table(rows.sparkSession, keys), ["tagger", "sign"]).drop("tagger", "sign").persist()
    try:
        _newton(rows, fit, means, numbers, npar_by, names, iterations, tolerance)
        failed = sorted({t for (t, _), g in fit.fits.items() if not g.converged and link_by[t] == "mistag"})
        if fallback and failed:
            fit.links.update(dict.fromkeys(failed, "logit"))
            _newton(rows, fit, means, numbers, npar_by, failed, iterations, tolerance)
        return fit
    finally:
        rows.unpersist()


def _link_value(name: str, x: float, margin: float = MARGIN) -> float:
    x = min(max(x, margin), 1.0 - margin)
    return float(np.log(x / (1.0 - x))) if name == "logit" else float(x)


def _group_means(rows: DataFrame) -> dict[tuple[str, int], dict[str, float]]:
    """Weight, weighted mistag and weighted wrong sums per tagger and flavour."""
    w = F.col("w")
    added = rows.groupBy("tagger", "sign").agg(
        F.sum(w).alias("w"), F.sum(w * F.col("eta")).alias("eta"), F.sum(w * F.col("wrong")).alias("wrong")
    )
    return {(r["tagger"], r["sign"]): r.asDict() for r in added.collect()}


def _newton(
    rows: DataFrame, fit: Calibration, means: dict, numbers: dict, npar: dict[str, int], names: list[str], iterations: int, tolerance: float
) -> None:
    """Fisher scoring from the flat curve, with the step halved whenever the loss went up."""
    width = max(npar[n] for n in names)
    active = set()
    for name in names:
        groups = {sign: means[(name, sign)] for sign in FLAVOURS if (name, sign) in means}
        if any(g["w"] <= 0.0 for g in groups.values()):
            fit.centres[name] = float("nan")
            nothing = np.full(npar[name], np.nan)
            fit.fits.update({(name, sign): GroupFit(nothing, np.full((npar[name],) * 2, np.nan)) for sign in groups})
            continue
        mean_eta = sum(g["eta"] for g in groups.values()) / sum(g["w"] for g in groups.values())
        fit.centres[name] = _link_value(fit.links[name], mean_eta)
        for sign, group in groups.items():
            start = np.zeros(npar[name])
            start[0] = _link_value(fit.links[name], group["wrong"] / group["w"], 0.01)
            fit.fits[(name, sign)] = GroupFit(start, np.full((npar[name],) * 2, np.nan))
            active.add((name, sign))
    for _ in range(iterations if active else 0):
        for key, row in _score_sums(rows, fit, active, numbers, width).items():
            group = fit.fits[key]
            if group.previous is not None and row["loss"] > group.loss + 1e-7 * abs(group.loss):
                group.values = 0.5 * (group.values + group.previous)
                continue
            step, covariance = _solve(row, len(group.values), width)
            if step is None:
                active.discard(key)
                continue
            group.previous, group.loss = group.values, row["loss"]
            group.values, group.covariance = group.values + step, covariance
            if np.max(np.abs(step)) < tolerance:
                group.converged = True
                active.discard(key)
        if not active:
            break


def _solve(row, n: int, width: int):
    g = np.array([row[f"g{k}"] for k in range(n)], dtype=float)
    h = np.array([[row[f"h{i + j}"] for j in range(n)] for i in range(n)], dtype=float)
    v = np.array([[row[f"v{i + j}"] for j in range(n)] for i in range(n)], dtype=float)
    if not (np.isfinite(g).all() and np.isfinite(h).all()):
        return None, None
    try:
        inverse = np.linalg.inv(h)
    except np.linalg.LinAlgError:
        return None, None
    return inverse @ g, inverse @ v @ inverse


def _score_sums(rows: DataFrame, fit: Calibration, active: set, numbers: dict, width: int) -> dict:
    """Gradient, information and squared-weight information sums of the active groups.

    The state of all groups is literal arrays that a row indexes by its group's number: every step runs the same compiled code.
    """
    groups = sorted(numbers, key=numbers.get)
    values = np.zeros((len(groups), width))
    for group in active:
        own = fit.fits[group].values
        values[numbers[group], : len(own)] = own
    of_row = lambda x: F.lit(x)[F.col("_k")]
    centre = of_row(np.nan_to_num(np.array([fit.centres.get(t, 0.0) for t, _ in groups])))
    live = rows.filter(of_row([g in active for g in groups]))
    staged = live.withColumn("logit", of_row([fit.links[t] == "logit" for t, _ in groups]))
    staged = staged.withColumn("x", F.when(F.col("logit"), F.col("log_odds")).otherwise(F.col("eta")) - centre)
    u = polynomial(F.col("x"), [of_row(values[:, k]) for k in range(width)])
    staged = staged.withColumn("omega", clipped(F.when(F.col("logit"), inverse_link("logit", u)).otherwise(u)))
    omega, chi = F.col("omega"), F.col("chi")
    slope = F.when(F.col("logit"), omega * (1.0 - omega)).otherwise(F.lit(1.0)) * (1.0 - 2.0 * chi)
    pi = clipped(omega + chi - 2.0 * omega * chi)
    staged = staged.withColumns({"slope": slope, "pi": pi})
    spread = F.col("pi") * (1.0 - F.col("pi"))
    staged = staged.withColumns(
        {
            "_g": F.col("w") * (F.col("wrong") - F.col("pi")) * F.col("slope") / spread,
            "_h": F.col("w") * F.col("slope") * F.col("slope") / spread,
        }
    )
    wrong, pi = F.col("wrong"), F.col("pi")
    loss = -F.col("w") * F.log(F.when(wrong == 1.0, pi).otherwise(1.0 - pi))
    powers: list[Column] = [F.lit(1.0)]
    for _ in range(2 * width - 2):
        powers.append(powers[-1] * F.col("x"))
    added = [F.sum(F.col("_g") * powers[k]).alias(f"g{k}") for k in range(width)]
    added += [F.sum(F.col("_h") * p).alias(f"h{k}") for k, p in enumerate(powers)]
    added += [F.sum(F.col("w") * F.col("_h") * p).alias(f"v{k}") for k, p in enumerate(powers)]
    added.append(F.sum(loss).alias("loss"))
    return {groups[r["_k"]]: r for r in staged.groupBy("_k").agg(*added).collect()}


def apply_calibration(
    df: DataFrame, fit: Calibration, tagger: str, decision: str, mistag: str, out_decision: str = "d_cal", out_mistag: str = "omega"
) -> DataFrame:
    """Calibrated mistag from the flavour-averaged parameters.

    A track calibrated to one half or more becomes untagged (decision 0, mistag 0.5).
    """
    if not fit.links:
        raise ValueError("calibration holds no tagger")
    width = max(len(g.values) for g in fit.fits.values())
    chain = F
    for name in sorted(fit.links):
        values = list(fit.mean_parameters(name))
        values += [0.0] * (width - len(values))
        x = link_of(F.col(mistag), fit.links[name]) - F.lit(fit.centres[name])
        u = polynomial(x, [F.lit(float(v)) for v in values])
        chain = chain.when(F.col(tagger) == name, inverse_link(fit.links[name], u))
    usable = (F.col(decision) != 0) & (F.col(mistag) < 0.5)
    omega = F.when(usable, chain)
    tagged = F.coalesce((F.col("_omega") < 0.5), F.lit(False))
    return (
        df.withColumn("_omega", omega)
        .withColumns(
            {
                out_decision: F.when(tagged, F.col(decision)).otherwise(F.lit(0)).cast("int"),
                out_mistag: F.when(tagged, F.greatest(F.col("_omega"), F.lit(0.0))).otherwise(F.lit(0.5)),
            }
        )
        .drop("_omega")
    )


def log_odds(decision: Column, mistag: Column) -> Column:
    """Signed evidence of one tagger: d * ln((1 - eta) / eta); 0 for an untagged or absent one."""
    eta = F.greatest(F.least(mistag, F.lit(0.5)), F.lit(1e-12))
    evidence = decision * F.log((1.0 - eta) / eta)
    return F.coalesce(F.when(decision != 0, evidence), F.lit(0.0))


def _from_log_odds(total: Column) -> tuple[Column, Column]:
    eta = 1.0 / (1.0 + F.exp(F.abs(total)))
    return F.signum(total).cast("int"), eta


def combine_taggers(
    df: DataFrame, event: str, decision: str, mistag: str, carry: Iterable[str] = (), out: tuple[str, str] = ("d", "eta")
) -> DataFrame:
    """One decision and mistag per event from a long (event, tagger) table.

    The product of per-tagger probabilities is a sum of log odds, so it combines map-side. ``carry``
    columns are constant within an event.
    """
    carry = list(carry)
    added = df.groupBy(event).agg(
        F.sum(log_odds(F.col(decision), F.col(mistag))).alias("_l"), *[F.max(c).alias(c) for c in carry]
    )
    d, eta = _from_log_odds(F.col("_l"))
    return added.select(event, *carry, d.alias(out[0]), eta.alias(out[1]))


def combine_wide(taggers: Iterable[tuple[str, str]], out: tuple[str, str] = ("d", "eta")) -> dict[str, Column]:
    """The same combination for a wide table with one (decision, mistag) column pair per tagger."""
    parts = [log_odds(F.col(d), F.col(eta)) for d, eta in taggers]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    d, eta = _from_log_odds(total)
    return {out[0]: d, out[1]: eta}


def to_long(df: DataFrame, keep: Iterable[str], sources: Mapping[tuple, tuple[str, str]], labels: Iterable[str]) -> DataFrame:
    """Stack (decision, mistag) column pairs into rows ``labels..., d, eta`` without a join."""
    keep, labels = list(keep), list(labels)
    items = [
        F.struct(
            *[F.lit(v).alias(n) for n, v in zip(labels, key)],
            F.col(d).cast("int").alias("d"),
            F.col(eta).cast("double").alias("eta"),
        )
        for key, (d, eta) in sources.items()
    ]
    return df.select(*keep, F.explode(F.array(*items)).alias("_t")).select(*keep, "_t.*").filter("d IS NOT NULL")


def _curve_figures(by: list[str]) -> list[Column]:
    w, wt = F.col("sum_w"), F.col("sum_wrong")
    omega = F.try_divide(wt, w)
    n_eff = F.try_divide(w * w, F.col("sum_w2"))
    return [
        *[F.col(c) for c in by],
        F.col("bin").cast("int").alias("bin"),
        F.col("n"),
        F.try_divide(F.col("sum_eta"), w).alias("mean_eta"),
        omega.alias("omega"),
        F.sqrt(F.greatest(F.try_divide(omega * (1.0 - omega), n_eff), F.lit(0.0))).alias("omega_err"),
    ]


_CURVE_SUMS = ("n", "sum_w", "sum_w2", "sum_wrong", "sum_eta")


def _curve_sums() -> list[Column]:
    w = F.col("w")
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(w).alias("sum_w"),
        F.sum(w * w).alias("sum_w2"),
        F.sum(w * F.col("wrong")).alias("sum_wrong"),
        F.sum(w * F.col("eta")).alias("sum_eta"),
    ]


def calibration_curve(
    df: DataFrame,
    decision: str,
    mistag: str,
    flavour: str,
    weight: str | None = None,
    bins: int = 10,
    equal_yield: bool = True,
    by: Iterable[str] = (),
) -> DataFrame:
    """True mistag against predicted mistag in bins of the latter.

    Equal-yield bins hold the same sum of weights: bin = floor(bins * weight before / total). They
    need running sums in mistag order, taken bucket-wise over pre-aggregated values. Fixed bins split
    [0, 0.5] evenly.
    """
    by = list(by)
    rows = df.filter((F.col(decision) != 0) & (F.col(mistag) < 0.5)).select(
        *by,
        (F.col(decision) * F.signum(F.col(flavour)) < 0).cast("double").alias("wrong"),
        F.col(mistag).cast("double").alias("eta"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    if not equal_yield:
        position = F.least(F.floor(F.col("eta") / (0.5 / bins)), F.lit(bins - 1))
        return rows.withColumn("bin", position).groupBy(*by, "bin").agg(*_curve_sums()).select(*_curve_figures(by))
    edges = value_edges(rows, "eta")
    values = rows.groupBy(*by, "eta").agg(*_curve_sums())
    ordered = running_sums(values, "eta", ["sum_w"], edges, by)
    share = F.floor(bins * F.col("sum_w_before") / F.col("sum_w_total"))
    placed = ordered.withColumn("bin", F.greatest(F.least(share, F.lit(bins - 1)), F.lit(0)))
    merged = placed.groupBy(*by, "bin").agg(*[F.sum(c).alias(c) for c in _CURVE_SUMS])
    return merged.select(*_curve_figures(by))
