"""Mistag calibrations of any number of groups at once: fits per bin, per tagger, per period, in one aggregation a step.

Groups are the distinct values of any columns. Each gets a number; the parameters of all groups travel as literal arrays that a
row indexes by its number, so a step is one projection and one combinable aggregation, without a join and with the same
compiled code every time. The driver sees one row of sums per group and flavour and solves all small systems at once. Fitted
parameters are a table, applied by an ordinary join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import performance as perf
from tagloom.functions.transforms import inverse_link
from tagloom.operators.calibration import clipped, link_of, polynomial
from tagloom.operators.ranking import join_null_safe
from tagloom.session import local_table

#: Groups whose parameters the driver holds; more are an error, not a wrong result.
MOST_GROUPS = 200_000


@dataclass(frozen=True)
class GroupCalibration:
    """``keys`` has one row per group; arrays are by group, then flavour (+, -), then parameter."""

    keys: pa.Table
    link: str
    centres: np.ndarray
    mean_eta: np.ndarray
    values: np.ndarray
    covariance: np.ndarray
    converged: np.ndarray

    def mean_values(self) -> np.ndarray:
        """Parameters of the flavour average."""
        return self.values.mean(axis=1)

    def mean_covariance(self) -> np.ndarray:
        return self.covariance.sum(axis=1) / 4.0

    def table(self, df: DataFrame) -> DataFrame:
        """The group columns, then link, centre, mean_eta, converged, and for each flavour values and flat covariance; ``df`` gives
        the session. Groups or flavours that could not be fitted have missing numbers."""
        lists = lambda x: pa.array([None if np.isnan(row).any() else row.ravel().tolist() for row in x], pa.list_(pa.float64()))
        columns = {
            **{n: self.keys[n] for n in self.keys.column_names},
            "link": pa.array([self.link] * self.keys.num_rows),
            "centre": pa.array(self.centres, from_pandas=True),
            "mean_eta": pa.array(self.mean_eta, from_pandas=True),
            "converged": pa.array(self.converged.all(axis=1)),
            "plus": lists(self.values[:, 0]),
            "plus_cov": lists(self.covariance[:, 0]),
            "minus": lists(self.values[:, 1]),
            "minus_cov": lists(self.covariance[:, 1]),
            "mean": lists(self.mean_values()),
            "mean_cov": lists(self.mean_covariance()),
        }
        return local_table(df.sparkSession, pa.table(columns))


def calibrate_groups(
    df: DataFrame,
    by: Sequence[str],
    decision: str,
    mistag: str,
    flavour: str,
    weight: str | None = None,
    link: str = "logit",
    npar: int = 2,
    iterations: int = 40,
    tolerance: float = 1e-10,
    least: int = 0,
) -> GroupCalibration:
    """Fit link(omega) = sum_k p_k (link(eta) - c)^k for every group and flavour, c being the group's link of the mean mistag.

    The same Fisher scoring as a single fit. Rows without a tag are left out; missing group values are groups like others. A group
    and flavour of fewer than ``least`` tagged rows, or without a positive weight, is not fitted.
    """
    by = list(by)
    d, eta, sign = F.col(decision), F.col(mistag), F.signum(F.col(flavour))
    rows = df.filter((d != 0) & (eta < 0.5) & (sign != 0)).select(
        *by,
        (sign < 0).cast("int").alias("_s"),
        (d * sign < 0).cast("double").alias("_y"),
        link_of(eta, link).alias("_v"),
        clipped(eta).alias("_e"),
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w"),
    )
    w = F.col("_w")
    sums = rows.groupBy(*by, "_s").agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_sw"), F.sum(w * F.col("_e")).alias("_se"), F.sum(w * F.col("_y")).alias("_sy")).toArrow()
    if sums.num_rows > 2 * MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    distinct: dict[tuple, int] = {}
    numbers = np.array([distinct.setdefault(key, len(distinct)) for key in zip(*[sums[c].to_pylist() for c in by])], dtype=int) if by else np.zeros(sums.num_rows, int)
    groups = len(distinct) if by else min(sums.num_rows, 1)
    side = sums["_s"].to_numpy().astype(int)
    n, sw, se, sy = (np.zeros((groups, 2)) for _ in range(4))
    for target, name in ((n, "_n"), (sw, "_sw"), (se, "_se"), (sy, "_sy")):
        target[numbers, side] = sums[name].to_numpy()
    first = np.unique(numbers, return_index=True)[1] if sums.num_rows else np.zeros(0, int)
    keys = sums.select(by).take(pa.array(first)) if by else pa.table({"_one": pa.array([0] * groups)})

    def of(p: np.ndarray, margin: float = 1e-9) -> np.ndarray:
        p = np.clip(p, margin, 1.0 - margin)
        return np.log(p / (1.0 - p)) if link == "logit" else p

    with np.errstate(divide="ignore", invalid="ignore"):
        mean_eta = se.sum(axis=1) / sw.sum(axis=1)
        centres = of(mean_eta)
        values = np.zeros((groups, 2, npar))
        values[:, :, 0] = of(sy / sw, 0.01)
    active = (n > max(least - 1, 0)) & (sw > 0) & np.isfinite(centres)[:, None]
    values[~active] = np.nan
    covariance = np.full((groups, 2, npar, npar), np.nan)
    converged, loss, before = np.zeros((groups, 2), bool), np.full((groups, 2), np.inf), values.copy()
    result = lambda: GroupCalibration(keys, link, centres, mean_eta, values, covariance, converged)
    if not active.any():
        return result()
    if by:
        numbered = keys.append_column("_g", pa.array(np.arange(groups), pa.int32()))
        rows = join_null_safe(rows, local_table(df.sparkSession, numbered), by)
    else:
        rows = rows.withColumn("_g", F.lit(0))
    centre = F.lit(np.nan_to_num(centres))[F.col("_g")]
    slim = rows.select((F.col("_g") * 2 + F.col("_s")).alias("_k"), "_y", (F.col("_v") - centre).alias("_x"), "_w").persist()
    try:
        for _ in range(iterations):
            found = _score_sums(slim, link, values, active)
            at = found["k"]
            g, s = at // 2, at % 2
            worse = found["loss"] > loss[g, s] + 1e-7 * np.abs(loss[g, s])
            half = at[worse]
            values[half // 2, half % 2] = 0.5 * (values[half // 2, half % 2] + before[half // 2, half % 2])
            fine = ~worse
            g, s, information, squares, gradient = g[fine], s[fine], found["h"][fine], found["v"][fine], found["g"][fine]
            usable = np.isfinite(information).all(axis=(1, 2)) & np.isfinite(gradient).all(axis=1)
            usable[usable] &= np.abs(np.linalg.det(information[usable])) > 0
            active[g[~usable], s[~usable]] = False
            g, s, information, squares, gradient = g[usable], s[usable], information[usable], squares[usable], gradient[usable]
            inverse = np.linalg.inv(information)
            step = (inverse @ gradient[:, :, None])[:, :, 0]
            before[g, s], loss[g, s] = values[g, s], found["loss"][fine][usable]
            values[g, s] += step
            covariance[g, s] = inverse @ squares @ inverse
            done = np.abs(step).max(axis=1) < tolerance
            converged[g[done], s[done]] = True
            active[g[done], s[done]] = False
            if not active.any():
                break
        return result()
    finally:
        slim.unpersist()


def _score_sums(slim: DataFrame, link: str, values: np.ndarray, active: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient, information, squared-weight information and loss of the active groups, from one aggregation."""
    npar = values.shape[2]
    flat, live = np.nan_to_num(values.reshape(-1, npar)), active.ravel()
    rows = slim if live.all() else slim.filter(F.lit(live.tolist())[F.col("_k")])
    x, w, y = F.col("_x"), F.col("_w"), F.col("_y")
    u = polynomial(x, [F.lit(flat[:, i])[F.col("_k")] for i in range(npar)])
    staged = rows.select("_k", "_x", "_w", "_y", clipped(inverse_link(link, u)).alias("_o"))
    omega = F.col("_o")
    slope = omega * (1.0 - omega) if link == "logit" else F.lit(1.0)
    staged = staged.select("_k", "_x", "_w", "_y", "_o", (w * (y - omega) * slope / (omega * (1.0 - omega))).alias("_a"), (w * slope * slope / (omega * (1.0 - omega))).alias("_b"))
    powers: list[Column] = [F.lit(1.0)]
    for _ in range(2 * npar - 2):
        powers.append(powers[-1] * x)
    sums = staged.groupBy("_k").agg(
        *[F.sum(F.col("_a") * powers[i]).alias(f"g{i}") for i in range(npar)],
        *[F.sum(F.col("_b") * p).alias(f"h{i}") for i, p in enumerate(powers)],
        *[F.sum(w * F.col("_b") * p).alias(f"v{i}") for i, p in enumerate(powers)],
        F.sum(-w * F.log(F.when(y == 1.0, omega).otherwise(1.0 - omega))).alias("loss"),
    ).toArrow()
    matrix = lambda name: np.array([[sums[f"{name}{i + j}"].to_numpy() for j in range(npar)] for i in range(npar)]).transpose(2, 0, 1)
    gradient = np.array([sums[f"g{i}"].to_numpy() for i in range(npar)]).T
    return {"k": sums["_k"].to_numpy().astype(int), "g": gradient, "h": matrix("h"), "v": matrix("v"), "loss": sums["loss"].to_numpy()}


def apply_groups(df: DataFrame, fit: GroupCalibration, by: Sequence[str], decision: str, mistag: str, out_decision: str = "d_cal", out_mistag: str = "omega", slopes: str | None = None) -> DataFrame:
    """Calibrated mistag by the flavour-averaged parameters of a row's group, found by a join on the group columns.

    A row calibrated to one half or more, or of a group without a fit, becomes untagged (decision 0, mistag 0.5). ``slopes`` names an
    added array: derivatives of the calibrated mistag to the parameters, missing for untagged rows.
    """
    by, npar = list(by), fit.values.shape[2]
    table = fit.table(df).select(*by, F.col("centre").alias("_c"), F.col("mean").alias("_p"))
    keys = {c: f"_by_{c}" for c in by}
    same = [F.col(c).eqNullSafe(F.col(k)) for c, k in keys.items()]
    joined = df.join(table.withColumnsRenamed(keys), same, "left") if by else df.join(table, F.lit(True))
    x = link_of(F.col(mistag), fit.link) - F.col("_c")
    u = polynomial(x, [F.get("_p", F.lit(i)) for i in range(npar)])
    usable = (F.col(decision) != 0) & (F.col(mistag) < 0.5)
    made = joined.withColumns({"_x": x, "_omega": F.when(usable, inverse_link(fit.link, u))})
    tagged = F.coalesce(F.col("_omega") < 0.5, F.lit(False))
    columns = {
        out_decision: F.when(tagged, F.col(decision)).otherwise(F.lit(0)).cast("int"),
        out_mistag: F.when(tagged, F.greatest("_omega", F.lit(0.0))).otherwise(F.lit(0.5)),
    }
    if slopes:
        slope = F.col("_omega") * (1.0 - F.col("_omega")) if fit.link == "logit" else F.lit(1.0)
        powers = [F.lit(1.0)]
        for _ in range(npar - 1):
            powers.append(powers[-1] * F.col("_x"))
        columns[slopes] = F.when(tagged, F.array(*[slope * p for p in powers]))
    return made.withColumns(columns).select(*df.columns, *columns)


def calibrated_performance(df: DataFrame, fit: GroupCalibration, by: Sequence[str], decision: str, mistag: str, flavour: str, weight: str | None = None, total: str | None = None) -> DataFrame:
    """Performance per group after calibration, with the errors that come from the parameters' covariance.

    ``tagging_power_cal_err`` and ``effective_mistag_cal_err`` are gradient times covariance times gradient, the gradients being sums
    over the same rows as the figures; rows that a shifted calibration would tag or untag play no part. ``total`` is a column
    (constant in a group) with the summed weights that efficiency and power refer to, where the rows are only part of them.
    """
    by, npar = list(by), fit.values.shape[2]
    rows = apply_groups(df, fit, by, decision, mistag, "_d", "_o", slopes="_dp")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    dilution = 1.0 - 2.0 * F.col("_o")
    slopes = [F.sum(F.when(F.col("_d") != 0, -4.0 * w * dilution * F.get("_dp", F.lit(i)))).alias(f"_s{i}") for i in range(npar)]
    sums = rows.groupBy(*by).agg(*perf.performance_sums(F.col("_d"), F.col("_o"), F.col(flavour), w), *slopes, *([F.max(total).alias("_total")] if total else []))
    if total:
        sums = sums.withColumn("sum_w", F.col("_total").cast("double"))
    figures = perf.performance_columns()
    table = fit.table(df).select(*by, F.col("mean_cov").alias("_cov"))
    joined = join_null_safe(sums.withColumns(figures), table, by) if by else sums.withColumns(figures).join(table, F.lit(True))
    terms = [F.col(f"_s{i}") * F.col(f"_s{j}") * F.get("_cov", F.lit(i * npar + j)) for i in range(npar) for j in range(npar)]
    variance = terms[0]
    for term in terms[1:]:
        variance = variance + term
    root = F.sqrt(F.greatest(variance, F.lit(0.0)))  # error of the summed squared dilutions
    effective = F.try_divide(root, 4.0 * F.col("sum_w_tagged") * (1.0 - 2.0 * F.col("effective_mistag")))
    return joined.select(
        *by, "n", "n_tagged", *[c for c in figures], F.try_divide(root, F.col("sum_w")).alias("tagging_power_cal_err"), effective.alias("effective_mistag_cal_err")
    )


def by_splits(df: DataFrame, splits: dict[str, Column], keep: Iterable[str]) -> DataFrame:
    """Each row once for every split, as (split, bin, columns kept); rows outside a split's bins are left out of it."""
    items = [F.struct(F.lit(name).alias("split"), bin_.cast("int").alias("bin")) for name, bin_ in splits.items()]
    return df.select(*keep, F.explode(F.array(*items)).alias("_s")).select("_s.split", "_s.bin", *keep).filter("bin IS NOT NULL")
