"""Tagging performance from a handful of additive sums.

Every quantity below is a function of sums that combine map-side, so overall numbers, numbers per
kinematic bin and numbers per time window all come from the same aggregates. Weights may be negative
(sWeights); only plain sums of w and w*w are used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMS = ("n", "n_tagged", "sum_w", "sum_w2", "sum_w_tagged", "sum_w2_tagged", "sum_w_wrong", "sum_d2", "sum_d4")


def performance_sums(decision: Column, mistag: Column, flavour: Column, weight: Column | None = None) -> list[Column]:
    """The aggregates behind all performance figures.

    A track with decision 0 or a mistag of one half or more is not tagged.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    tagged = F.coalesce((decision != 0) & (mistag < 0.5), F.lit(False))
    wrong = tagged & (decision * F.signum(flavour) < 0)
    dilution2 = (1.0 - 2.0 * mistag) * (1.0 - 2.0 * mistag)
    zero = F.lit(0.0)
    return [
        F.count(F.lit(1)).alias("n"),
        F.sum(tagged.cast("long")).alias("n_tagged"),
        F.sum(w).alias("sum_w"),
        F.sum(w * w).alias("sum_w2"),
        F.sum(F.when(tagged, w).otherwise(zero)).alias("sum_w_tagged"),
        F.sum(F.when(tagged, w * w).otherwise(zero)).alias("sum_w2_tagged"),
        F.sum(F.when(wrong, w).otherwise(zero)).alias("sum_w_wrong"),
        F.sum(F.when(tagged, w * dilution2).otherwise(zero)).alias("sum_d2"),
        F.sum(F.when(tagged, w * dilution2 * dilution2).otherwise(zero)).alias("sum_d4"),
    ]


def _root(x: Column) -> Column:
    """Square root that treats rounding noise below zero as zero."""
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def performance_columns() -> dict[str, Column]:
    """Efficiency, mistag, effective mistag and power with errors, from the sums.

    Binomial errors use the effective number of entries (sum w)^2 / sum w^2, which is the plain count
    for unit weights. The power error combines the relative errors of the efficiency and of the mean
    squared dilution.
    """
    c = F.col
    n_eff = F.try_divide(c("sum_w") * c("sum_w"), c("sum_w2"))
    n_eff_tagged = F.try_divide(c("sum_w_tagged") * c("sum_w_tagged"), c("sum_w2_tagged"))
    eff = F.try_divide(c("sum_w_tagged"), c("sum_w"))
    eff_err = _root(F.try_divide(eff * (1.0 - eff), n_eff))
    mistag = F.try_divide(c("sum_w_wrong"), c("sum_w_tagged"))
    mistag_err = _root(F.try_divide(mistag * (1.0 - mistag), n_eff_tagged))
    mean_d2 = F.try_divide(c("sum_d2"), c("sum_w_tagged"))
    mean_d4 = F.try_divide(c("sum_d4"), c("sum_w_tagged"))
    mean_d2_err = _root(F.try_divide(mean_d4 - mean_d2 * mean_d2, n_eff_tagged))
    power = F.try_divide(c("sum_d2"), c("sum_w"))
    dilution = _root(mean_d2)
    effective_err = F.try_divide(mean_d2_err, 4.0 * dilution)
    return {
        "n_eff": n_eff,
        "tag_efficiency": eff,
        "tag_efficiency_err": eff_err,
        "mistag_rate": mistag,
        "mistag_rate_err": mistag_err,
        "effective_mistag": 0.5 - 0.5 * dilution,
        "effective_mistag_err": effective_err,
        "tagging_power": power,
        "tagging_power_err": power_error(power, eff, eff_err, 0.5 - 0.5 * dilution, effective_err),
    }


def power_error(power: Column, eff: Column, eff_err: Column, effective: Column, effective_err: Column) -> Column:
    """Error of power = efficiency * (1 - 2 * effective mistag)^2."""
    relative_eff = F.try_divide(eff_err, eff)
    relative_dilution = F.try_divide(4.0 * effective_err, 1.0 - 2.0 * effective)
    return power * _root(relative_eff * relative_eff + relative_dilution * relative_dilution)
