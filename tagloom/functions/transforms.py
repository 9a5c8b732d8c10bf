"""Feature preprocessing, link functions and rounding rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def standardise(x: Column, mean: Column | float, scale: Column | float) -> Column:
    return (x - mean) / scale


def yeo_johnson(x: Column, power: float | Column) -> Column:
    """Yeo-Johnson transform; the power is a constant or a column.

    Both branches are sign(x) * (exp(q * L) - 1) / q with L = log(1 + |x|) and q = power for x >= 0,
    2 - power below, and L itself where q = 0.
    """
    p = power if isinstance(power, Column) else F.lit(float(power))
    return yeo_johnson_log(F.signum(x), F.log1p(F.abs(x)), p)


def yeo_johnson_log(sign: Column, log1p_abs: Column, power: Column) -> Column:
    """The transform from a sign and log(1 + |x|), for evaluating many powers of one value."""
    q = F.when(sign >= 0, power).otherwise(2.0 - power)
    return sign * F.when(q == 0, log1p_abs).otherwise(F.expm1(q * log1p_abs) / q)


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def link(name: str, x: Column) -> Column:
    """``logit`` or ``mistag`` (identity) link of a probability."""
    if name == "logit":
        return F.log(x / (1.0 - x))
    if name == "mistag":
        return x
    raise ValueError(f"unknown link {name!r}")


def inverse_link(name: str, x: Column) -> Column:
    if name == "logit":
        return sigmoid(x)
    if name == "mistag":
        return x
    raise ValueError(f"unknown link {name!r}")


def error_digits(error: Column) -> Column:
    """Decimal places that keep one significant digit of ``error``."""
    return (-F.floor(F.log10(error))).cast("int")


def round_to(x: Column, digits: Column) -> Column:
    """Round to a per-row number of decimals (may be negative)."""
    scale = F.pow(F.lit(10.0), digits.cast("double"))
    return F.round(x * scale) / scale


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def fixed(x: Column | str, digits: int) -> Column:
    """Round half away from zero to ``digits`` decimals in floating point.

    Built-in ``round`` goes through decimal objects per value; this stays in primitive arithmetic and
    so inside generated code. Not for NaN; values times 10**digits must fit a 64-bit integer.
    """
    value = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale + 0.0
