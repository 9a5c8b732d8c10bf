"""Histograms as small tables: fixed range, common binning, weighted, densities, differences."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators.ranking import exact_quantile


def bin_index(x: Column, low: float | Column, high: float | Column, bins: int) -> Column:
    """Bin number in [0, bins): half-open bins, the last one closed, NULL outside the range."""
    inside = (x >= low) & (x <= high) & ~F.isnan(x)
    raw = F.floor((x - low) / ((high - low) / F.lit(float(bins))))
    return F.when(inside, F.least(raw, F.lit(bins - 1).cast("long"))).cast("int")


def histogram(
    df: DataFrame,
    value: str,
    low: float,
    high: float,
    bins: int,
    by: Iterable[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """Counts per bin (and class): ``by..., bin, bin_low, n, density`` including empty bins.

    One combinable aggregation over the rows. The result has ``bins`` rows per class, so gathering a
    class' bins in order to fill gaps and normalise works on bounded data.
    """
    by = list(by)
    width = (high - low) / bins
    x = F.col(value).cast("double")
    content = F.count(F.lit(1)) if weight is None else F.sum(F.col(weight))
    counted = (
        df.select(*by, bin_index(x, low, high, bins).alias("bin"), *([weight] if weight else []))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "bin")
        .agg(content.alias("n"))
    )
    packed = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_bins"),
        F.sum("n").alias("_total"),
    )
    filled = packed.select(
        *by, "_bins", "_total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    zero = F.lit(0).cast("long") if weight is None else F.lit(0.0)
    n = F.coalesce(F.try_element_at("_bins", F.col("bin")), zero)
    return filled.select(
        *by,
        "bin",
        (F.lit(float(low)) + F.col("bin") * F.lit(width)).alias("bin_low"),
        n.alias("n"),
        F.try_divide(n.cast("double"), F.col("_total") * F.lit(width)).alias("density"),
    )


#: Unit bins of an integer column.
MOST_BINS = 100_000


def histograms(df: DataFrame, ranges: Mapping[str, tuple[float, float]], bins: int, by: Iterable[str] = ()) -> DataFrame:
    """``histogram`` of several features at once: ``feature, by..., bin, bin_low, n, density``.

    A row gives one (feature, bin) for each feature, counted in the same combinable aggregation; a feature's bin width is its own.
    """
    by = list(by)
    places = [
        F.struct(F.lit(name).alias("feature"), bin_index(F.col(name).cast("double"), low, high, bins).alias("bin")) for name, (low, high) in ranges.items()
    ]
    placed = df.select(*by, F.explode(F.array(*places)).alias("_p")).select("_p.feature", *by, "_p.bin")
    counted = placed.filter(F.col("bin").isNotNull()).groupBy("feature", *by, "bin").agg(F.count(F.lit(1)).alias("n"))
    packed = counted.groupBy("feature", *by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_bins"), F.sum("n").alias("_total"))
    filled = packed.select("feature", *by, "_bins", "_total", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("feature"))
    low, width = pick({n: lo for n, (lo, _) in ranges.items()}), pick({n: (hi - lo) / bins for n, (lo, hi) in ranges.items()})
    n = F.coalesce(F.try_element_at("_bins", F.col("bin")), F.lit(0).cast("long"))
    return filled.select("feature", *by, "bin", (low + F.col("bin") * width).alias("bin_low"), n.alias("n"), F.try_divide(n.cast("double"), F.col("_total") * width).alias("density"))


def common_range(
    df: DataFrame, value: str, integer: bool = False, bins: int = 60, upper: float = 0.995
) -> tuple[float, float, int]:
    """Range and bin count shared by all samples in ``df``.

    Integer columns get unit bins centred on the integers from minimum to maximum, at most ``MOST_BINS`` (one stray value would
    else make any number of empty bins: an error that names the range); other columns run
    from the minimum to an upper quantile (at least one unit wide).
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if integer:
        row = clean.agg(F.floor(F.min(value)).alias("lo"), F.ceil(F.max(value)).alias("hi")).first()
        if row["lo"] is None:
            return -0.5, 0.5, 1
        if row["hi"] - row["lo"] >= MOST_BINS:
            raise ValueError(f"{value} runs from {row['lo']} to {row['hi']}: more than {MOST_BINS} unit bins, give a fixed range")
        low, high = float(row["lo"]) - 0.5, float(row["hi"]) + 0.5
        return low, high, int(high - low)
    low = float(clean.agg(F.min(value).cast("double").alias("lo")).first()["lo"])
    high = float(exact_quantile(clean, value, upper).first()[0])
    return (low, high, bins) if high > low else (low, low + 1.0, bins)


def histogram_common(
    df: DataFrame,
    value: str,
    sample: str,
    integer: bool = False,
    bins: int = 60,
    fixed: tuple[float, float] | None = None,
) -> DataFrame:
    """Histogram of every sample on edges common to all of them."""
    low, high, count = (*fixed, bins) if fixed else common_range(df, value, integer, bins)
    return histogram(df, value, low, high, count, [sample])


def histogram_difference(
    df: DataFrame, value: str, low: float, high: float, bins: int, positive: Column, negative: Column
) -> DataFrame:
    """Difference of two classes' densities on shared bins, in one pass over the rows."""
    width = (high - low) / bins
    counted = (
        df.select(
            bin_index(F.col(value).cast("double"), low, high, bins).alias("bin"),
            positive.cast("long").alias("_p"),
            negative.cast("long").alias("_m"),
        )
        .filter(F.col("bin").isNotNull())
        .groupBy("bin")
        .agg(F.sum("_p").alias("_p"), F.sum("_m").alias("_m"))
    )
    everything = Window.partitionBy()  # at most ``bins`` rows
    share = {c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(everything) * width) for c in ("_p", "_m")}
    return counted.select(
        "bin",
        share["_p"].alias("density_positive"),
        share["_m"].alias("density_negative"),
        (share["_p"] - share["_m"]).alias("difference"),
    )


def pulls(counted: DataFrame, count: str, model: str) -> DataFrame:
    """(count - model) / sqrt(count) per bin, NULL for empty bins."""
    n = F.col(count).cast("double")
    return counted.withColumn("pull", F.when(n > 0, (n - F.col(model)) / F.sqrt(n)))
