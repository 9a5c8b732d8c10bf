"""Counts, compositions, confusion tables, performance figures and error propagation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.functions import performance as perf
from tagloom.functions.transforms import error_digits, finite, round_to
from tagloom.operators.ranking import join_null_safe, running_sums, value_edges


def value_counts(df: DataFrame, by: Iterable[str], within: Iterable[str] = ()) -> DataFrame:
    """Counts and percentages of value combinations.

    ``within`` names grouping columns for the percentage; empty means percent of the whole table,
    whose size is a scalar subquery rather than a window over all groups.
    """
    by, within = list(by), list(within)
    counted = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    if within:
        counted = join_null_safe(counted, counted.groupBy(*within).agg(F.sum("n").alias("_total")), within)
    else:
        counted = counted.withColumn("_total", counted.agg(F.sum("n")).scalar())
    return counted.select(*by, "n", (100.0 * F.col("n") / F.col("_total")).alias("percent"))


def top_values(counted: DataFrame, n: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    """The n most frequent rows of a counts table (a top-k report)."""
    return counted.orderBy(F.desc("n"), *ties).limit(n)


def composition(df: DataFrame, value: str, codes: Mapping[str, int]) -> DataFrame:
    """Percent of rows per code, rounded to two digits before scaling to percent."""
    shares = [
        (F.round(F.avg((F.abs(F.col(value)) == code).cast("double")), 2) * 100.0).alias(name)
        for name, code in codes.items()
    ]
    return df.agg(*shares)


def label_asymmetry(df: DataFrame, by: Iterable[str], label: str, flavour: str) -> DataFrame:
    """Counts by label and flavour sign, percent of the set, and the flavour asymmetry per label."""
    by = list(by)

    def count(correct: int, positive: bool) -> Column:
        side = F.col(flavour) > 0 if positive else F.col(flavour) < 0
        return F.sum(((F.col(label) == correct) & side).cast("long"))

    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            count(correct, positive).alias(f"n_{name}_l{correct}")
            for correct in (1, 0)
            for name, positive in (("b", True), ("antib", False))
        ],
    )
    extra: dict[str, Column] = {}
    for correct in (1, 0):
        b, anti = F.col(f"n_b_l{correct}"), F.col(f"n_antib_l{correct}")
        extra[f"percent_b_l{correct}"] = F.try_divide(100.0 * b, F.col("n"))
        extra[f"percent_antib_l{correct}"] = F.try_divide(100.0 * anti, F.col("n"))
        extra[f"asymmetry_l{correct}"] = F.try_divide(100.0 * (b - anti), b + anti)
    return counted.withColumns(extra)


def merge_classes(name: Column, merged: Sequence[str], into: str = "UnifiedOthers") -> Column:
    return F.when(name.isin(list(merged)), into).otherwise(name) if merged else name


def confusion_table(
    df: DataFrame,
    truth: str,
    predicted: str,
    classes: Sequence[str],
    normalise: str = "truth",
    merged: Sequence[str] = (),
) -> DataFrame:
    """Percent of true class x predicted as y, one row per true class and one column per prediction.

    A column that nothing was predicted into reads "Not predicted" in predicted normalisation. The
    rows are reduced to at most len(classes)^2 counts before any normalisation.
    """
    names = [c for c in classes if c not in merged] + (["UnifiedOthers"] if merged else [])
    cells = (
        df.select(
            merge_classes(F.col(truth), merged).alias("truth"),
            merge_classes(F.col(predicted), merged).alias("_p"),
        )
        .groupBy("truth")
        .pivot("_p", names)
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )
    everything = Window.partitionBy()  # one row per class
    row_total = sum((F.col(f"`{n}`") for n in names[1:]), F.col(f"`{names[0]}`"))

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        total = F.sum(value).over(everything) if normalise == "predicted" else row_total
        text = F.format_string("%.2f", 100.0 * value / total)
        return F.when(total > 0, text).otherwise("Not predicted").alias(name)

    return cells.select("truth", *[cell(n) for n in names])


def confusion_weighted(
    df: DataFrame, truth: str, predicted: str, balanced: bool = True, normalise: str = "truth"
) -> DataFrame:
    """Long confusion table with optional class balancing: proportion, its variance and error.

    Balanced weights are 1 / class size, so a class contributes total weight one. All figures follow
    from the plain cell counts, so the rows are only counted once and never re-weighted one by one.
    """
    cells = df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    truth_n = F.sum("n").over(Window.partitionBy(truth))  # windows over class pairs only
    weight = F.col("n") / truth_n if balanced else F.col("n").cast("double")
    weighted = cells.withColumn("weight", weight)
    side = predicted if normalise == "predicted" else truth
    total = F.sum("weight").over(Window.partitionBy(side))
    share = F.col("weight") / total
    variance = share * (1.0 - share) / total
    return weighted.select(
        truth,
        predicted,
        "n",
        share.alias("share"),
        variance.alias("variance"),
        F.sqrt(variance).alias("error"),
    )


def mask_counts(df: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    """Surviving rows per named mask, one pass for all masks."""
    return df.agg(*[F.sum(F.coalesce(m, F.lit(False)).cast("long")).alias(n) for n, m in masks.items()])


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score: class counts at and strictly below it (exact, range-bucketed).

    A row whose score is missing or not a number has no rank and is left out.
    """
    df = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    edges = value_edges(df, score)
    counted = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum((F.col(label) == 1).cast("long")).alias("pos"),
        F.sum((F.col(label) == 0).cast("long")).alias("neg"),
    )
    return running_sums(counted, "score", ["pos", "neg"], edges)


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """False and true positive rates when everything at or above a score is called positive.

    The curve begins at (0, 0), where nothing is: that row has no score.
    """
    points = roc_points(df, score, label)
    rates = {
        out: F.try_divide((F.col(f"{c}_total") - F.col(f"{c}_before")).cast("double"), F.col(f"{c}_total"))
        for out, c in (("fpr", "neg"), ("tpr", "pos"))
    }
    start = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "score double, fpr double, tpr double")
    return points.select("score", *[rate.alias(name) for name, rate in rates.items()]).union(start)


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Exact area under the ROC curve: concordant pairs plus half of the ties."""
    points = roc_points(df, score, label)
    pairs = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + 0.5 * F.col("neg")))
    return points.agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"),
    )


def tagging_performance(
    df: DataFrame,
    decision: str,
    mistag: str,
    flavour: str,
    weight: str | None = None,
    by: Iterable[str] = (),
    sums: bool = False,
) -> DataFrame:
    """Efficiency, mistag rate, effective mistag and tagging power with errors."""
    by = list(by)
    w = F.col(weight) if weight else None
    added = df.groupBy(*by).agg(
        *perf.performance_sums(F.col(decision), F.col(mistag), F.col(flavour), w)
    )
    figures = [c.alias(n) for n, c in perf.performance_columns().items()]
    kept = list(perf.SUMS) if sums else ["n", "n_tagged"]
    return added.select(*by, *kept, *figures)


def bucket_of(value: str, edges: Sequence[float]) -> Column:
    """Half-open bin number for ascending edges, NULL outside."""
    x, chain = F.col(value), F
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        chain = chain.when((x >= low) & (x < high), i)
    return chain


def binned_performance(
    df: DataFrame,
    value: str,
    edges: Sequence[float],
    decision: str,
    mistag: str,
    flavour: str,
    weight: str | None = None,
    by: Iterable[str] = (),
    overall: bool = False,
) -> DataFrame:
    """Performance per kinematic bin; ``overall`` adds a row with bin -1 for the whole sample.

    Bin rows and the overall row come from the same scan: the additive sums are aggregated per bin
    once and rolled up from there.
    """
    binned = df.withColumn("bin", F.coalesce(bucket_of(value, edges), F.lit(-2)))
    return rolled_up_performance(binned, "bin", decision, mistag, flavour, weight, by, overall)


def rolled_up_performance(
    df: DataFrame,
    bin_column: str,
    decision: str,
    mistag: str,
    flavour: str,
    weight: str | None = None,
    by: Iterable[str] = (),
    overall: bool = True,
) -> DataFrame:
    """Performance per value of a bin column; bin -2 (outside) counts only towards the whole."""
    by, w = list(by), F.col(weight) if weight else None
    sums = perf.performance_sums(F.col(decision), F.col(mistag), F.col(flavour), w)
    parts = df.groupBy(*by, F.col(bin_column).alias("bin")).agg(*sums)
    if overall:
        parts = parts.withColumn("bin", F.explode(F.array(F.col("bin"), F.lit(-1))))
        parts = parts.groupBy(*by, "bin").agg(*[F.sum(s).alias(s) for s in perf.SUMS])
    figures = [c.alias(n) for n, c in perf.performance_columns().items()]
    return parts.filter("bin > -2").select(*by, "bin", "n", "n_tagged", *figures)


def trend_deviation(
    binned: DataFrame, metric: str, error: str, by: Iterable[str] = (), scale: float = 100.0
) -> DataFrame:
    """Deviation of every bin from the overall row (bin -1), plain and in units of its error.

    Bin and whole are fully correlated, so the error of the difference is |error - overall error|.
    The overall row reaches its bins by a window over the handful of bin rows.
    """
    by = list(by)
    group = Window.partitionBy(*by)

    def overall(c: str) -> Column:
        return F.max(F.when(F.col("bin") == -1, F.col(c))).over(group)

    deviation = scale * (F.col(metric) - overall(metric))
    deviation_err = scale * F.abs(F.col(error) - overall(error))
    return (
        binned.select(
            *by,
            "bin",
            (scale * F.col(metric)).alias("value"),
            deviation.alias("deviation"),
            deviation_err.alias("deviation_err"),
            F.try_divide(deviation, deviation_err).alias("deviation_normed"),
        )
        .filter("bin >= 0")
    )


def combine_errors(df: DataFrame, value: str, errors: Sequence[str], scale: float = 100.0) -> DataFrame:
    """Scaled value and quadratic error sum, plus both rounded to one significant error digit.

    NaN as soon as any input is missing or not finite.
    """
    columns = [F.col(value), *[F.col(e) for e in errors]]
    usable = columns[0].isNotNull()
    for column in columns:
        usable = usable & finite(column)
    nan = F.lit(float("nan"))
    total = columns[1] * columns[1]
    for column in columns[2:]:
        total = total + column * column
    scaled = F.when(usable, scale * columns[0]).otherwise(nan)
    error = F.when(usable, scale * F.sqrt(total)).otherwise(nan)
    with_error = df.withColumns({"value_scaled": scaled, "error_scaled": error})
    first = round_to(F.col("error_scaled"), error_digits(F.col("error_scaled")))
    with_digit = with_error.withColumn(
        "error_rounded", F.when(usable & (F.col("error_scaled") > 0), first).otherwise(nan)
    )
    rounded = round_to(F.col("value_scaled"), error_digits(F.col("error_rounded")))
    return with_digit.withColumn(
        "value_rounded", F.when(usable & (F.col("error_rounded") > 0), rounded).otherwise(nan)
    )


def effective_yield(
    df: DataFrame, signal_yield: str, luminosity: str, power: str, power_err: str, luminosity_rel: str
) -> DataFrame:
    """Yield per luminosity times power, with its relative error added in quadrature."""
    effective = F.try_divide(F.col(signal_yield), F.col(luminosity)) * F.col(power)
    relative = F.sqrt(
        F.pow(F.try_divide(F.col(power_err), F.col(power)), 2.0) + F.pow(F.col(luminosity_rel), 2.0)
    )
    return df.withColumns({"neff_per_lumi": effective, "neff_per_lumi_err": effective * relative})


def sum_of_taggers(df: DataFrame, power: str, combined: str | None = None, by: Iterable[str] = ()) -> DataFrame:
    """Sum of single-tagger powers, next to the combined power when given."""
    sums = [F.sum(power).alias("sum_power")]
    if combined:
        sums.append(F.max(combined).alias("combined_power"))
    return df.groupBy(*by).agg(*sums)


def seed_spread(
    results: DataFrame, seed: str, value: str, error: str, fixed: Mapping[str, object]
) -> DataFrame:
    """Best figure per seed at fixed hyper-parameters."""
    chosen = results
    for name, wanted in fixed.items():
        chosen = chosen.filter(F.col(name) == F.lit(wanted))
    return chosen.groupBy(seed).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg(error).alias("mean_error")
    )


def pivot_heatmap(
    results: DataFrame, rows: str, columns: str, values: Sequence, metric: str
) -> DataFrame:
    """Row axis x column axis table of the best metric with the global colour range."""
    wide = results.groupBy(rows).pivot(columns, list(values)).agg(F.max(metric))
    wide = wide.withColumnsRenamed({str(v): f"{columns}_{v}" for v in values})
    cells = [F.col(c) for c in wide.columns if c != rows]
    everything = Window.partitionBy()  # one row per value of the row axis
    return wide.withColumns(
        {
            "vmin": F.min(F.least(*cells) if len(cells) > 1 else cells[0]).over(everything),
            "vmax": F.max(F.greatest(*cells) if len(cells) > 1 else cells[0]).over(everything),
        }
    )


def best_candidate(
    results: DataFrame,
    by: Iterable[str],
    value: str,
    error: str,
    maximise: str = "nominal",
    ties: Iterable[str] = (),
) -> DataFrame:
    """Best result per tagger by nominal value or by value over error; NaN and zero are skipped."""
    usable = results.filter(
        finite(F.col(value)) & finite(F.col(error)) & (F.col(value) != 0) & (F.col(error) != 0)
    ).withColumns({"ratio": F.col(value) / F.col(error), "precision": F.col(error) / F.col(value)})
    goal = value if maximise == "nominal" else "ratio"
    window = Window.partitionBy(*by).orderBy(F.desc(goal), *ties)
    return usable.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
