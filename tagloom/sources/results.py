"""Nested JSON result files whose keys are partly in their paths."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Path parts of the hyper-parameter scan (name to pattern and type).
SCAN_PATH_KEYS = {
    "seed": (r"/(\d+)/lr", "int"),
    "learning_rate": (r"/lr([0-9.e+-]+)_", "double"),
    "batch_size": (r"_bs(\d+)_", "int"),
    "numlayers": (r"_nL(\d+)_", "int"),
    "numneurons": (r"_nN(\d+)/", "int"),
    "npar": (r"calibration_npar(\d+)", "int"),
    "function": (r"taggingInfo_([A-Za-z0-9_]+)\.json", "string"),
}

FIGURE = T.ArrayType(T.DoubleType())
FIGURES = ("tag_efficiency", "mistag_rate", "effective_mistag", "tagging_power")
_BLOCK = T.StructType([T.StructField(f, FIGURE) for f in FIGURES])
CALIBRATION_SCHEMA = T.StructType(
    [
        T.StructField("stats", T.StructType([T.StructField(n, T.DoubleType()) for n in ("N", "Nt", "Neff", "Nw", "Nwt")])),
        T.StructField("uncalibrated", T.StructType([T.StructField("selected", _BLOCK)])),
        T.StructField("calibrated", T.StructType([T.StructField("selected", _BLOCK)])),
    ]
)


def scan_results(
    spark: SparkSession,
    paths: str | list[str],
    schema: str | T.StructType,
    path_keys: Mapping[str, tuple[str, str]] = SCAN_PATH_KEYS,
    multi_line: bool = True,
) -> DataFrame:
    """One row per result file (or line), with typed columns taken from the path by pattern.

    The schema is given, so files lacking a field yield NULL instead of an error, and listing is the
    only driver-side work.
    """
    df = spark.read.schema(schema).option("multiLine", str(multi_line).lower()).option("recursiveFileLookup", "true").json(paths)
    path = F.col("_metadata.file_path")
    keys = [
        F.nullif(F.regexp_extract(path, pattern, 1), F.lit("")).cast(kind).alias(name)
        for name, (pattern, kind) in path_keys.items()
    ]
    return df.select(*keys, *df.columns)


def figure(column: Column) -> tuple[Column, Column]:
    """Value and quadratic error sum of a [value, error, ...] array; NULL when too short."""
    errors = F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0)))
    squared = F.aggregate(errors, F.lit(0.0), lambda total, e: total + e * e)
    usable = F.size(column) >= 2
    return F.when(usable, column.getItem(0)), F.when(usable, F.sqrt(squared))


def selected_figures(df: DataFrame, block: str = "calibrated") -> DataFrame:
    """Flatten the selected figures of a calibration result: <figure> and <figure>_err columns."""
    made = {}
    for name in FIGURES:
        value, error = figure(F.col(f"{block}.selected.{name}"))
        made[name], made[f"{name}_err"] = value, error
    return df.withColumns(made)


_PARAMETER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("error", T.DoubleType())])
_STYLE = T.StructType(
    [
        T.StructField("params", T.ArrayType(_PARAMETER)),
        T.StructField("cov_param_order", T.ArrayType(T.StringType())),
        T.StructField("cov", T.ArrayType(FIGURE)),
    ]
)
_COUNTS = [T.StructField(n, T.LongType()) for n in ("N", "Nt")] + [T.StructField(n, T.DoubleType()) for n in ("Neff", "Nw", "Nwt")]
_SELECTED = T.StructType([T.StructField("selected", _BLOCK), T.StructField("overall", _BLOCK)])
#: A tagger's whole calibration result; every part may be missing.
NESTED_SCHEMA = T.StructType(
    [
        T.StructField("tagger", T.StringType()),
        T.StructField("polynomial", T.StructType([T.StructField("degree", T.IntegerType()), T.StructField("link", T.StringType()), T.StructField("centre", T.DoubleType())])),
        T.StructField("osc", T.StructType([T.StructField("DeltaM", T.DoubleType()), T.StructField("DeltaGamma", T.DoubleType()), T.StructField("Aprod", T.DoubleType())])),
        T.StructField(
            "calibration",
            T.StructType([T.StructField("likelihood", T.StringType()), T.StructField("avg_eta", T.DoubleType()), T.StructField("flavour_style", _STYLE), T.StructField("delta_style", _STYLE)]),
        ),
        T.StructField("stats", T.StructType(_COUNTS)),
        T.StructField("uncalibrated", _SELECTED),
        T.StructField("calibrated", _SELECTED),
    ]
)


def _style(names: list[str], values: Column, cov: Column) -> Column:
    """Parameters with errors, their order and covariance; ``cov`` is an array of rows."""
    fitted = F.transform(F.array(*[F.lit(n) for n in names]), lambda n, i: F.struct(n.alias("name"), F.get(values, i).alias("value"), F.sqrt(F.get(F.get(cov, i), i)).alias("error")))
    return F.when(values.isNotNull(), F.struct(fitted.alias("params"), F.array(*[F.lit(n) for n in names]).alias("cov_param_order"), cov.alias("cov")))


def _rows(flat: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(flat, i * n + 1, F.lit(n)))


def _beside(first: Column, second: Column, n: int) -> Column:
    """Block matrix of two n x n matrices, zero off the blocks."""
    zeros = F.array_repeat(F.lit(0.0), n)
    return F.concat(F.transform(_rows(first, n), lambda r: F.concat(r, zeros)), F.transform(_rows(second, n), lambda r: F.concat(zeros, r)))


def nested_results(parameters: DataFrame, before: DataFrame, after: DataFrame, tagger: str, npar: int) -> DataFrame:
    """One row of ``NESTED_SCHEMA`` per tagger.

    ``parameters`` is a table of group calibrations by ``tagger``; ``before`` and ``after`` hold performance figures of the same
    taggers, ``after`` with the errors from the calibration. A tagger without a fit or without figures has missing parts.
    """
    span = range(npar)
    both = F.concat("plus", "minus")
    pairs = F.arrays_zip("plus", "minus")
    delta = F.concat(F.transform(pairs, lambda p: (p["plus"] + p["minus"]) / 2.0), F.transform(pairs, lambda p: p["plus"] - p["minus"]))
    covs = F.arrays_zip("plus_cov", "minus_cov")
    total = F.transform(covs, lambda c: c["plus_cov"] + c["minus_cov"])
    less = F.transform(covs, lambda c: (c["plus_cov"] - c["minus_cov"]) / 2.0)
    upper = F.zip_with(_rows(F.transform(total, lambda x: x / 4.0), npar), _rows(less, npar), lambda a, b: F.concat(a, b))
    lower = F.zip_with(_rows(less, npar), _rows(total, npar), lambda a, b: F.concat(a, b))
    fit = parameters.select(
        F.col(tagger).alias("tagger"),
        F.struct(F.lit(npar).alias("degree"), F.col("link"), F.col("centre")).alias("polynomial"),
        F.struct(
            F.lit("prod_flav_based").alias("likelihood"), F.col("mean_eta").alias("avg_eta"),
            _style([f"p{k}{s}" for s in "+-" for k in span], both, _beside(F.col("plus_cov"), F.col("minus_cov"), npar)).alias("flavour_style"),
            _style([f"p{k}" for k in span] + [f"Dp{k}" for k in span], delta, F.concat(upper, lower)).alias("delta_style"),
        ).alias("calibration"),
    )

    def block(prefix: str, cal: bool) -> Column:
        figures = []
        for name in FIGURES:
            extra = [F.col(f"{prefix}{name}_cal_err")] if cal and name in ("effective_mistag", "tagging_power") else []
            figures.append(F.array(F.col(f"{prefix}{name}"), F.col(f"{prefix}{name}_err"), *extra).alias(name))
        return F.when(F.col(f"{prefix}n").isNotNull(), F.struct(F.struct(*figures).alias("selected")))

    named = lambda df, prefix: df.select(F.col(tagger).alias("_t"), *[F.col(c).alias(prefix + c) for c in df.columns if c != tagger])
    joined = fit
    for table, prefix in ((before, "_b_"), (after, "_a_")):
        side = named(table, prefix)
        joined = joined.join(side, F.col("tagger").eqNullSafe(F.col("_t")), "left").drop("_t")
    counts = F.when(F.col("_b_n").isNotNull(), F.struct(F.col("_b_n").alias("N"), F.col("_b_n_tagged").alias("Nt"), F.col("_b_n_eff").alias("Neff")))
    made = joined.select("tagger", "polynomial", "calibration", counts.alias("stats"), block("_b_", False).alias("uncalibrated"), block("_a_", True).alias("calibrated"))
    return made.select(*[_as(made, f).alias(f.name) for f in NESTED_SCHEMA.fields])


def _as(df: DataFrame, field: T.StructField) -> Column:
    """The column in the schema's shape: parts that it lacks are missing."""

    def fit(column: Column, have: T.DataType, want: T.DataType) -> Column:
        if not (isinstance(have, T.StructType) and isinstance(want, T.StructType)):
            return column.cast(want)
        known = {f.name: f.dataType for f in have.fields}
        parts = [(fit(column.getField(f.name), known[f.name], f.dataType) if f.name in known else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*parts))

    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    return fit(F.col(field.name), df.schema[field.name].dataType, field.dataType)


def write_nested(df: DataFrame, path: str) -> None:
    """One JSON document per row below ``path``; missing parts are left out."""
    df.write.json(path)


def read_nested(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Documents as written by ``write_nested``; parts that a document lacks are missing."""
    return spark.read.schema(NESTED_SCHEMA).option("recursiveFileLookup", "true").json(path)
