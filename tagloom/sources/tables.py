"""Columnar scans, multi-file scans and flattening of nested events."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators.events import event_key


def scan_columns(spark: SparkSession, path: str | Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Named columns of one table; the projection reaches the file scan."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths).select(*columns)


def scan_many(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Iterable[str] | None = None,
    file_tag: str = "sample",
    tag_pattern: str = r"([^/]+?)(?:\.[A-Za-z0-9]+)*$",
    merge: bool = False,
) -> DataFrame:
    """A glob or a list of files as one table, each row tagged from its file name.

    The tag is stable across tables and re-runs, unlike a position in a directory listing. ``merge``
    unites differing schemas, missing columns become NULL.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    df = spark.read.option("mergeSchema", str(merge).lower()).parquet(*listed)
    wanted = [F.col(c) for c in columns] if columns is not None else [F.col(c) for c in df.columns]
    tag = F.regexp_extract(F.col("_metadata.file_name"), tag_pattern, 1)
    return df.select(*wanted, tag.alias(file_tag))


def flatten(
    df: DataFrame, arrays: Sequence[str], keep: Iterable[str] | None = None, subentry: str = "subentry"
) -> DataFrame:
    """Event rows with parallel track arrays to track rows; scalars repeat, position is kept.

    A single array of structs is unpacked to its fields. Events without tracks disappear, as they
    hold no track row.
    """
    scalars = list(keep) if keep is not None else [c for c in df.columns if c not in arrays]
    if len(arrays) == 1:
        name = arrays[0]
        exploded = df.select(*scalars, F.posexplode(name).alias(subentry, "_t"))
        fields = df.schema[name].dataType.elementType
        unpack = ["_t.*"] if fields.typeName() == "struct" else [F.col("_t").alias(name)]
        return exploded.select(*scalars, subentry, *unpack)
    exploded = df.select(*scalars, F.posexplode(F.arrays_zip(*arrays)).alias(subentry, "_t"))
    return exploded.select(*scalars, subentry, *[F.col(f"_t.{a}").alias(a) for a in arrays])


def without_file(spark: SparkSession, paths: str | Sequence[str], reserved: str, enabled: bool = True, **options) -> DataFrame:
    """Multi-file scan that leaves out one reserved file (the hold-out sample)."""
    df = scan_many(spark, paths, **options)
    tag = options.get("file_tag", "sample")
    return df.filter(F.col(tag) != reserved) if enabled else df


def keyed_events(spark: SparkSession, path: str, pattern: str, run: str, event: str, out: str = "key") -> DataFrame:
    """Event tables of several files, each row with the key ``<file key>_<run>_<event>``.

    The file key is what ``pattern``'s first group finds in a file's path, so it does not change when files are added or listed in
    another order. A file whose path has no key is an error: its events could meet those of another file.
    """
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    found = F.regexp_extract("_metadata.file_path", pattern, 1)
    named = F.when(found != "", found).otherwise(F.raise_error(F.lit(f"no file key by {pattern} in a path below {path}")))
    return df.select("*", event_key(named, F.col(run), F.col(event)).alias(out))
