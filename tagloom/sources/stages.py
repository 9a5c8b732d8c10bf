"""Stage tables between processing steps: partitioned, restartable, reusable."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_stage(df: DataFrame, root: str, labels: Mapping[str, str]) -> None:
    """Write a stage below directories named by its labels (decay=.../tagger=.../...).

    Re-writing one label combination replaces only its own directories.
    """
    labelled = df.withColumns({k: F.lit(v) for k, v in labels.items()})
    (
        labelled.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*labels)
        .parquet(root)
    )


def read_stage(spark: SparkSession, root: str, **labels: str) -> DataFrame:
    """Rows of the matching stage tables; labels prune directories before any file is opened."""
    df = spark.read.parquet(root)
    for name, value in labels.items():
        df = df.filter(F.col(name) == value)
    return df


def append_in_chunks(df: DataFrame, key: str, chunks: int, path: str, batch: str) -> None:
    """Process a table in ``chunks`` equal key ranges, appending each to one output table.

    ``batch`` names what is appended (an input file, a run): another batch adds rows and a repeated one replaces its own. All
    chunks run in one parallel job; rows are ranged by key, so a chunk is written by few tasks. A row without a key is in the
    chunk -1. Rows are written to a folder of their own and then published by one entry of the table's manifest, so readers by
    ``read_batches`` see all of a batch or none; a run that dies before leaves the earlier rows as they were.
    """
    version = write_chunks(df, key, chunks, path, batch)
    publish(df.sparkSession, path, batch, version)


def write_chunks(df: DataFrame, key: str, chunks: int, path: str, batch: str) -> str:
    """Write a batch without publishing it; returns the version to publish."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    lo, hi = (ends["lo"], ends["hi"]) if ends["lo"] is not None else (0, 0)
    step = max(-(-(hi - lo + 1) // chunks), 1)
    chunk = F.coalesce(F.floor((F.col(key) - F.lit(lo)) / F.lit(step)).cast("int"), F.lit(-1))
    version = f"batch={batch}/version={uuid.uuid4().hex}"
    ranged = df.withColumn("chunk", chunk).repartitionByRange("chunk", key)
    ranged.write.partitionBy("chunk").parquet(f"{path.rstrip('/')}/{version}")
    return version


MANIFEST = "batch string, version string, number bigint"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    folder = f"{path.rstrip('/')}/_manifest"
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(folder)


def publish(spark: SparkSession, path: str, batch: str, version: str) -> None:
    """Make a written version the batch's present one: one small file, put in place by a single commit."""
    last = _manifest(spark, path).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    entry = spark.createDataFrame([(batch, version, last + 1)], MANIFEST)
    entry.coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/_manifest")


def read_batches(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Rows of the published batches, the latest version of each, with ``batch`` and ``chunk``; none published: no rows."""
    entries = _manifest(spark, path).groupBy("batch").agg(F.max_by("version", F.struct("number", "version")).alias("version")).collect()
    root = path.rstrip("/")
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*fields.fields, T.StructField("batch", T.StringType()), T.StructField("chunk", T.IntegerType())])
    if not entries:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", root).parquet(*[f"{root}/{e['version']}" for e in entries]).select(*whole.names)


def _complete(spark: SparkSession, root: str) -> bool:
    """Whether a finished job has written ``root``: a job that broke off leaves no marker."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def cached_sets(
    spark: SparkSession, root: str, build: Callable[[], DataFrame], subset: str = "subset", overwrite: bool = False
) -> DataFrame:
    """Train, validation and test sets on disk (zstd); built only if absent or on request."""
    if not overwrite and _complete(spark, root):
        return spark.read.parquet(root)
    build().write.mode("overwrite").option("compression", "zstd").partitionBy(subset).parquet(root)
    return spark.read.parquet(root)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """CSV set with an explicit schema (no inference pass)."""
    return spark.read.schema(schema).option("header", "true").csv(path)
