"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


# Wide projections (dozens of derived columns) compile to methods above HotSpot's 8000-byte limit for
# just-in-time compilation and would run interpreted; past this size Spark falls back to split,
# compilable projections. Recommended for cluster sessions too.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "tagloom", cores: int | str = "*") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    partitions = "8" if cores == "*" else str(max(int(cores), 2))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for name, value in RECOMMENDED.items():
        builder = builder.config(name, value)
    return (
        builder.config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new, empty location below the folder the cluster names in ``spark.checkpoint.dir``.

    Without that setting the warehouse serves if it lies in a store that all machines reach. Only a
    local session (tests, a laptop) falls back to a temporary folder, remembered for the session; on a
    cluster every machine would write to a disk of its own, so there it is an error.
    """
    context = spark.sparkContext
    base = shared_root(
        context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir(),
        spark.conf.get("spark.sql.warehouse.dir"),
        context.master,
    )
    if base is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def shared_root(checkpoints: str | None, warehouse: str | None, master: str) -> str | None:
    """The folder for written intermediates; None: a local session may use its own disk."""
    if checkpoints:
        return checkpoints
    if warehouse and urlparse(warehouse).scheme not in ("", "file"):
        return f"{warehouse.rstrip('/')}/_tagloom"
    if master == "local" or master.startswith("local["):
        return None
    raise ValueError("set spark.checkpoint.dir to a folder that all machines share")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, however often it is used and whatever machine is lost."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local_table(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A small driver-side table as a local relation.

    Arrow tables below the session's local-relation threshold need no job to read and carry their
    exact size, so Catalyst can broadcast them from the start.
    """
    return spark.createDataFrame(table)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for repeated work on a narrow input that arrives in fewer partitions than cores.

    Inputs of cluster size already have more partitions than cores and pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
