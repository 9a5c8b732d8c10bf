"""Intermediate tables in the shared folder, and small helpers common to the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.session import shared_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing.

    Reading it back also gives Catalyst the true size, so that it broadcasts only what is small.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """True for keys whose crc32 as text leaves ``remainder``; a null key is never held out."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "utf-8")) % modulus == remainder, F.lit(False))


def values(column: pa.Array) -> Iterator:
    """Python values one at a time: a batch of long texts is never unpacked as a whole."""
    return (x.as_py() for x in column)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches one by one; what Arrow still holds of the last one goes back to the system, as workers live on between stages."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: int, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts hold about ``max_bytes`` (one long text: alone)."""
    texts, start, held = batch.column(column), 0, 0
    for i in range(batch.num_rows):
        size = texts[i].as_buffer().size if texts[i].is_valid else 0
        if held and held + size > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


#: Rows of a few numbers that may be broadcast; some tens of MB in an executor.
MOST_BROADCAST_ROWS = 1_000_000


def small_or_shuffled(table: DataFrame) -> DataFrame:
    """A written table of a few numeric columns, marked for broadcast if its counted rows are within the bound.

    Beyond the bound it comes back as it is, and the same join runs by shuffle.
    """
    return F.broadcast(table) if table.count() <= MOST_BROADCAST_ROWS else table
