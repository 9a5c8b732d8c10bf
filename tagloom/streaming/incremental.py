"""File-source streams over the same operators.

Only operators that need no whole event from several rows are used row-wise; event-level minima run
on nested events (see ``operators.events.min_abs_nested``). Sinks and checkpoints live in the shared
folder, so a lost executor or a restarted driver continues from the last committed batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import performance as perf


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files below ``path``; ``glob`` restricts the file names.

    ``files_per_batch`` limits the rate of a live stream. A replay of history must not set it: between batches
    the watermark moves, and rows of later files that are older than it would be late.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def run_available(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process everything that has arrived, append it to a Parquet table, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", output)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def incremental_features(stream: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stateless derived columns on a stream; ``derive`` must not aggregate or join."""
    return derive(stream)


def dedupe_events(stream: DataFrame, keys: Iterable[str], time: str, delay: str) -> DataFrame:
    """First row per event key among rows less than ``delay`` apart; state expires with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_performance(
    stream: DataFrame, time: str, delay: str, width: str, decision: str, mistag: str, flavour: str, weight: str | None = None
) -> DataFrame:
    """Tagging performance per tumbling window, emitted once a window is closed by the watermark.

    State per window is the nine additive sums, whatever the number of rows.
    """
    w = F.col(weight) if weight else None
    sums = perf.performance_sums(F.col(decision), F.col(mistag), F.col(flavour), w)
    grouped = stream.withWatermark(time, delay).groupBy(F.window(time, width)).agg(*sums)
    return _window_figures(grouped)


#: The sums in a window's state, in their order; without weights the squared ones are the plain ones and are kept once.
_STATE = [("n", "bigint"), ("n_tagged", "bigint"), *[(name, "double") for name in perf.SUMS[2:]]]
_UNWEIGHTED = {"sum_w2": "sum_w", "sum_w2_tagged": "sum_w_tagged"}


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Figures of the windows that ``windowed_performance`` has not emitted yet, from the state below its ``checkpoint``.

    What the stream wrote and this cover every window once; the rows themselves are not read again.
    """
    state = spark.read.format("statestore").load(checkpoint)
    held = len(state.schema["value"].dataType.fields)
    names = [(n, kind) for n, kind in _STATE if held == len(_STATE) or n not in _UNWEIGHTED]
    if held != len(names):
        raise ValueError(f"the state below {checkpoint} has {held} sums, not those of a windowed performance")
    sums = F.col("value").cast("struct<" + ",".join(f"{n}:{kind}" for n, kind in names) + ">")
    rows = state.select("key.window", sums.alias("s")).select("window", "s.*")
    return _window_figures(rows.withColumns({n: F.col(same) for n, same in _UNWEIGHTED.items() if n not in rows.columns}))


def _window_figures(grouped: DataFrame) -> DataFrame:
    figures = [c.alias(n) for n, c in perf.performance_columns().items()]
    return grouped.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n", "n_tagged", *figures
    )
