"""Combining tables of several taggers and other keyed attachments."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outer_join_taggers(
    taggers: Mapping[str, DataFrame],
    key: str,
    shared: Iterable[str] = (),
    columns: Sequence[str] = ("d", "eta"),
    order: Iterable[str] = (),
) -> DataFrame:
    """Full outer equi-join of per-tagger event tables, one output row per event key.

    Columns ``d, eta`` of tagger T come out as ``T_d, T_eta``; ``shared`` columns are taken from
    whichever tagger has the event. Instead of N-1 joins (each of which would re-shuffle the merged
    side, because a coalesced key loses its partitioning) the tables are stacked and folded by key in
    one aggregation, which shuffles every table once and combines map-side.

    Without ``order`` every table must hold one row per event (as left by the best-track reduction),
    which the fold, a plain hash aggregation, checks. With ``order`` a tagger that lists an event more than
    once contributes its first row in that order. A row without an event key has no partner and stays by itself.
    """
    shared, order = list(shared), list(order)
    stacked = None
    for name, table in taggers.items():
        row = table.select(
            key,
            *shared,
            F.lit(name).alias("_tagger"),
            *dict.fromkeys([*order, *columns]),
        )
        stacked = row if stacked is None else stacked.unionByName(row)
    if not order:
        return widen_taggers(stacked, key, "_tagger", list(taggers), shared, columns)
    stacked, alone = _apart(stacked, key)
    row = F.struct(*[F.col(c) for c in dict.fromkeys([*order, *columns])])
    firsts = [F.min(F.when(F.col("_tagger") == name, row)).alias(f"_{name}") for name in taggers]
    folded = stacked.groupBy(key, alone).agg(*[F.max(c).alias(c) for c in shared], *firsts)
    return folded.select(
        key,
        *shared,
        *[F.col(f"_{name}.{c}").alias(f"{name}_{c}") for name in taggers for c in columns],
    )


def widen_taggers(
    long: DataFrame,
    key: str,
    tagger: str,
    names: Sequence[str],
    shared: Iterable[str] = (),
    columns: Sequence[str] = ("d", "eta"),
) -> DataFrame:
    """Long (event, tagger) rows, unique per pair, to one row per event with a column set per tagger.

    A pair that occurs twice is an error: its columns would be taken from different rows. A row without an event
    key stays by itself.
    """
    long, alone = _apart(long, key)
    counts = [F.count_if(F.col(tagger) == name).alias(f"_n_{i}") for i, name in enumerate(names)]
    wide = long.groupBy(key, alone).agg(
        *[F.max(c).alias(c) for c in shared],
        *[F.max(F.when(F.col(tagger) == name, F.col(c))).alias(f"{name}_{c}") for name in names for c in columns],
        *counts,
    )
    most = F.greatest(*[F.col(f"_n_{i}") for i in range(len(names))], F.lit(0))
    failure = F.raise_error(F.lit("widen_taggers: several rows of one event and tagger")).cast("boolean")
    checked = wide.filter(F.when(most <= 1, F.lit(True)).otherwise(failure))
    return checked.select(key, *shared, *[f"{name}_{c}" for name in names for c in columns])


def _apart(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A grouping column that keeps rows without a key apart from each other."""
    number = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_alone", number), "_alone"


def keep_listed(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key occurs in the list."""
    return df.join(keys, on, "left_semi")


def attach_by_key(df: DataFrame, extra: DataFrame, on: str | list[str], check: bool = True) -> DataFrame:
    """Attach columns (e.g. weights) by key; rows are neither lost nor multiplied.

    A key that ``extra`` lists twice is an error; so is, when checked, a row without a partner.
    """
    on = [on] if isinstance(on, str) else list(on)
    added = [c for c in extra.columns if c not in on]
    twice = F.raise_error(F.lit("attach_by_key: key listed twice")).cast("boolean")
    single = extra.groupBy(*on).agg(*[F.first(c).alias(c) for c in added], F.count(F.lit(1)).alias("_n"))
    single = single.withColumn("_hit", F.when(F.col("_n") == 1, F.lit(True)).otherwise(twice)).drop("_n")
    joined = df.join(single, on, "left")
    if check:
        failure = F.raise_error(F.lit("attach_by_key: row without partner")).cast("boolean")
        joined = joined.filter(F.when(F.col("_hit"), F.lit(True)).otherwise(failure))
    return joined.select(*df.columns, *added)


def parameter_grid(df: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of configured axis values, from array literals (no join)."""
    grid = df.sparkSession.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid.drop("id")


def missing_grid_points(observed: DataFrame, axes: Mapping[str, Sequence]) -> DataFrame:
    """Configured combinations for which no result exists."""
    names = list(axes)
    seen = observed.select(*names).distinct()
    return parameter_grid(observed, axes).join(seen, names, "left_anti")


def mask_overlap(df: DataFrame, first, second) -> DataFrame:
    """Rows in only one of two masks and in both, and whether the masks are the same."""
    a, b = F.coalesce(first, F.lit(False)), F.coalesce(second, F.lit(False))
    only_a, only_b = F.sum((a & ~b).cast("long")), F.sum((b & ~a).cast("long"))
    return df.agg(
        only_a.alias("only_first"),
        only_b.alias("only_second"),
        F.sum((a & b).cast("long")).alias("both"),
        ((only_a + only_b) == 0).alias("equivalent"),
    )


def concat_tables(tables: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Bag union by column name."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=allow_missing)
    return out
