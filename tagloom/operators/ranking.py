"""Distributed order statistics: selection, running sums and ranks without a global sort task.

A window without a partition key, or one keyed by a few classes, would pull most of the table into
single tasks. The operators here first aggregate counts into a bounded number of buckets, turn those
counts into offsets, and only look at single rows inside one bucket.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from itertools import accumulate

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.session import local_table, stored


MAX_LOCAL_ROWS = 10_000


def order_hash(keys: Iterable[str], seed: int | str) -> Column:
    """Text that orders rows pseudo-randomly and identically on every run and engine."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("_", *parts, F.lit(str(seed))))


def bounded_local(df: DataFrame, limit: int = MAX_LOCAL_ROWS) -> DataFrame:
    """The rows of a small table as a local relation, or ``df`` itself if it has more than ``limit``.

    A local relation has an exactly known size, so Catalyst broadcasts it by its own threshold; a
    larger table keeps its distributed plan and is joined by shuffle.
    """
    table = df.limit(limit + 1).toArrow()
    return local_table(df.sparkSession, table) if table.num_rows <= limit else df


def join_null_safe(df: DataFrame, other: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Inner join in which a missing key equals a missing key, so that no row of ``df`` is lost."""
    keys = list(keys)
    renamed = other.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_key_{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, same).drop(*[f"_key_{i}" for i in range(len(keys))])


def hash_cut_points(
    df: DataFrame,
    hash_col: str,
    sizes: Mapping[str, Column],
    by: Iterable[str] = (),
    scope: Iterable[str] = (),
    digits: int = 3,
) -> DataFrame:
    """The k-th smallest hash per class: rows ``(by..., cut, cut_hash)``.

    ``sizes`` maps a cut name to k, an expression over ``group_size`` (rows of the class) and
    ``smallest_group`` (rows of the smallest class within ``scope``). "Take k rows in hash order"
    then becomes the row predicate ``hash <= cut_hash``, needing neither a sort nor a shuffle.

    The counting pass groups by the first ``digits`` hex digits (at most 16**digits groups per
    class, combined before the shuffle). Hash prefixes are uniform, so the one bucket per cut whose
    rows are ranked holds about 1/16**digits of the class: some 10^7 rows of a class of 10^11 at the
    default. ``hash_col`` must be unique in a class.
    """
    by, scope = list(by), list(scope)
    slim = df.select(*by, F.col(hash_col).alias("_h"), F.substring(hash_col, 1, digits).alias("_p"))
    counts = slim.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = counts.withColumn("_upto", F.sum("_n").over(running))
    if by:
        totals = counts.groupBy(*by).agg(F.sum("_n").alias("group_size"))
        smallest = F.min("group_size").over(Window.partitionBy(*scope))  # one row per class
        steps = steps.join(totals.withColumn("smallest_group", smallest), by)
    else:  # at most 16**digits rows
        steps = steps.withColumn("group_size", F.sum("_n").over(Window.partitionBy()))
        steps = steps.withColumn("smallest_group", F.col("group_size"))
    wanted = F.array(
        *[F.struct(F.lit(name).alias("cut"), k.cast("long").alias("k")) for name, k in sizes.items()]
    )
    steps = (
        steps.withColumn("_w", F.explode(wanted))
        .filter((F.col("_w.k") <= F.col("_upto")) & (F.col("_w.k") > F.col("_upto") - F.col("_n")))
        .select(*by, "_p", "_w.cut", (F.col("_w.k") - F.col("_upto") + F.col("_n")).alias("_rank"))
    )
    inside = slim.join(bounded_local(steps), [*by, "_p"])
    position = F.row_number().over(Window.partitionBy(*by, "cut").orderBy("_h"))
    found = (
        inside.withColumn("_at", position)
        .filter(F.col("_at") == F.col("_rank"))
        .select(*by, "cut", F.col("_h").alias("cut_hash"))
    )
    return bounded_local(found)


def check_classes(cuts: DataFrame, scope: Iterable[str], expected: int) -> None:
    """Raise if a scope has fewer than ``expected`` classes; ``cuts`` has one row per class."""
    fewest = cuts.groupBy(*scope).agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c")).first()[0]
    if (fewest or 0) < expected:
        raise ValueError(f"cannot balance: {fewest or 0} of {expected} classes present")


def take_by_hash(
    df: DataFrame,
    hash_col: str,
    size: Column,
    by: Iterable[str] = (),
    scope: Iterable[str] = (),
    expected: int | None = None,
    checked: Column | None = None,
) -> DataFrame:
    """Keep the ``size`` rows with the smallest hashes in every class of ``by``.

    With ``expected`` set, fewer non-empty classes within a ``scope`` are an error; ``checked`` limits
    that rule to some scopes.
    """
    by = list(by)
    cuts = hash_cut_points(df, hash_col, {"keep": size}, by, scope).drop("cut")
    if expected is not None:
        check_classes(cuts if checked is None else cuts.filter(checked), scope, expected)
    if by:
        joined = join_null_safe(df, cuts, by)
        return joined.filter(F.col(hash_col) <= F.col("cut_hash")).select(*df.columns)
    last = cuts.select("cut_hash").first()
    return df.filter(F.col(hash_col) <= last["cut_hash"]) if last else df.limit(0)


def value_edges(df: DataFrame, value: str, buckets: int | None = None) -> list[float]:
    """Distinct approximate quantiles of a column; one map-side sketch pass, no shuffle of rows.

    The number of buckets follows the session's shuffle parallelism, so a bucket stays one task's
    share of the data at any scale.
    """
    if buckets is None:
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = min(max(4 * partitions, 64), 4096)
    grid = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(value, grid, 0.25 / buckets)
    return sorted(set(found))


def running_sums(
    df: DataFrame, value: str, sums: Iterable[str], edges: list[float], by: Iterable[str] = ()
) -> DataFrame:
    """Exclusive running sums ``<name>_before`` in order of ``value``, and totals ``<name>_total``.

    ``df`` holds one row per (by, value); NaN and missing values come last, in a bucket of their own. ``edges`` cut the value range into buckets; bucket totals
    become offsets (at most ``len(edges) + 1`` rows per class) and only rows of one bucket are
    ordered together.
    """
    by, sums = list(by), list(sums)
    cuts = [e for e in edges if e not in (float("-inf"), float("inf"))]
    bounds = [float("-inf"), *cuts, float("inf")]
    bucketed = Bucketizer(splits=bounds, inputCol=value, outputCol="_bucket", handleInvalid="keep").transform(df)
    earlier = (Window.unboundedPreceding, -1)
    over_buckets = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(*earlier)
    offsets = bucketed.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    whole = Window.partitionBy(*by)
    offsets = offsets.select(
        *by,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{s}").over(over_buckets), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(*earlier)
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_l_{s}") for s in sums]
    )
    joined = join_null_safe(local, offsets, [*by, "_bucket"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_o_{s}") + F.col(f"_l_{s}")).alias(f"{s}_before") for s in sums],
        *[f"{s}_total" for s in sums],
    )


def exact_quantile(df: DataFrame, value: str, fraction: float, out: str = "quantile") -> DataFrame:
    """One row with the linearly interpolated quantile of all non-missing values.

    Built-in ``percentile`` keeps every distinct value of a group in one aggregation buffer; this
    version ranks value counts bucket by bucket instead.
    """
    clean = df.select(F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    edges = value_edges(clean, "_v")
    counted = clean.groupBy("_v").agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counted, "_v", ["n"], edges)
    placed = ranked.withColumn("_position", (F.col("n_total") - 1).cast("double") * float(fraction))

    def value_at(rank: Column) -> Column:
        here = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col("_v")))

    low, high = F.floor("_position"), F.ceil("_position")
    ends = placed.agg(
        value_at(low).alias("_low"),
        value_at(high).alias("_high"),
        F.max(F.col("_position") - low).alias("_part"),
    )
    between = F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))
    return ends.select(between.alias(out))


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), out: str = "position", total: str | None = None) -> DataFrame:
    """Number the rows of each group 0, 1, 2, ... in ascending order (missing values first) of ``order``.

    Rows are dealt into sorted ranges and written once; a row's number is its place in its range plus the counted rows of
    earlier ranges. A group of any share of the table spreads over as many ranges as it needs; only counts, one per group
    and range, are summed in a window. Rows that agree in ``order`` are numbered in either order. ``total`` names a column for
    the rows of the group. ``df`` must not have columns ``_at``, ``_range``, ``_first`` or ``_before``.
    """
    by, keys = list(by), [*by, *order]
    ranges = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = stored(ranges, "ranges").withColumn("_range", F.shiftright("_at", 33))
    counts = placed.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if by:
        whole = Window.partitionBy(*by)
        before = F.sum("_n").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        offsets = counts.select(*by, "_range", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    else:  # one row per range, as many as there are shuffle partitions
        rows = sorted(counts.collect())
        ends = list(accumulate((r["_n"] for r in rows), initial=0))
        found = [(r["_range"], r["_first"], before, ends[-1]) for r, before in zip(rows, ends)]
        offsets = df.sparkSession.createDataFrame(found, "_range bigint, _first bigint, _before bigint, _total bigint")
    position = (F.col("_at") - F.col("_first") + F.col("_before")).alias(out)
    totals = [F.col("_total").alias(total)] if total else []
    return join_null_safe(placed, offsets, [*by, "_range"]).select(*df.columns, position, *totals)


def dense_ids(df: DataFrame, major: str, minor: str, out: str) -> DataFrame:
    """Number the distinct (major, minor) pairs 0, 1, 2, ... in sorted order, whatever their type, range or skew."""
    keys = numbered(df.select(major, minor).distinct(), [major, minor], out=out)
    return join_null_safe(df, keys, [major, minor])
