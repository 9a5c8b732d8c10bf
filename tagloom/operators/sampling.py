"""Event-level splits and exact class balancing by deterministic hash order."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.ranking import check_classes, hash_cut_points, order_hash, take_by_hash
from tagloom.session import stored

DEFAULT_SEED = 3


def shuffle_order(df: DataFrame, keys: Iterable[str], seed: int = DEFAULT_SEED, out: str = "shuffle_key") -> DataFrame:
    """Attach the key of a reproducible random permutation; sort by it where order matters."""
    return df.withColumn(out, order_hash(keys, seed))


def split_by_event(
    df: DataFrame,
    event: str,
    seed: int = DEFAULT_SEED,
    train_val_fraction: float = 0.8,
    train_fraction: float = 0.8,
    out: str = "subset",
) -> DataFrame:
    """Label every row train, val or test so that whole events stay together.

    Exact sizes: of N shuffled events the first floor(train_fraction * floor(fraction * N)) train,
    the rest up to floor(fraction * N) validate. The two boundary hashes are found by distributed
    selection; rows are then labelled by comparing their event hash, without a join.
    """
    events = df.select(event).distinct().withColumn("_h", order_hash([event], seed))
    size = F.col("group_size").cast("double")
    both = F.floor(F.lit(train_val_fraction) * size)
    train = F.floor(F.lit(train_fraction) * both.cast("double"))
    cuts = hash_cut_points(events, "_h", {"train": train, "val": both}).collect()  # two rows
    last = {row["cut"]: row["cut_hash"] for row in cuts}
    here = order_hash([event], seed)
    # both comparisons are always evaluated, so the hash is a shared subexpression
    beyond = [(here > last.get(name, "")).cast("int") for name in ("train", "val")]
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    return df.withColumn(out, F.element_at(names, beyond[0] + beyond[1] + 1))


def hash_split(df: DataFrame, keys: Iterable[str], parts: dict[str, float], seed: int, out: str = "subset") -> DataFrame:
    """Random split by hash: fractions hold in expectation, no counting pass needed.

    Fractions are not negative and add up to one. A row belongs to the first part whose upper bound its
    hash, read as a number in [0, 1), is below; the last part that is not empty takes the rest.
    """
    if any(f < 0 for f in parts.values()) or abs(sum(parts.values()) - 1.0) > 1e-9:
        raise ValueError("fractions must not be negative and must add up to one")
    position = F.conv(F.substring(order_hash(keys, seed), 1, 8), 16, 10).cast("long")
    used = [name for name, fraction in parts.items() if fraction > 0]
    chain, upper = F, 0.0
    for name in used[:-1]:
        upper += parts[name]
        chain = chain.when(position < int(upper * 16**8), name)
    return df.withColumn(out, chain.otherwise(used[-1]) if len(used) > 1 else F.lit(used[0]))


def balance_classes(
    df: DataFrame,
    classes: Iterable[str],
    row_keys: Iterable[str],
    seed: int = DEFAULT_SEED,
    expected: int | None = None,
    scope: Iterable[str] = (),
) -> DataFrame:
    """Down-sample every class to the size of the smallest one, exactly.

    ``row_keys`` identify a row and fix the random order. With ``expected`` set (strict mode), fewer
    classes raise a ValueError. ``scope`` columns (part of ``classes``)
    delimit separate balancing problems, e.g. train and validation set.
    """
    classes, scope = list(classes), list(scope)
    hashed = df.withColumn("_row_hash", order_hash(row_keys, seed))
    kept = take_by_hash(hashed, "_row_hash", F.col("smallest_group"), classes, scope, expected)
    return kept.drop("_row_hash")


def downsample_class(
    df: DataFrame,
    column: str,
    value: str | int,
    size: Column | int,
    row_keys: Iterable[str],
    seed: int = 42,
) -> DataFrame:
    """Cut one class to ``size`` rows (a number or a scalar subquery) and keep all other rows."""
    majority = df.filter(F.col(column) == F.lit(value)).withColumn("_row_hash", order_hash(row_keys, seed))
    wanted = size if isinstance(size, Column) else F.lit(size)
    kept = take_by_hash(majority, "_row_hash", F.least(wanted, F.col("group_size"))).drop("_row_hash")
    return df.filter(~F.col(column).eqNullSafe(F.lit(value))).unionByName(kept)


def class_size(df: DataFrame, column: str, value: str | int) -> Column:
    """Row count of one class as a scalar subquery."""
    return df.filter(F.col(column) == F.lit(value)).agg(F.count(F.lit(1))).scalar()


def balance_head(df: DataFrame, label: str, row_keys: Iterable[str], seed: int = 42) -> DataFrame:
    """All positives plus as many shuffled negatives."""
    return downsample_class(df, label, 0, class_size(df, label, 1), row_keys, seed)


def balanced_sets(
    df: DataFrame,
    level: int,
    subset: str,
    selected: str,
    flavour: str,
    label: str,
    row_keys: Iterable[str],
    seed: int = DEFAULT_SEED,
    strict: bool = True,
) -> DataFrame:
    """Apply a balancing level to a table labelled by ``split_by_event``.

    Level 0 balances (sign of flavour, label) in train, val and test; level 1 only in train and val;
    level 2 balances the label alone in train and val. Train and val keep selected rows only, test
    keeps its unselected rows untouched. The rows are computed once and stored; all cuts are found on that table (the subset
    is a balancing scope, and a subset that is not balanced has its own group sizes as targets), then one scan of it keeps rows.
    """
    balanced = ["train", "val", "test"] if level == 0 else ["train", "val"]
    work = df.withColumns({"_sign": (F.col(flavour) > 0).cast("int"), "_row_hash": order_hash(row_keys, seed)})
    work = stored(work.filter((F.col(selected) == 1) | ((F.col(selected) == 0) & (F.col(subset) == "test"))), "balance")
    classes = [subset, label] if level == 2 else [subset, "_sign", label]
    in_balance = F.col(subset).isin(balanced)
    size = F.when(in_balance, F.col("smallest_group")).otherwise(F.col("group_size"))
    cuts = hash_cut_points(work.filter(F.col(selected) == 1), "_row_hash", {"keep": size}, classes, [subset]).drop("cut")
    if strict:
        check_classes(cuts.filter(in_balance), [subset], 2 if level == 2 else 4)
    renamed = cuts.withColumnsRenamed({c: f"_cut_{c}" for c in classes})
    same = [F.col(c).eqNullSafe(F.col(f"_cut_{c}")) for c in classes]
    marked = work.join(renamed, same, "left")
    return marked.filter((F.col(selected) == 0) | (F.col("_row_hash") <= F.col("cut_hash"))).select(*df.columns)


def hold_out(df: DataFrame, file_column: str, reserved: str, enabled: bool = True) -> DataFrame:
    """Leave the rows of one named input file out of the training sample."""
    return df.filter(F.col(file_column) != reserved) if enabled else df
