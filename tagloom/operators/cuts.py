"""Row selections: text cuts, category codes, windows and gates."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.operators.expressions import checked

# On data the true-origin term is replaced by the in-signal-tree flag.
SIMULATION_SIGNAL_TERM = "(B_Tr_T_Origin_Flag !=0)"
DATA_SIGNAL_TERM = "(B_Tr_T_IsInTree != 1)"

# Name parts of columns that exist in simulation only.
TRUTH_NAME_PARTS = ("TRUE", "Flag", "MC", "BKGCAT")

# Background category kept per decay; every other decay keeps category 0.
BACKGROUND_CATEGORY = {"Bs2DsPi": 20}

# Open fill-number intervals of the data-taking blocks.
DATA_BLOCKS = {
    "1": (9982, 10056),
    "2": (9945, 9978),
    "3": (9911, 9943),
    "2_3": (9911, 9978),
    "1_2": (9945, 10056),
}

# Prefixes of the decay-tree members and their readable names.
MEMBER_NAMES = {
    "lab0": "B",
    "lab1": "piplus",
    "lab2": "Ds",
    "lab3": "hplus",
    "lab4": "hminus",
    "lab5": "piminus",
}

# Open momentum (MeV), transverse momentum (MeV) and pseudorapidity windows.
DAUGHTER_WINDOWS = {"P": (2000.0, 150000.0), "PT": (250.0, 45000.0), "ETA": (2.0, 5.0)}

# Runs of the validated 2022 data set.
GOOD_RUNS = (
    256290, 256289, 256288, 256287, 256283, 256278, 256276, 256274, 256273, 256272, 256267,
    256264, 256263, 256261, 256259, 256258, 256254, 256214, 256169, 256166, 256163, 256159,
    256156, 256150, 256146, 256143, 256142, 256135, 256134, 256132, 256129, 256119, 256112,
    256111, 256110, 256107, 256105, 256104, 256032, 256030, 256028, 256026, 256022, 256020,
    256015, 256011, 256007, 256004, 256003, 256001, 256000, 255999, 255984, 255982, 255980,
    255977, 255976, 255974, 255972, 255971, 255970, 255964, 255958, 255956, 255950, 255949,
)

# Fixed value: score of rows that fail the quality gate.
GATED_SCORE = -2.0


def cut_predicate(text: str, data: bool = False) -> str:
    """SQL predicate of a cut text: every line is a conjunction, lines are alternatives."""
    lines = [line.strip() for line in text.splitlines()]
    lines = [line for line in lines if line and line.upper() != "OR"]
    if not lines:
        raise ValueError("cut text holds no condition")
    joined = " OR ".join(f"({line})" for line in lines)
    if data:
        joined = joined.replace(SIMULATION_SIGNAL_TERM, DATA_SIGNAL_TERM)
    joined = re.sub(r"&+", " AND ", joined)
    joined = re.sub(r"\|+", " OR ", joined)
    return re.sub(r"==", "=", joined)


def _predicate(df: DataFrame, text: str, data: bool) -> Column:
    """The cut text as a column, if it holds nothing but columns of ``df``, numbers, operators and known functions."""
    predicate = cut_predicate(text, data)
    checked(predicate, df.columns)
    return F.expr(predicate)


def add_selected(df: DataFrame, text: str, data: bool = False, out: str = "selected") -> DataFrame:
    """Add a 0/1 column for the cut text; no row is dropped. A missing value counts as not passed.

    Comparisons with NaN are true for ``>`` in Spark, so incomplete rows should be dropped before.
    """
    passed = F.coalesce(_predicate(df, text, data), F.lit(False))
    return df.withColumn(out, passed.cast("int"))


def keep_passing(df: DataFrame, text: str, data: bool = False) -> DataFrame:
    """Filter by the cut text; the comparison terms reach the file scan."""
    return df.filter(_predicate(df, text, data))


def without_truth(columns: Iterable[str]) -> list[str]:
    """Column names available on real data."""
    return [c for c in columns if not any(part in c for part in TRUTH_NAME_PARTS)]


def drop_incomplete(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any of the columns."""
    return df.na.drop(subset=list(columns) if columns is not None else None)


def keep_species(df: DataFrame, true_id: str, expected: int) -> DataFrame:
    return df.filter(F.abs(F.col(true_id)) == expected)


def exclude_signal_tree(df: DataFrame, flag: str) -> DataFrame:
    """Remove tracks that belong to the signal candidate itself."""
    return df.filter(F.col(flag) != 1)


def keep_background_category(df: DataFrame, category: str, decay: Column) -> DataFrame:
    wanted = F.lit(0)
    for name, code in BACKGROUND_CATEGORY.items():
        wanted = F.when(decay.contains(name), F.lit(code)).otherwise(wanted)
    return df.filter(F.col(category) == wanted)


def origin_class(
    abs_id: Column,
    origin: Column,
    mother_id: Column,
    merge_same_side: bool = False,
    with_opposite_proton: bool = False,
) -> Column:
    """First matching track class.

    ``merge_same_side`` joins same-side protons and kaons and adds the opposite-side proton class;
    ``with_opposite_proton`` adds that class without the merge.
    """
    same, opposite, elsewhere = origin == 1, origin == 2, origin == 100
    rules: list[tuple[str, Column]] = [
        ("OSKaon", (abs_id == 321) & opposite),
        ("OSMuon", (abs_id == 13) & opposite),
        ("OSElectron", (abs_id == 11) & opposite & (F.abs(mother_id) != 22)),
        ("SSPion", (abs_id == 211) & same),
    ]
    if merge_same_side:
        rules.append(("SSProton+SSKaon", abs_id.isin(2212, 321) & same))
    else:
        rules += [("SSProton", (abs_id == 2212) & same), ("SSKaon", (abs_id == 321) & same)]
    if merge_same_side or with_opposite_proton:
        rules.append(("OSProton", (abs_id == 2212) & opposite))
    rules.append(("notSamePV", elsewhere))
    chain = F
    for name, rule in rules:
        chain = chain.when(rule, name)
    return chain.otherwise("Others")


def drop_class(df: DataFrame, column: str, name: str = "Others") -> DataFrame:
    return df.filter(F.col(column) != name)


def mass_window(df: DataFrame, mass: str, low: float = 5200.0, high: float = 5400.0) -> DataFrame:
    """Open mass interval."""
    return df.filter((F.col(mass) > low) & (F.col(mass) < high))


def keep_block(df: DataFrame, fill: str, block: str) -> DataFrame:
    """Rows of one data block, or of all data; an unknown name is an error."""
    if block == "all":
        return df
    if block not in DATA_BLOCKS:
        raise ValueError(f"unknown data block {block!r}")
    low, high = DATA_BLOCKS[block]
    return df.filter((F.col(fill) > low) & (F.col(fill) < high))


def label_blocks(
    df: DataFrame,
    fill: str,
    blocks: Mapping[str, tuple[float, float]] = DATA_BLOCKS,
    out: str = "block",
) -> DataFrame:
    """One row per block containing the fill number; blocks overlap, so rows may repeat.

    The few fixed intervals become one expression per row, in place of a range join.
    """
    named = [
        F.when((F.col(fill) > low) & (F.col(fill) < high), F.lit(name))
        for name, (low, high) in blocks.items()
    ]
    return df.withColumn(out, F.explode(F.array_compact(F.array(*named))))


def signal_preselection(
    df: DataFrame,
    daughters: Iterable[str] = ("piplus", "hplus", "hminus", "piminus"),
    pid: str = "piplus_PID_K",
    windows: Mapping[str, tuple[float, float]] = DAUGHTER_WINDOWS,
) -> DataFrame:
    """Negative kaon identification of the bachelor and open windows for every daughter."""
    condition = F.col(pid) < 0
    for daughter in daughters:
        for name, (low, high) in windows.items():
            value = F.col(f"{daughter}_{name}")
            condition = condition & (value > low) & (value < high)
    return df.filter(condition)


def rename_members(df: DataFrame, names: Mapping[str, str] = MEMBER_NAMES) -> DataFrame:
    """Rename columns by member prefix (lab0_... to B_...)."""
    renamed = {c: rename_in_text(c, names) for c in df.columns}
    return df.withColumnsRenamed({old: new for old, new in renamed.items() if old != new})


def rename_in_text(text: str, names: Mapping[str, str] = MEMBER_NAMES) -> str:
    """The same renaming inside an expression, at word boundaries only."""
    return re.sub(r"\b([A-Za-z0-9]+)_", lambda m: f"{names.get(m[1], m[1])}_", text)


def good_runs(df: DataFrame, run: str, runs: Iterable[int] = GOOD_RUNS) -> DataFrame:
    """Membership in a run list; a fixed list of this size is a set lookup per row."""
    return df.filter(F.col(run).isin(list(runs)))


def quality_passed(chi2_per_dof: Column, ip_chi2: Column) -> Column:
    return (chi2_per_dof >= 0.0) & (chi2_per_dof <= 20.0) & (ip_chi2 >= 0.0)


def gated_score(score: Column, passed: Column) -> Column:
    """Score of rows passing the gate, the fixed default for all others."""
    return F.when(passed, score).otherwise(F.lit(GATED_SCORE))


def mva_samples(
    df: DataFrame, mass: str, run: str, signal_flag: str | None = None, out: str = "target"
) -> DataFrame:
    """Labelled training sample: simulated signal near the peak, data background above it.

    Signal rows satisfy 5000 < m < 5600, background rows m > 5400 and run >= 255623. With
    ``signal_flag`` one table carries both sources (flag 1 for signal).
    """
    m, flag = F.col(mass), F.col(signal_flag) if signal_flag else F.lit(None)
    signal = (m > 5000.0) & (m < 5600.0)
    background = (m > 5400.0) & (F.col(run) >= 255623)
    label = F.when((flag == 1) & signal, 1).when((flag == 0) & background, 0)
    return df.withColumn(out, label).filter(F.col(out).isNotNull())
