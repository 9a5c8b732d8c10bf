"""Tagging decision, label, mistag and decay-time columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: |ID| of the signal species by the first two letters of the decay name.
SPECIES_ID = {"Bs": 531, "Bd": 511, "Bu": 521}

# Taggers whose track charge has the sign of the signal flavour in neutral decays.
SAME_SIGN_TAGGERS = ("SSKaon", "SSPion")

# Fixed value: speed of light in mm/ps times the unit factor used for c-tau columns.
LIGHT_SPEED = 0.29979

# Fixed values (Particle Data Group world averages, 1/ps): oscillation frequencies.
MIXING_FREQUENCY = {"Bs": 17.765, "Bd": 0.5069}
# Fixed values (1/ps): width differences of the mass eigenstates.
WIDTH_DIFFERENCE = {"Bs": 0.084, "Bd": 0.0}


def species_id(decay: str) -> int:
    return SPECIES_ID[decay[:2]]


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def tag_decision(charge: Column, decay: str, tagger: str) -> Column:
    """+charge for same-sign taggers of neutral decays, -charge otherwise."""
    neutral = decay[:2] in ("Bd", "Bs")
    decision = charge if neutral and tagger in SAME_SIGN_TAGGERS else -charge
    return decision.cast("int")


def tag_label(decision: Column, flavour_id: Column) -> Column:
    """1 when the decision agrees with the flavour sign, 0 when it does not.

    A decision of 0 (no charge) gives 0 as well, since it is not a correct decision.
    """
    return (decision * sign(flavour_id) == 1).cast("int")


def flavour_label(flavour_id: Column) -> Column:
    """Alternative training label: 1 for a positive ID, 0 for a negative one."""
    return (flavour_id > 0).cast("int")


def final_decision(decision: Column, probability: Column, selected: Column) -> Column:
    """Decision after unselected tracks are zeroed and mistags above one half are flipped."""
    mistag = 1.0 - probability
    return (
        F.when(~_is_selected(selected), F.lit(0))
        .when(mistag > 0.5, -decision)
        .otherwise(decision)
        .cast("int")
    )


def final_mistag(probability: Column, selected: Column) -> Column:
    """Mistag folded into [0, 0.5]; 0.5 for unselected tracks."""
    mistag = 1.0 - probability
    return (
        F.when(~_is_selected(selected), F.lit(0.5))
        .when(mistag > 0.5, 1.0 - mistag)
        .otherwise(mistag)
    )


def _is_selected(selected: Column) -> Column:
    return F.coalesce(selected.cast("int"), F.lit(0)) == 1


def decay_time(column: Column, unit: str = "c_ps") -> Column:
    """Decay time in ps from a column in one of the units ps, fs, c_fs, c_ps."""
    if unit == "ps":
        return column
    if unit == "fs":
        return column * 1000.0
    if unit == "c_fs":
        return column * (1000.0 / LIGHT_SPEED)
    if unit == "c_ps":
        return column / LIGHT_SPEED
    raise ValueError(f"unknown time unit {unit!r}")


def oscillation_phase_time(time: Column, frequency: float) -> Column:
    """Time folded into one oscillation period."""
    return F.pmod(time, F.lit(2.0 * math.pi / frequency))


def frequency_of(mode: str) -> float:
    """The Bd frequency for Bd modes, the Bs frequency for every other mode."""
    return MIXING_FREQUENCY["Bd" if mode[:2] == "Bd" else "Bs"]


def mixing_probability(time: Column, frequency: float, width_difference: float = 0.0) -> Column:
    """Probability that a neutral meson decays with the flavour opposite to its production."""
    damping = F.cosh(time * (0.5 * width_difference)) if width_difference else F.lit(1.0)
    return 0.5 * (1.0 - F.cos(time * frequency) / damping)
