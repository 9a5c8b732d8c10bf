"""The derived track columns computed between flattening and selection."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import kinematics as kin
from tagloom.operators.events import min_abs_per_event


def signal_vector(prefix: str = "B_") -> kin.Vector:
    return tuple(F.col(f"{prefix}P{axis}") for axis in "XYZ")


def track_vector(prefix: str = "B_") -> kin.Vector:
    return tuple(F.col(f"{prefix}Tr_T_P{axis}") for axis in "XYZ")


def _track(name: str, prefix: str) -> Column:
    return F.col(f"{prefix}Tr_T_{name}")


def feature_columns(prefix: str = "B_") -> dict[str, Column]:
    """Features available in simulation and data, by output column name."""
    signal, track = signal_vector(prefix), track_vector(prefix)
    out = f"{prefix}Tr_T_"
    eta_b, eta_t = F.col(f"{prefix}ETA"), _track("Eta", prefix)
    dphi = F.col(f"{out}PhiDistance")
    columns = {
        f"{out}endSV_Z": F.abs(F.col(f"{prefix}ENDV_Z") - _track("firstZ", prefix)),
        f"{out}diff_z": F.abs(F.col(f"{prefix}OWNPV_Z") - _track("OWNPV_Z", prefix)),
        f"{out}Signal_TagPart_PT": kin.pair_pt(signal[0], signal[1], track[0], track[1]),
        f"{out}cos_PhiDistance": F.cos(dphi),
        f"{out}EtaDistance": kin.eta_distance(eta_b, eta_t),
        f"{out}DeltaR": kin.delta_r2(eta_b, eta_t, dphi),
        f"{out}OWNPVIPSig": F.sqrt(_track("OWNPVIPCHI2", prefix)),
        f"{out}absOWNPV_IP": F.abs(_track("OWNPVIP", prefix)),
    }
    columns.update(energy_releases(prefix))
    return columns


def energy_releases(prefix: str = "B_", masses: Mapping[str, float] = kin.HYPOTHESIS_MASSES) -> dict[str, Column]:
    return {
        f"{prefix}Tr_T_DeltaQ_{name}": kin.energy_release(
            mass,
            track_vector(prefix),
            signal_vector(prefix),
            F.col(f"{prefix}ENERGY"),
            F.col(f"{prefix}M"),
        )
        for name, mass in masses.items()
    }


def vertex_columns(prefix: str = "B_") -> dict[str, Column]:
    """Simulation-only features around the decay vertex."""
    vertex = tuple(F.col(f"{prefix}ENDV_{axis}") for axis in "XYZ")
    point = tuple(_track(axis, prefix) for axis in "XYZ")
    momentum = track_vector(prefix)
    step = kin.approach_parameter(vertex, point, momentum)
    distance = kin.approach_distance(step, point, momentum)
    return {
        "diff_P": F.abs(F.col(f"{prefix}P") - _track("P", prefix)),
        "t": step,
        "EVIP": distance,
        "logEVIP": kin.safe_log(distance),
        f"{prefix}Tr_T_atanPT_PZ": F.atan2(_track("PT", prefix), _track("PZ", prefix)),
    }


def projection_columns(prefix: str = "B_") -> dict[str, Column]:
    """Four-momentum product of track and signal, its logarithm, and charge over momentum."""
    product = kin.four_product(
        F.col(f"{prefix}ENERGY"), signal_vector(prefix), _track("ENERGY", prefix), track_vector(prefix)
    )
    return {
        "P_proj": product,
        "logP_proj": kin.safe_log(product),
        f"{prefix}Tr_T_EoverP": F.try_divide(_track("Charge", prefix), _track("P", prefix)),
    }


def add_features(
    df: DataFrame, event_keys: list[str], simulation: bool = True, prefix: str = "B_", minimum: bool = True
) -> DataFrame:
    """All derived columns of a flat track table.

    Run with ``minimum=False`` when the per-event minimum was already computed on nested events.
    """
    out = f"{prefix}Tr_T_"
    dphi = kin.phi_distance(F.col(f"{prefix}PHI"), _track("Phi", prefix))
    result = df.withColumn(f"{out}PhiDistance", dphi)
    if simulation:
        result = result.withColumn(f"{out}absID", F.abs(_track("TRUE_PARTICLE_ID", prefix)))
    result = result.withColumns(feature_columns(prefix))
    if simulation:
        result = result.withColumns(vertex_columns(prefix))
    if minimum:
        result = min_abs_per_event(result, f"{out}PhiDistance", event_keys, f"{out}minPhiDistance")
    return result


# Derived classifier inputs of the signal selection, name to (kind, columns).
SIGNAL_INPUTS = {
    "lab0_CHI2DOF": ("copy", ("B_OWNPV_CHI2DOF",)),
    "lab0_IPCHI2_OWNPV": ("copy", ("B_OWNPV_IPCHI2",)),
    "eventNumber": ("copy", ("EVENTNUMBER",)),
    "lab0_DIRA_OWNPV_Transformed": ("direction", ("B_OWNPV_DIRA",)),
    "lab0_MINIPCHI2_Log": ("log", ("B_MIN_OWNPV_IPCHI2",)),
    "lab0_RFD": ("flight", ("B_ENDV_X", "B_ENDV_Y", "B_OWNPV_X", "B_OWNPV_Y")),
    "lab0_VCHI2NDOF_Log": ("log", ("B_ENDV_CHI2DOF",)),
    "lab0_LifetimeFit_VCHI2NDOF_Log": ("log", ("B_DTF_PV_B_CHI2DOF",)),
    "lab2_DIRA_ORIVX_Transformed": ("direction", ("Ds_OWNPV_DIRA",)),
    "lab2_MINIPCHI2_Log": ("log", ("Ds_MIN_OWNPV_IPCHI2",)),
    "lab2_RFD": ("flight", ("Ds_ENDV_X", "Ds_ENDV_Y", "Ds_OWNPV_X", "Ds_OWNPV_Y")),
    "lab2_VCHI2NDOF_Log": ("log", ("Ds_ENDV_CHI2DOF",)),
    "lab1_MINIPCHI2_Log": ("log", ("piplus_MINIPCHI2",)),
    "lab1_PT": ("copy", ("piplus_PT",)),
    "lab1_CosTheta": (
        "angle",
        ("B_PX", "B_PY", "B_PZ", "piplus_PX", "piplus_PY", "piplus_PZ"),
    ),
    "lab345_MIN_PT": ("least", ("hplus_PT", "hminus_PT", "piminus_PT")),
    "lab345_MIN_MINIPCHI2_Log": (
        "log_least",
        ("hplus_OWNPV_IPCHI2", "hminus_OWNPV_IPCHI2", "piminus_OWNPV_IPCHI2"),
    ),
    "lab1345_TRACK_GhostProb": (
        "greatest",
        ("piplus_TRGHOSTPROB", "hplus_TRGHOSTPROB", "hminus_TRGHOSTPROB", "piminus_TRGHOSTPROB"),
    ),
}

_SIGNAL_KINDS = {
    "copy": lambda x: x,
    "direction": kin.transformed_direction,
    "log": kin.safe_log,
    "flight": kin.transverse_flight,
    "angle": lambda x, y, z, dx, dy, dz: kin.boosted_cosine((x, y, z), (dx, dy, dz), F.col("_boost")),
    "least": F.least,
    "log_least": lambda *c: kin.safe_log(F.least(*c)),
    "greatest": F.greatest,
}


def signal_inputs(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Project the classifier inputs of the signal selection.

    The boost factor behind the angle gets its own projection, so it is evaluated once per row.
    """
    parent, bachelor = signal_vector(), tuple(F.col(f"piplus_P{axis}") for axis in "XYZ")
    factor = kin.boost_factor(F.col("B_M"), parent, F.col("piplus_M"), bachelor)
    inputs = [
        _SIGNAL_KINDS[kind](*[F.col(c) for c in columns]).alias(name)
        for name, (kind, columns) in SIGNAL_INPUTS.items()
    ]
    return df.withColumn("_boost", factor).select(*keep, *inputs)


def end_vertex_distances(axes: str = "XYZ", prefix: str = "B_", out: str = "B_Tr_T_") -> dict[str, Column]:
    """Distance of a track's first hit from the decay vertex along each axis."""
    return {f"{out}endSV_{a}": F.abs(F.col(f"{prefix}ENDV_{a}") - _track(f"first{a}", prefix)) for a in axes}
