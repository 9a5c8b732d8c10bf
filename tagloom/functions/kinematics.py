"""Kinematic quantities of a track relative to its event's signal candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particle masses in MeV used as hypotheses for the energy release.
HYPOTHESIS_MASSES = {
    "Pion": 139.5706,
    "Muon": 105.65837,
    "Electron": 0.51100,
    "Proton": 938.27208,
    "Kaon": 493.677,
}

Vector = tuple[Column, Column, Column]


def square(x: Column) -> Column:
    return x * x


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Vector, b: Vector) -> Column:
    return total([x * y for x, y in zip(a, b)])


def norm2(a: Vector) -> Column:
    return total([square(x) for x in a])


def phi_distance(phi_signal: Column, phi_track: Column) -> Column:
    """Signed azimuthal separation, wrapped into (-pi, pi]."""
    delta = phi_signal - phi_track
    return F.atan2(F.sin(delta), F.cos(delta))


def eta_distance(eta_signal: Column, eta_track: Column) -> Column:
    return F.abs(eta_signal - eta_track)


def delta_r2(eta_signal: Column, eta_track: Column, dphi: Column) -> Column:
    """Squared cone distance. The feature is called DeltaR but carries no square root."""
    return square(eta_signal - eta_track) + square(dphi)


def energy(mass: Column, momentum: Vector) -> Column:
    return F.sqrt(square(mass) + norm2(momentum))


def invariant_mass(bodies: list[tuple[Column, Vector]]) -> Column:
    """Mass of a system of (mass, momentum) bodies."""
    summed = tuple(total([p[i] for _, p in bodies]) for i in range(3))
    return F.sqrt(square(total([energy(m, p) for m, p in bodies])) - norm2(summed))


def energy_release(
    mass: float, track: Vector, signal: Vector, signal_energy: Column, signal_mass: Column
) -> Column:
    """Q value of signal + track when the track is given the hypothesis ``mass`` (MeV)."""
    hypothesis = F.lit(float(mass))
    pair = tuple(t + s for t, s in zip(track, signal))
    pair_mass = F.sqrt(square(energy(hypothesis, track) + signal_energy) - norm2(pair))
    return pair_mass - signal_mass - hypothesis


def pair_pt(signal_px: Column, signal_py: Column, px: Column, py: Column) -> Column:
    return F.sqrt(square(signal_px + px) + square(signal_py + py))


def approach_parameter(vertex: Vector, point: Vector, momentum: Vector) -> Column:
    """Step along the track at which vertex-to-track and vertex directions are orthogonal.

    A zero projection of the momentum on the vertex gives NULL instead of an ANSI error.
    """
    return F.try_divide(norm2(vertex) - dot(vertex, point), dot(vertex, momentum))


def approach_distance(step: Column, point: Vector, momentum: Vector) -> Column:
    """Length of the track position after ``step``: |X + step * P|."""
    return F.sqrt(norm2(tuple(x + step * p for x, p in zip(point, momentum))))


def safe_log(x: Column) -> Column:
    """Natural logarithm, NULL where it is undefined."""
    return F.when(x > 0, F.log(x))


def four_product(energy_a: Column, a: Vector, energy_b: Column, b: Vector) -> Column:
    return energy_a * energy_b - dot(a, b)


def boost_factor(parent_mass: Column, parent: Vector, daughter_mass: Column, daughter: Vector) -> Column:
    """Factor k of the boost into the parent's rest frame: p* = p + k P.

    With E, M, P of the parent and e, p of the daughter, k = ((p.P) / (E + M) - e) / M. It needs no
    velocity, so a parent at rest is no special case. Used several times per row; materialise it as a
    column first.
    """
    along = dot(parent, daughter) / (energy(parent_mass, parent) + parent_mass)
    return (along - energy(daughter_mass, daughter)) / parent_mass


def boosted_cosine(parent: Vector, daughter: Vector, factor: Column) -> Column:
    """Cosine of the polar angle of p + k P."""
    boosted = tuple(p + q * factor for p, q in zip(daughter, parent))
    return F.try_divide(boosted[2], F.sqrt(norm2(boosted)))


def cos_theta_star(
    parent_mass: Column, parent: Vector, daughter_mass: Column, daughter: Vector
) -> Column:
    """Cosine of the daughter's polar angle in the parent's rest frame, as one expression."""
    return boosted_cosine(parent, daughter, boost_factor(parent_mass, parent, daughter_mass, daughter))


def transformed_direction(x: Column, margin: float = 1e-6) -> Column:
    """Stretch a direction cosine near +1 and -1 logarithmically; 0 outside [-1, 1]."""
    room = F.lit(1.0 + margin) - F.abs(x)
    return (
        F.when((x > 0) & (x <= 1), -F.log(room))
        .when((x <= 0) & (x >= -1), F.log(room))
        .otherwise(F.lit(0.0))
    )


def transverse_flight(vertex_x: Column, vertex_y: Column, origin_x: Column, origin_y: Column) -> Column:
    return F.sqrt(square(vertex_x - origin_x) + square(vertex_y - origin_y))
