"""The three end-to-end chains on detector-style tables (columns ``B_...`` and ``B_Tr_T_...``)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import kinematics as kin
from tagloom.functions import tagging as tag
from tagloom.operators import calibration, cuts, events, features, joins, networks, stats, weights
from tagloom.sources.tables import flatten

EVENT_KEYS = ("entry", "RUNNUMBER", "EVENTNUMBER")


def complete_tracks(tracks: Column, fields: Sequence[tuple[str, str]], data: bool) -> Column:
    """Tracks without missing values; on data also without the signal's own tracks."""

    def keep(t: Column) -> Column:
        condition = F.lit(True)
        for name, kind in fields:
            condition = condition & t[name].isNotNull()
            if kind in ("double", "float"):
                condition = condition & ~F.isnan(t[name])
        return condition & (t["B_Tr_T_IsInTree"] != 1) if data else condition

    return F.filter(tracks, keep)


def track_table(raw: DataFrame, decay: str, data: bool = False, tracks: str = "tracks") -> DataFrame:
    """Nested events to a flat track table with all derived columns.

    The per-event minimum is taken while the event is one row, so the whole step is free of shuffles.
    """
    element = raw.schema[tracks].dataType.elementType
    fields = [(f.name, f.dataType.simpleString()) for f in element.fields]
    scalars = [c for c in raw.columns if c != tracks]
    chosen = cuts.drop_incomplete(raw, scalars)
    if not data:
        chosen = cuts.keep_species(chosen, "B_TRUEID", tag.species_id(decay))
    chosen = chosen.withColumn(tracks, complete_tracks(F.col(tracks), fields, data))
    distances = F.transform(tracks, lambda t: kin.phi_distance(F.col("B_PHI"), t["B_Tr_T_Phi"]))
    chosen = events.min_abs_nested(chosen, tracks, distances, "B_Tr_T_minPhiDistance")
    flat = flatten(chosen, [tracks])
    return features.add_features(flat, list(EVENT_KEYS), simulation=not data, minimum=False)


def tag_events(
    raw: DataFrame,
    decay: str,
    tagger: str,
    cut_text: str,
    network: networks.Network,
    inputs: Sequence[str],
    data: bool = False,
    carry: Iterable[str] = (),
    tracks: str = "tracks",
) -> DataFrame:
    """Raw nested events to one tagged row per event: ``<tagger>_TagDec`` and ``<tagger>_Eta``.

    Only the tagging columns travel through the single shuffle of the best-track reduction.
    """
    flavour = "B_ID" if data else "B_TRUEID"
    marked = cuts.add_selected(track_table(raw, decay, data, tracks), cut_text, data)
    scored = networks.score(marked, inputs, network, "_p")
    decision = tag.tag_decision(F.col("B_Tr_T_Charge"), decay, tagger)
    d, eta = f"{tagger}_TagDec", f"{tagger}_Eta"
    tagged = scored.select(
        *EVENT_KEYS,
        flavour,
        *carry,
        "subentry",
        "selected",
        tag.final_decision(decision, F.col("_p"), F.col("selected")).alias(d),
        tag.final_mistag(F.col("_p"), F.col("selected")).alias(eta),
    )
    best = events.best_track_per_event(tagged, EVENT_KEYS, "selected", eta, ["subentry"])
    return best.drop("subentry", "selected")


@dataclass
class Combination:
    """Single-tagger calibration, calibration of the combination, and the calibrated events."""

    single: calibration.Calibration
    combined: calibration.Calibration
    events: DataFrame

    def performance(self, flavour: str, weight: str | None = None, by: Iterable[str] = ()) -> DataFrame:
        return stats.tagging_performance(self.events, "d_cal", "omega", flavour, weight, by)


# Polynomial parameters with the logit link by the start of a tagger's name, in the present and the older
# generation of taggers; every other tagger has two.
LOGIT_PARAMETERS = {"OSKaon": 4}
OLDER_LOGIT_PARAMETERS = {"OSKaon": 4, "OSElectron": 3}


def parameters_of(tagger: str, link: str, older: bool = False) -> int:
    """Number of polynomial parameters of a tagger's calibration."""
    known = (OLDER_LOGIT_PARAMETERS if older else LOGIT_PARAMETERS) if link == "logit" else {}
    return next((n for start, n in known.items() if tagger.startswith(start)), 2)


def combine_and_calibrate(
    taggers: Mapping[str, DataFrame],
    key: str,
    flavour: str,
    weight: str | None = None,
    time: str | None = None,
    decay: str = "Bu2JpsiK",
    link: str = "logit",
    combined_link: str = "mistag",
    carry: Iterable[str] = (),
    older: bool = False,
) -> Combination:
    """Join tagged events of all taggers, calibrate each, combine, calibrate the combination.

    ``older`` marks taggers of the older generation. ``time`` names a decay-time column (ps) that switches on the oscillation of neutral modes.
    """
    extra = [c for c in (weight, time) if c] + list(carry)
    shared = list(dict.fromkeys([flavour, *extra]))
    named = {t: df.withColumnsRenamed({f"{t}_TagDec": "d", f"{t}_Eta": "eta"}) for t, df in taggers.items()}
    wide = joins.outer_join_taggers(named, key, shared)
    sources = {(t,): (f"{t}_d", f"{t}_eta") for t in taggers}
    long = calibration.to_long(wide, [key, *shared], sources, ["tagger"])
    mixing = None
    if time and decay[:2] in tag.MIXING_FREQUENCY:
        mixing = tag.mixing_probability(F.col(time), tag.frequency_of(decay), tag.WIDTH_DIFFERENCE[decay[:2]])
    npar = {t: parameters_of(t, link, older) for t in taggers}
    single = calibration.calibrate(long, "tagger", "d", "eta", flavour, weight, link, npar, mixing=mixing)
    made = calibration.apply_calibration(long, single, "tagger", "d", "eta")
    joined = calibration.combine_taggers(made, key, "d_cal", "omega", shared).withColumn("tagger", F.lit("combination"))
    combined = calibration.calibrate(joined, "tagger", "d", "eta", flavour, weight, combined_link, mixing=mixing)
    return Combination(single, combined, calibration.apply_calibration(joined, combined, "tagger", "d", "eta"))


def weight_events(
    df: DataFrame, mass: str, simulation: DataFrame | None, start: weights.Shape, fill: str | None = None, block: str = "all"
) -> tuple[DataFrame, weights.ShapeFit]:
    """Block and mass-window selection, tails from simulation, data fit, sWeights on every row."""
    chosen = cuts.keep_block(df, fill, block) if fill else df
    chosen = cuts.mass_window(chosen, mass, start.low, start.high)
    if simulation is not None:
        fitted = weights.fit_mass(cuts.mass_window(simulation, mass, start.low, start.high), mass, start, True).shape
        start = replace(fitted, c0=start.c0, c1=start.c1, c2=start.c2)
    fit = weights.fit_mass(chosen, mass, start)
    dense = weights.with_densities(chosen, mass, fit.shape)
    yields = weights.fit_yields(dense, fit.yields)
    return weights.sweights(dense, yields).drop("f_sig", "f_bkg"), replace(fit, yields=yields)


def trends(
    df: DataFrame, splits: Mapping[str, Sequence[float]], decision: str, mistag: str, flavour: str, weight: str | None = None, metric: str = "tagging_power"
) -> DataFrame:
    """Deviation of a figure per kinematic bin from the whole sample, for several splits in one job."""
    labels = [
        F.struct(F.lit(name).alias("split"), F.coalesce(stats.bucket_of(name, edges), F.lit(-2)).alias("bin")) for name, edges in splits.items()
    ]
    columns = list(dict.fromkeys([decision, mistag, flavour, *([weight] if weight else [])]))
    rows = df.select(*columns, F.explode(F.array(*labels)).alias("_s")).select(*columns, "_s.*")
    made = stats.rolled_up_performance(rows, "bin", decision, mistag, flavour, weight, ["split"])
    return stats.trend_deviation(made, metric, f"{metric}_err", ["split"])
