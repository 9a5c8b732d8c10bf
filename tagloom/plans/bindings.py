"""Physics roles of the star-schema columns.

Every role is an expression text that means the same in Spark SQL and in the checker's dialect, so
the operator (DataFrame code) and its check (SQL) start from identical inputs. Literals carry an
exponent where a double is meant. Event-level roles depend on the order key only, so they are
constant within an event without a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.tagging import final_decision, final_mistag, tag_decision
from tagloom.functions.transforms import fixed
from tagloom.operators.cuts import add_selected
from tagloom.operators.events import best_track_per_event


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KEYS = {
    "entry": "l_orderkey",
    "subentry": "l_linenumber",
    "track_part": "l_partkey",
    "track_supp": "l_suppkey",
}
ROW_KEYS = ["entry", "subentry", "track_part", "track_supp"]

SIGNAL = {
    "B_PX": "(l_orderkey % 97 - 48) * 1e2",
    "B_PY": "(l_orderkey % 89 - 44) * 1.2e2",
    "B_PZ": "2e4 + (l_orderkey % 1009) * 5e1",
    "B_M": "5.279e3 + (l_orderkey % 7) * 1e0",
    "B_P": "sqrt(((l_orderkey % 97 - 48) * 1e2) * ((l_orderkey % 97 - 48) * 1e2)"
    " + ((l_orderkey % 89 - 44) * 1.2e2) * ((l_orderkey % 89 - 44) * 1.2e2)"
    " + (2e4 + (l_orderkey % 1009) * 5e1) * (2e4 + (l_orderkey % 1009) * 5e1))",
    "B_ENERGY": "6e4 + (l_orderkey % 1009) * 5e1",
    "B_ETA": "2e0 + (l_orderkey % 300) / 1e2",
    "B_PHI": "(l_orderkey % 629) / 1e2 - 3.14e0",
    "B_OWNPV_X": "(l_orderkey % 11) / 1e2",
    "B_OWNPV_Y": "(l_orderkey % 13) / 1e2",
    "B_OWNPV_Z": "(l_orderkey % 201 - 100) * 1e0",
    "B_ENDV_X": "1e0 + (l_orderkey % 17) / 1e1",
    "B_ENDV_Y": "1e0 + (l_orderkey % 19) / 1e1",
    "B_ENDV_X": "(l_orderkey % 19) * 1e-1",
    "B_ENDV_Y": "(l_orderkey % 29) * 1e-1",
    "B_ENDV_Z": "1e1 + (l_orderkey % 23) * 1e0",
    "B_TRUEID": "CASE WHEN l_orderkey % 3 = 0 THEN 521 WHEN l_orderkey % 3 = 1 THEN -521 ELSE 531 END",
    "B_BKGCAT": "CASE WHEN l_orderkey % 5 = 0 THEN 20 ELSE CAST(l_orderkey % 2 AS INT) END",
}

TRACK = {
    "B_Tr_T_PX": "(l_quantity - 2.55e1) * 4e1",
    "B_Tr_T_PY": "(l_discount - 5.5e-2) * 2e4",
    "B_Tr_T_PZ": "l_extendedprice / 2e0",
    "B_Tr_T_P": "l_extendedprice / 2e0 + l_quantity",
    "B_Tr_T_PT": "l_quantity * 4e1",
    "B_Tr_T_ENERGY": "l_extendedprice / 2e0 + l_quantity + 1e1",
    "B_Tr_T_Eta": "2e0 + l_quantity * 6e-2",
    "B_Tr_T_Phi": "l_tax * 7.8e1 - 3.12e0",
    "B_Tr_T_X": "(l_partkey % 101 - 50) / 1e1",
    "B_Tr_T_Y": "(l_suppkey % 53 - 26) / 1e1",
    "B_Tr_T_Z": "l_extendedprice / 1e3",
    "B_Tr_T_firstX": "l_tax * 1e1 + l_discount",
    "B_Tr_T_firstY": "l_quantity / 1e1",
    "B_Tr_T_firstZ": "l_extendedprice / 1e3 + l_quantity",
    "B_Tr_T_OWNPV_Z": "(l_partkey % 201 - 100) * 1e0",
    "B_Tr_T_OWNPVIP": "l_discount - 5.5e-2",
    "B_Tr_T_OWNPVIPCHI2": "l_quantity",
    "B_Tr_T_IPChi2BVTX": "l_quantity / 2e0",
    "B_Tr_T_diff_z": "(l_partkey % 20) * 1e0",
    "B_Tr_T_PROBNN_K": "l_quantity / 5e1",
    "B_Tr_T_PROBNN_MU": "l_discount * 1e1",
    "B_Tr_T_PROBNN_E": "l_tax * 1.25e1",
    "B_Tr_T_PROBNN_PI": "(l_partkey % 100) / 1e2",
    "B_Tr_T_PROBNN_P": "(l_suppkey % 10) / 1e1",
    "B_Tr_T_PIDK": "l_quantity - 2.55e1",
    "B_Tr_T_Charge": "CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END",
    "B_Tr_T_IsInTree": "CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 1 ELSE 0 END",
    "B_Tr_T_Origin_Flag": "CASE l_partkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1"
    " WHEN 3 THEN 2 WHEN 4 THEN 2 WHEN 5 THEN 100 ELSE -1 END",
    "B_Tr_T_TRUE_PARTICLE_ID": "CASE l_suppkey % 6 WHEN 0 THEN 321 WHEN 1 THEN -13 WHEN 2 THEN 11"
    " WHEN 3 THEN -211 WHEN 4 THEN 2212 ELSE 211 END",
    "B_Tr_T_MC_MOTHER_ID": "CASE WHEN l_linenumber = 1 THEN 22 ELSE -511 END",
}

# classifier output, mass observable, fill number, decay time of a track/event row
ROLE = {
    "prob": "l_extendedprice / 1.05e5",
    "prob2": "1e0 - l_quantity / 5.1e1",
}

ORDER_ROLE = {
    "entry": "o_orderkey",
    "run": "o_custkey",
    "event": "o_orderkey",
    "B_ID": "CASE WHEN o_totalprice >= 1.5e5 THEN 521 ELSE -521 END",
    "mass": "5.19e3 + o_totalprice / 2.3e3",
    "mass_peak": "CASE WHEN o_orderstatus = 'F' THEN 5.28e3 + 1.4e1 * (((o_orderkey * 7919) % 1000 + (o_custkey * 104729) % 1000"
    " + (o_orderkey * 31 + o_custkey) % 1000) / 1e3 - 1.5e0) ELSE 5.2e3 + o_totalprice / 2.5e3 END",
    "simulated": "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END",
    "FillNumber": "9900 + o_orderkey % 170",
    "B_DTF_PV_CTAU": "1e-2 + (o_orderkey % 997) / 4e2",
    "B_PT": "o_totalprice / 2e1",
    "B_ETA": "2e0 + (o_custkey % 300) / 1e2",
    "B_nPVs": "CAST(o_custkey % 9 AS INT)",
    "B_nTracks": "CAST(o_orderkey % 900 AS INT)",
}


def roles(*names: str) -> dict[str, str]:
    """Expressions of the named lineitem roles, keys first."""
    known = {**KEYS, **SIGNAL, **TRACK, **ROLE}
    return {**KEYS, **{n: known[n] for n in names}}


def tracks(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Track table with the row keys and the named roles."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in roles(*names).items()])


def tracks_sql(*names: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in roles(*names).items()) + " FROM lineitem"


def candidates(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Event table (one row per order) with the named roles."""
    return table(spark, sf_dir, "orders").selectExpr(*[f"{ORDER_ROLE[n]} AS {n}" for n in names])


def candidates_sql(*names: str) -> str:
    return "SELECT " + ", ".join(f"{ORDER_ROLE[n]} AS {n}" for n in names) + " FROM orders"


# A cut text of the form used for opposite-side kaons.
KAON_CUT = """(B_Tr_T_PROBNN_E <= 0.6606) & (B_Tr_T_PROBNN_MU <= 0.6472) & (B_Tr_T_diff_z <= 6.7063) & (B_Tr_T_PROBNN_PI <= 0.9496) & (B_Tr_T_IPChi2BVTX > 9.2305) & (B_Tr_T_PROBNN_K > 0.4192) & (B_Tr_T_Origin_Flag !=0)
OR
(B_Tr_T_PROBNN_E <= 0.6606) & (B_Tr_T_PROBNN_MU <= 0.6472) & (B_Tr_T_diff_z > 6.7063) & (B_Tr_T_OWNPVIPCHI2 > 16.7833) & (B_Tr_T_Origin_Flag !=0)"""
CUT_ROLES = (
    "B_Tr_T_PROBNN_E", "B_Tr_T_PROBNN_MU", "B_Tr_T_diff_z", "B_Tr_T_PROBNN_PI", "B_Tr_T_IPChi2BVTX",
    "B_Tr_T_PROBNN_K", "B_Tr_T_OWNPVIPCHI2", "B_Tr_T_Origin_Flag", "B_Tr_T_IsInTree",
)

# The light selection used where tagging, not the cut itself, is the subject.
LIGHT_CUT = """(prob_k > 0.3) & (prob_mu <= 0.9)
OR
(prob_e > 0.7)"""


def tagging_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with charge, classifier outputs and light-cut inputs, for the tagging chain."""
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in TAGGING_ROLES.items()])


TAGGING_ROLES = {
    **KEYS,
    "charge": "CASE WHEN l_returnflag = 'N' THEN 1 ELSE -1 END",
    "prob": "l_extendedprice / 1.05e5",
    "prob2": "1e0 - l_quantity / 5.1e1",
    "prob_k": "l_quantity / 5e1",
    "prob_mu": "l_discount * 1e1",
    "prob_e": "l_tax * 1.25e1",
    "line": "l_linestatus",
    "flag": "l_returnflag",
}
TAGGING_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in TAGGING_ROLES.items()) + " FROM lineitem"

# tracks -> selected -> decision and folded mistag -> best track per event, in checker SQL
TAGGED_SQL = f"""t0 AS ({TAGGING_SQL}),
t1 AS (SELECT *, CASE WHEN (prob_k > 0.3 AND prob_mu <= 0.9) OR prob_e > 0.7 THEN 1 ELSE 0 END AS selected,
       -charge AS d0, 1e0 - prob AS e0 FROM t0),
tagged AS MATERIALIZED (SELECT *, CAST(CASE WHEN selected = 0 THEN 0 WHEN e0 > 0.5 THEN -d0 ELSE d0 END AS INT) AS d,
       CASE WHEN selected = 0 THEN 5e-1 WHEN e0 > 0.5 THEN 1e0 - e0 ELSE e0 END AS eta FROM t1)"""
BEST_SQL = f"""{TAGGED_SQL},
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry
       ORDER BY selected DESC, eta, subentry, track_part, track_supp, d) AS rn FROM tagged) WHERE rn = 1),
ev AS (SELECT b.entry, b.d, b.eta, b.selected, o.run, o.B_ID, o.mass, o.mass_peak, o.FillNumber, o.B_DTF_PV_CTAU, o.B_PT,
       o.B_ETA, o.B_nPVs, o.B_nTracks FROM best b JOIN ({candidates_sql(*ORDER_ROLE)}) o ON b.entry = o.entry)"""


def tagged_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track table with selected, decision ``d`` and folded mistag ``eta``."""
    marked = add_selected(tagging_tracks(spark, sf_dir), LIGHT_CUT)
    decision = tag_decision(F.col("charge"), "Bu2JpsiK", "OSKaon")
    return marked.withColumns(
        {
            "d": final_decision(decision, F.col("prob"), F.col("selected")),
            "eta": final_mistag(F.col("prob"), F.col("selected")),
        }
    )


def best_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: its best track's decision and mistag."""
    slim = tagged_tracks(spark, sf_dir).select(*ROW_KEYS, "selected", "d", "eta")
    return best_track_per_event(
        slim, ["entry"], "selected", "eta", ["subentry", "track_part", "track_supp", "d"]
    )


def tagged_events(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Best tracks joined with the named event roles (``entry, d, eta, selected`` plus names)."""
    best = best_tracks(spark, sf_dir).select("entry", "d", "eta", "selected")
    return best.join(candidates(spark, sf_dir, "entry", *names), "entry")


# hyper-parameter results: one row per (tagger, seed, layers, batch size), figures from track columns
GRID_SQL = """SELECT CASE l_returnflag WHEN 'A' THEN 'OSKaon' WHEN 'N' THEN 'OSMuon' ELSE 'SSPion' END AS tagger,
  CAST(l_suppkey % 5 AS INT) AS seed, l_linenumber AS numlayers, CAST(128 * (1 + l_partkey % 4) AS INT) AS batch_size,
  count(*) AS n, round(avg(l_discount), 9) AS power, round(sqrt(avg(l_tax * l_tax)) / 1e1, 9) AS sigma,
  round(avg(l_quantity) / 1e3, 9) AS sigma_cal
  FROM lineitem
  GROUP BY l_returnflag, l_suppkey % 5, l_linenumber, l_partkey % 4"""


def grid_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyper-parameter results derived from the track table."""
    lines = table(spark, sf_dir, "lineitem")
    tagger = F.expr("CASE l_returnflag WHEN 'A' THEN 'OSKaon' WHEN 'N' THEN 'OSMuon' ELSE 'SSPion' END")
    return lines.groupBy(
        tagger.alias("tagger"),
        (F.col("l_suppkey") % 5).cast("int").alias("seed"),
        F.col("l_linenumber").alias("numlayers"),
        (128 * (1 + F.col("l_partkey") % 4)).cast("int").alias("batch_size"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        fixed(F.avg("l_discount"), 9).alias("power"),
        fixed(F.sqrt(F.avg(F.col("l_tax") * F.col("l_tax"))) / 10.0, 9).alias("sigma"),
        fixed(F.avg("l_quantity") / 1000.0, 9).alias("sigma_cal"),
    )
