"""Catalogue: derived columns, predicates and labels (row-preserving or plain filters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import kinematics as kin
from tagloom.functions import tagging as tag
from tagloom.functions.transforms import fixed
from tagloom.operators import cuts, events, expressions, features
from tagloom.plans import bindings as b
from tagloom.plans.registry import query

K = "entry, subentry, track_part, track_supp"
B = ("B_PX", "B_PY", "B_PZ")
T = ("B_Tr_T_PX", "B_Tr_T_PY", "B_Tr_T_PZ")


def rounded(df: DataFrame, columns: dict, digits: int = 6) -> DataFrame:
    """Row keys plus the named expressions rounded for comparison."""
    return df.select(*b.ROW_KEYS, *[fixed(c, digits).alias(n) for n, c in columns.items()])


def src(*names: str) -> str:
    return f"({b.tracks_sql(*names)})"


@query(
    "P1_phi_distance",
    f"""SELECT {K}, round(atan2(cos(B_Tr_T_Phi) * sin(B_PHI) - cos(B_PHI) * sin(B_Tr_T_Phi),
      cos(B_Tr_T_Phi) * cos(B_PHI) + sin(B_PHI) * sin(B_Tr_T_Phi)), 6) + 0e0 AS dphi
      FROM {src("B_PHI", "B_Tr_T_Phi")}""",
)
def phi_distance(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_PHI", "B_Tr_T_Phi")
    return rounded(df, {"dphi": kin.phi_distance(F.col("B_PHI"), F.col("B_Tr_T_Phi"))})


@query(
    "P2_min_abs_per_event",
    f"""WITH t AS (SELECT *, atan2(sin(B_PHI - B_Tr_T_Phi), cos(B_PHI - B_Tr_T_Phi)) AS dphi
      FROM {src("B_PHI", "B_Tr_T_Phi")})
      SELECT {K}, round(dphi, 6) + 0e0 AS dphi, round(min(abs(dphi)) OVER (PARTITION BY entry), 6) AS min_dphi FROM t""",
)
def min_abs_per_event(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_PHI", "B_Tr_T_Phi")
    df = df.withColumn("dphi", kin.phi_distance(F.col("B_PHI"), F.col("B_Tr_T_Phi")))
    df = events.min_abs_per_event(df, "dphi", ["entry"], "min_dphi")
    return rounded(df, {"dphi": F.col("dphi"), "min_dphi": F.col("min_dphi")})


@query(
    "P2_min_abs_nested",
    """SELECT vec_id, label, round(CAST(list_min(list_transform(embedding, lambda x: abs(x))) AS DOUBLE), 6) AS min_abs
      FROM embeddings""",
)
def min_abs_nested(spark: SparkSession, sf: str) -> DataFrame:
    df = events.min_abs_nested(b.table(spark, sf, "embeddings"), "embedding", None, "min_abs")
    return df.select("vec_id", "label", fixed(F.col("min_abs").cast("double"), 6).alias("min_abs"))


@query(
    "P3_angular_features",
    f"""WITH t AS (SELECT *, atan2(sin(B_PHI - B_Tr_T_Phi), cos(B_PHI - B_Tr_T_Phi)) AS dphi
      FROM {src("B_PHI", "B_Tr_T_Phi", "B_ETA", "B_Tr_T_Eta")})
      SELECT {K}, round(cos(dphi), 6) + 0e0 AS cos_dphi, round(abs(B_ETA - B_Tr_T_Eta), 6) AS deta,
      round(pow(B_ETA - B_Tr_T_Eta, 2) + pow(dphi, 2), 6) AS delta_r FROM t""",
)
def angular_features(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_PHI", "B_Tr_T_Phi", "B_ETA", "B_Tr_T_Eta")
    df = df.withColumn("dphi", kin.phi_distance(F.col("B_PHI"), F.col("B_Tr_T_Phi")))
    eta_b, eta_t = F.col("B_ETA"), F.col("B_Tr_T_Eta")
    return rounded(
        df,
        {
            "cos_dphi": F.cos("dphi"),
            "deta": kin.eta_distance(eta_b, eta_t),
            "delta_r": kin.delta_r2(eta_b, eta_t, F.col("dphi")),
        },
    )


def _release_sql(name: str, mass: float) -> str:
    m = f"CAST({mass} AS DOUBLE)"
    track = " + ".join(f"{c} * {c}" for c in T)
    pair = " + ".join(f"pow({x} + {y}, 2)" for x, y in zip(T, B))
    return (
        f"round(sqrt(pow(sqrt({m} * {m} + {track}) + B_ENERGY, 2) - ({pair})) - B_M - {m}, 4)"
        f" AS B_Tr_T_DeltaQ_{name}"
    )


@query(
    "P4_delta_q",
    f"SELECT {K}, {', '.join(_release_sql(n, m) for n, m in kin.HYPOTHESIS_MASSES.items())}"
    f" FROM {src(*B, *T, 'B_ENERGY', 'B_M')}",
)
def delta_q(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, *B, *T, "B_ENERGY", "B_M")
    return rounded(df, features.energy_releases(), 4)


@query(
    "P5_vertex_diffs_xy",
    f"""SELECT {K}, round(abs(B_ENDV_X - B_Tr_T_firstX), 6) AS B_Tr_T_endSV_X, round(abs(B_ENDV_Y - B_Tr_T_firstY), 6) AS B_Tr_T_endSV_Y
      FROM {src("B_ENDV_X", "B_Tr_T_firstX", "B_ENDV_Y", "B_Tr_T_firstY")}""",
)
def vertex_diffs_xy(spark: SparkSession, sf: str) -> DataFrame:
    """Transverse distances of a track's first hit from the decay vertex."""
    df = b.tracks(spark, sf, "B_ENDV_X", "B_Tr_T_firstX", "B_ENDV_Y", "B_Tr_T_firstY")
    return rounded(df, features.end_vertex_distances("XY"))


@query(
    "P5_vertex_diffs",
    f"""SELECT {K}, round(abs(B_OWNPV_Z - B_Tr_T_OWNPV_Z), 6) AS diff_z, round(abs(B_ENDV_Z - B_Tr_T_firstZ), 6) AS end_sv_z
      FROM {src("B_OWNPV_Z", "B_Tr_T_OWNPV_Z", "B_ENDV_Z", "B_Tr_T_firstZ")}""",
)
def vertex_diffs(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_OWNPV_Z", "B_Tr_T_OWNPV_Z", "B_ENDV_Z", "B_Tr_T_firstZ")
    return rounded(
        df,
        {
            "diff_z": F.abs(F.col("B_OWNPV_Z") - F.col("B_Tr_T_OWNPV_Z")),
            "end_sv_z": F.abs(F.col("B_ENDV_Z") - F.col("B_Tr_T_firstZ")),
        },
    )


@query(
    "P6_pair_pt",
    f"""SELECT {K}, round(sqrt(pow(B_PX + B_Tr_T_PX, 2) + pow(B_PY + B_Tr_T_PY, 2)), 5) AS pair_pt
      FROM {src("B_PX", "B_PY", "B_Tr_T_PX", "B_Tr_T_PY")}""",
)
def pair_pt(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_PX", "B_PY", "B_Tr_T_PX", "B_Tr_T_PY")
    return rounded(df, {"pair_pt": kin.pair_pt(*[F.col(c) for c in df.columns[4:]])}, 5)


@query(
    "P7_ip_features",
    f"""SELECT {K}, round(sqrt(B_Tr_T_OWNPVIPCHI2), 6) AS ip_sig, round(abs(B_Tr_T_OWNPVIP), 6) AS abs_ip
      FROM {src("B_Tr_T_OWNPVIPCHI2", "B_Tr_T_OWNPVIP")}""",
)
def ip_features(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_OWNPVIPCHI2", "B_Tr_T_OWNPVIP")
    return rounded(df, {"ip_sig": F.sqrt("B_Tr_T_OWNPVIPCHI2"), "abs_ip": F.abs("B_Tr_T_OWNPVIP")})


POCA = (
    "B_P", "B_Tr_T_P", "B_Tr_T_PT", *T, "B_Tr_T_X", "B_Tr_T_Y", "B_Tr_T_Z", "B_ENDV_X", "B_ENDV_Y", "B_ENDV_Z",
)


@query(
    "P8_poca_features",
    f"""WITH v AS (SELECT *, (B_ENDV_X * B_ENDV_X + B_ENDV_Y * B_ENDV_Y + B_ENDV_Z * B_ENDV_Z
        - B_ENDV_X * B_Tr_T_X - B_ENDV_Y * B_Tr_T_Y - B_ENDV_Z * B_Tr_T_Z)
        / nullif(B_ENDV_X * B_Tr_T_PX + B_ENDV_Y * B_Tr_T_PY + B_ENDV_Z * B_Tr_T_PZ, 0) AS step FROM {src(*POCA)}),
      e AS (SELECT *, sqrt(pow(B_Tr_T_X + step * B_Tr_T_PX, 2) + pow(B_Tr_T_Y + step * B_Tr_T_PY, 2)
        + pow(B_Tr_T_Z + step * B_Tr_T_PZ, 2)) AS dist FROM v)
      SELECT {K}, round(abs(B_P - B_Tr_T_P), 5) AS diff_p, round(step, 6) + 0e0 AS t, round(dist, 5) AS evip,
      round(ln(CASE WHEN dist > 0 THEN dist END), 5) + 0e0 AS log_evip, round(atan2(B_Tr_T_PT, B_Tr_T_PZ), 6) AS atan_pt_pz FROM e""",
)
def poca_features(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, *POCA)
    made = features.vertex_columns()
    df = df.select(
        *b.ROW_KEYS,
        made["diff_P"].alias("diff_p"),
        made["t"].alias("t"),
        made["EVIP"].alias("evip"),
        made["logEVIP"].alias("log_evip"),
        made["B_Tr_T_atanPT_PZ"].alias("atan_pt_pz"),
    )
    digits = {"diff_p": 5, "t": 6, "evip": 5, "log_evip": 5, "atan_pt_pz": 6}
    return df.select(*b.ROW_KEYS, *[fixed(c, n).alias(c) for c, n in digits.items()])


@query(
    "P9_proj_and_ratio",
    f"""WITH p AS (SELECT *, B_ENERGY * B_Tr_T_ENERGY - (B_Tr_T_PX * B_PX + B_Tr_T_PY * B_PY + B_Tr_T_PZ * B_PZ) AS prod
        FROM {src("B_ENERGY", "B_Tr_T_ENERGY", *B, *T, "B_Tr_T_Charge", "B_Tr_T_P")})
      SELECT {K}, round(prod, 2) AS p_proj, round(ln(CASE WHEN prod > 0 THEN prod END), 6) AS log_p_proj,
      round(B_Tr_T_Charge / B_Tr_T_P, 8) AS e_over_p FROM p""",
)
def proj_and_ratio(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_ENERGY", "B_Tr_T_ENERGY", *B, *T, "B_Tr_T_Charge", "B_Tr_T_P")
    made = features.projection_columns()
    return df.select(
        *b.ROW_KEYS,
        fixed(made["P_proj"], 2).alias("p_proj"),
        fixed(made["logP_proj"], 6).alias("log_p_proj"),
        fixed(made["B_Tr_T_EoverP"], 8).alias("e_over_p"),
    )


@query(
    "P10_abs_id",
    f"SELECT {K}, abs(B_Tr_T_TRUE_PARTICLE_ID) AS abs_id FROM {src('B_Tr_T_TRUE_PARTICLE_ID')}",
)
def abs_id(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_TRUE_PARTICLE_ID")
    return df.select(*b.ROW_KEYS, F.abs("B_Tr_T_TRUE_PARTICLE_ID").alias("abs_id"))


@query("P11_species_filter", f"SELECT {K}, B_TRUEID FROM {src('B_TRUEID')} WHERE abs(B_TRUEID) = 521")
def species_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.keep_species(b.tracks(spark, sf, "B_TRUEID"), "B_TRUEID", tag.species_id("Bu2JpsiK"))


@query("P12_exclude_in_tree", f"SELECT {K}, B_Tr_T_IsInTree FROM {src('B_Tr_T_IsInTree')} WHERE B_Tr_T_IsInTree <> 1")
def exclude_in_tree(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.exclude_signal_tree(b.tracks(spark, sf, "B_Tr_T_IsInTree"), "B_Tr_T_IsInTree")


GAPS = (
    "CASE WHEN l_tax = 0 THEN NULL ELSE l_tax END AS a",
    "CASE WHEN l_discount = 0 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS b",
)


@query(
    "P13_drop_incomplete",
    f"""SELECT {K}, a, b FROM (SELECT {', '.join(f'{e} AS {n}' for n, e in b.KEYS.items())}, {', '.join(GAPS)} FROM lineitem)
      WHERE a IS NOT NULL AND b IS NOT NULL AND NOT isnan(b)""",
)
def drop_incomplete(spark: SparkSession, sf: str) -> DataFrame:
    keys = [f"{e} AS {n}" for n, e in b.KEYS.items()]
    return cuts.drop_incomplete(b.table(spark, sf, "lineitem").selectExpr(*keys, *GAPS), ["a", "b"])


KAON_SQL = """((B_Tr_T_PROBNN_E <= 0.6606 AND B_Tr_T_PROBNN_MU <= 0.6472 AND B_Tr_T_diff_z <= 6.7063
    AND B_Tr_T_PROBNN_PI <= 0.9496 AND B_Tr_T_IPChi2BVTX > 9.2305 AND B_Tr_T_PROBNN_K > 0.4192 AND {s})
  OR (B_Tr_T_PROBNN_E <= 0.6606 AND B_Tr_T_PROBNN_MU <= 0.6472 AND B_Tr_T_diff_z > 6.7063
    AND B_Tr_T_OWNPVIPCHI2 > 16.7833 AND {s}))"""


@query(
    "P14_cut_file_predicate",
    f"""SELECT {K}, CAST({KAON_SQL.format(s='B_Tr_T_Origin_Flag <> 0')} AS INT) AS selected,
      CAST({KAON_SQL.format(s='B_Tr_T_IsInTree <> 1')} AS INT) AS selected_data FROM {src(*b.CUT_ROLES)}""",
)
def cut_file_predicate(spark: SparkSession, sf: str) -> DataFrame:
    df = cuts.add_selected(b.tracks(spark, sf, *b.CUT_ROLES), b.KAON_CUT)
    df = cuts.add_selected(df, b.KAON_CUT, data=True, out="selected_data")
    return df.select(*b.ROW_KEYS, "selected", "selected_data")


@query(
    "P14_cut_file_filter",
    f"SELECT {K} FROM {src(*b.CUT_ROLES)} WHERE {KAON_SQL.format(s='B_Tr_T_Origin_Flag <> 0')}",
)
def cut_file_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.keep_passing(b.tracks(spark, sf, *b.CUT_ROLES), b.KAON_CUT).select(*b.ROW_KEYS)


@query(
    "P16_bkgcat_filter",
    f"""SELECT {K}, decay, B_BKGCAT FROM (SELECT *, CASE WHEN entry % 2 = 0 THEN 'Bs2DsPi' ELSE 'Bu2JpsiK' END AS decay
      FROM {src('B_BKGCAT')}) WHERE B_BKGCAT = CASE WHEN decay = 'Bs2DsPi' THEN 20 ELSE 0 END""",
)
def bkgcat_filter(spark: SparkSession, sf: str) -> DataFrame:
    decay = F.when(F.col("entry") % 2 == 0, "Bs2DsPi").otherwise("Bu2JpsiK")
    df = b.tracks(spark, sf, "B_BKGCAT").withColumn("decay", decay)
    return cuts.keep_background_category(df, "B_BKGCAT", F.col("decay")).select(*b.ROW_KEYS, "decay", "B_BKGCAT")


ORIGIN = ("B_Tr_T_TRUE_PARTICLE_ID", "B_Tr_T_Origin_Flag", "B_Tr_T_MC_MOTHER_ID")
ORIGIN_CASE = """CASE WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 321 AND B_Tr_T_Origin_Flag = 2 THEN 'OSKaon'
  WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 13 AND B_Tr_T_Origin_Flag = 2 THEN 'OSMuon'
  WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 11 AND B_Tr_T_Origin_Flag = 2 AND abs(B_Tr_T_MC_MOTHER_ID) <> 22 THEN 'OSElectron'
  WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 211 AND B_Tr_T_Origin_Flag = 1 THEN 'SSPion'
  {middle}
  WHEN B_Tr_T_Origin_Flag = 100 THEN 'notSamePV' ELSE 'Others' END"""
PLAIN_CASE = ORIGIN_CASE.format(
    middle="""WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 2212 AND B_Tr_T_Origin_Flag = 1 THEN 'SSProton'
  WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 321 AND B_Tr_T_Origin_Flag = 1 THEN 'SSKaon'"""
)
MERGED_CASE = ORIGIN_CASE.format(
    middle="""WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) IN (2212, 321) AND B_Tr_T_Origin_Flag = 1 THEN 'SSProton+SSKaon'
  WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 2212 AND B_Tr_T_Origin_Flag = 2 THEN 'OSProton'"""
)


def classified(df: DataFrame, merged: bool = False, out: str = "particle") -> DataFrame:
    label = cuts.origin_class(
        F.abs("B_Tr_T_TRUE_PARTICLE_ID"),
        F.col("B_Tr_T_Origin_Flag"),
        F.col("B_Tr_T_MC_MOTHER_ID"),
        merge_same_side=merged,
    )
    return df.withColumn(out, label)


@query("P17_origin_class", f"SELECT {K}, {PLAIN_CASE} AS particle, {MERGED_CASE} AS particle_merged FROM {src(*ORIGIN)}")
def origin_class(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(b.tracks(spark, sf, *ORIGIN))
    return classified(df, True, "particle_merged").select(*b.ROW_KEYS, "particle", "particle_merged")


@query("P18_drop_class", f"SELECT * FROM (SELECT {K}, {PLAIN_CASE} AS particle FROM {src(*ORIGIN)}) WHERE particle <> 'Others'")
def drop_class(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.drop_class(classified(b.tracks(spark, sf, *ORIGIN)), "particle").select(*b.ROW_KEYS, "particle")


@query(
    "P19_tag_decision",
    f"""SELECT {K}, CAST(B_Tr_T_Charge AS INT) AS d_bs_sskaon, CAST(-B_Tr_T_Charge AS INT) AS d_bs_ssproton,
      CAST(-B_Tr_T_Charge AS INT) AS d_bu_sskaon, CAST(B_Tr_T_Charge AS INT) AS d_bd_sspion FROM {src('B_Tr_T_Charge')}""",
)
def tag_decision(spark: SparkSession, sf: str) -> DataFrame:
    df, q = b.tracks(spark, sf, "B_Tr_T_Charge"), F.col("B_Tr_T_Charge")
    return df.select(
        *b.ROW_KEYS,
        tag.tag_decision(q, "Bs2DsPi", "SSKaon").alias("d_bs_sskaon"),
        tag.tag_decision(q, "Bs2DsPi", "SSProton").alias("d_bs_ssproton"),
        tag.tag_decision(q, "Bu2JpsiK", "SSKaon").alias("d_bu_sskaon"),
        tag.tag_decision(q, "Bd2JpsiKst", "SSPion").alias("d_bd_sspion"),
    )


@query(
    "P20_tag_label",
    f"""SELECT {K}, CASE WHEN -B_Tr_T_Charge * sign(B_TRUEID) = 1 THEN 1 ELSE 0 END AS label,
      CASE WHEN B_TRUEID > 0 THEN 1 ELSE 0 END AS flavour_label FROM {src('B_Tr_T_Charge', 'B_TRUEID')}""",
)
def tag_label(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_Charge", "B_TRUEID")
    decision = tag.tag_decision(F.col("B_Tr_T_Charge"), "Bu2JpsiK", "OSKaon")
    return df.select(
        *b.ROW_KEYS,
        tag.tag_label(decision, F.col("B_TRUEID")).alias("label"),
        tag.flavour_label(F.col("B_TRUEID")).alias("flavour_label"),
    )


@query("P21_eta_assign_and_flip", f"WITH {b.TAGGED_SQL} SELECT {K}, selected, d, round(eta, 8) AS eta FROM tagged")
def eta_assign_and_flip(spark: SparkSession, sf: str) -> DataFrame:
    return b.tagged_tracks(spark, sf).select(*b.ROW_KEYS, "selected", "d", fixed("eta", 8).alias("eta"))


@query(
    "P22_sign_tag",
    f"SELECT {K}, CAST(sign(B_TRUEID) * B_Tr_T_Charge AS INT) AS sign_tag FROM {src('B_Tr_T_Charge', 'B_TRUEID')}",
)
def sign_tag(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_Charge", "B_TRUEID")
    return df.select(*b.ROW_KEYS, (tag.sign(F.col("B_TRUEID")) * F.col("B_Tr_T_Charge")).cast("int").alias("sign_tag"))


PERIOD = "(2e0 * pi() / 1.7765e1)"


@query(
    "P23_decay_time",
    f"""WITH t AS (SELECT *, B_DTF_PV_CTAU / 2.9979e-1 AS tps FROM ({b.candidates_sql('entry', 'B_DTF_PV_CTAU')}))
      SELECT entry, round(tps, 6) AS time_c_ps, round(B_DTF_PV_CTAU * 1e3, 6) AS time_fs,
      round(B_DTF_PV_CTAU * (1e3 / 2.9979e-1), 6) AS time_c_fs, round(tps - {PERIOD} * floor(tps / {PERIOD}), 6) AS time_mod FROM t""",
)
def decay_time(spark: SparkSession, sf: str) -> DataFrame:
    df, x = b.candidates(spark, sf, "entry", "B_DTF_PV_CTAU"), F.col("B_DTF_PV_CTAU")
    time = tag.decay_time(x, "c_ps")
    return df.select(
        "entry",
        fixed(time, 6).alias("time_c_ps"),
        fixed(tag.decay_time(x, "fs"), 6).alias("time_fs"),
        fixed(tag.decay_time(x, "c_fs"), 6).alias("time_c_fs"),
        fixed(tag.oscillation_phase_time(time, tag.frequency_of("Bs")), 6).alias("time_mod"),
    )


@query("P24_mass_window", f"SELECT * FROM ({b.candidates_sql('entry', 'mass')}) WHERE mass > 5200 AND mass < 5400")
def mass_window(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.mass_window(b.candidates(spark, sf, "entry", "mass"), "mass")


@query(
    "P25_block_filter",
    f"SELECT * FROM ({b.candidates_sql('entry', 'FillNumber')}) WHERE FillNumber > 9911 AND FillNumber < 9978",
)
def block_filter(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.keep_block(b.candidates(spark, sf, "entry", "FillNumber"), "FillNumber", "2_3")


@query(
    "P25_block_labels",
    f"""WITH k(block, lo, hi) AS (VALUES ('1', 9982, 10056), ('2', 9945, 9978), ('3', 9911, 9943), ('2_3', 9911, 9978), ('1_2', 9945, 10056))
      SELECT entry, FillNumber, block FROM ({b.candidates_sql('entry', 'FillNumber')}) c JOIN k ON FillNumber > lo AND FillNumber < hi""",
)
def block_labels(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.label_blocks(b.candidates(spark, sf, "entry", "FillNumber"), "FillNumber")


DAUGHTERS = ("piplus", "hplus", "hminus", "piminus")
LABS = ("lab1", "lab3", "lab4", "lab5")


def _daughter_roles(names: tuple[str, ...]) -> dict[str, str]:
    out = {f"{names[0]}_PID_K": "l_quantity - 4e1"}
    for i, name in enumerate(names):
        out[f"{name}_P"] = f"l_extendedprice * {i + 1}e0 + 1e3"
        out[f"{name}_PT"] = f"l_quantity * {i + 1}e2"
        out[f"{name}_ETA"] = f"1.9e0 + l_quantity * 6e-2 + {i}e-2"
    return out


def _daughters(names: tuple[str, ...]) -> list[str]:
    return [f"{e} AS {n}" for n, e in {**b.KEYS, **_daughter_roles(names)}.items()]


_WINDOWS = " AND ".join(
    f"{d}_P > 2000 AND {d}_P < 150000 AND {d}_PT > 250 AND {d}_PT < 45000 AND {d}_ETA > 2 AND {d}_ETA < 5" for d in DAUGHTERS
)


@query(
    "P26_signal_preselection",
    f"SELECT {K} FROM (SELECT {', '.join(_daughters(DAUGHTERS))} FROM lineitem) WHERE piplus_PID_K < 0 AND {_WINDOWS}",
)
def signal_preselection(spark: SparkSession, sf: str) -> DataFrame:
    df = b.table(spark, sf, "lineitem").selectExpr(*_daughters(DAUGHTERS))
    return cuts.signal_preselection(df).select(*b.ROW_KEYS)


@query("P27_rename_by_prefix_map", f"SELECT {', '.join(_daughters(DAUGHTERS))} FROM lineitem")
def rename_by_prefix_map(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.rename_members(b.table(spark, sf, "lineitem").selectExpr(*_daughters(LABS)))


def _input_roles() -> dict[str, str]:
    """Deterministic positive values for all columns the signal inputs need."""
    needed: dict[str, str] = {}
    for _, (_, columns) in features.SIGNAL_INPUTS.items():
        for c in columns:
            needed.setdefault(c, "")
    for i, c in enumerate(sorted(needed)):
        needed[c] = f"5e-1 + l_quantity / {i + 2}e0 + (l_partkey % {i + 5}) * 1e-1"
    needed.update(
        {
            "piplus_M": "1.3957e2 + l_tax",
            "EVENTNUMBER": "l_orderkey",
            "B_OWNPV_DIRA": "(l_partkey % 2001 - 1000) / 9.9e2",
            "Ds_OWNPV_DIRA": "(l_suppkey % 201 - 100) / 9.9e1",
            "B_M": "5.279e3 + l_quantity",
            "B_PZ": "2e4 + l_extendedprice",
            "piplus_PZ": "5e2 + l_extendedprice / 1e1",
        }
    )
    return needed


INPUT_SQL = "SELECT " + ", ".join(f"{e} AS {n}" for n, e in {**b.KEYS, **_input_roles()}.items()) + " FROM lineitem"
DIRA = "CASE WHEN {0} > 0 AND {0} <= 1 THEN -ln(1e0 + 1e-6 - {0}) WHEN {0} <= 0 AND {0} >= -1 THEN ln(1e0 + 1e-6 + {0}) ELSE 0e0 END"
COS = """(SELECT *, sqrt(B_PX*B_PX + B_PY*B_PY + B_PZ*B_PZ + B_M*B_M) AS er, sqrt(piplus_PX*piplus_PX + piplus_PY*piplus_PY
  + piplus_PZ*piplus_PZ + piplus_M*piplus_M) AS ep, B_PX*piplus_PX + B_PY*piplus_PY + B_PZ*piplus_PZ AS bp FROM i)"""
# rest-frame momentum: p* = p + P * ((p.P) / (E + M) - e) / M
BOOST = f"""j AS (SELECT *, (bp / (er + B_M) - ep) / B_M AS k FROM {COS}),
  c AS (SELECT *, (piplus_PZ + B_PZ * k) / sqrt(pow(piplus_PX + B_PX * k, 2) + pow(piplus_PY + B_PY * k, 2) + pow(piplus_PZ + B_PZ * k, 2)) AS costh FROM j)"""


@query(
    "P28_bdt_inputs",
    f"""WITH i AS ({INPUT_SQL}), {BOOST} SELECT {K}, round(B_OWNPV_CHI2DOF, 5) AS "lab0_CHI2DOF", round(B_OWNPV_IPCHI2, 5) AS "lab0_IPCHI2_OWNPV",
      round(CAST(EVENTNUMBER AS DOUBLE), 5) AS "eventNumber", round({DIRA.format('B_OWNPV_DIRA')}, 5) + 0e0 AS "lab0_DIRA_OWNPV_Transformed",
      round(ln(B_MIN_OWNPV_IPCHI2), 5) + 0e0 AS "lab0_MINIPCHI2_Log",
      round(sqrt(pow(B_ENDV_X - B_OWNPV_X, 2) + pow(B_ENDV_Y - B_OWNPV_Y, 2)), 5) AS "lab0_RFD",
      round(ln(B_ENDV_CHI2DOF), 5) + 0e0 AS "lab0_VCHI2NDOF_Log", round(ln(B_DTF_PV_B_CHI2DOF), 5) + 0e0 AS "lab0_LifetimeFit_VCHI2NDOF_Log",
      round({DIRA.format('Ds_OWNPV_DIRA')}, 5) + 0e0 AS "lab2_DIRA_ORIVX_Transformed", round(ln(Ds_MIN_OWNPV_IPCHI2), 5) + 0e0 AS "lab2_MINIPCHI2_Log",
      round(sqrt(pow(Ds_ENDV_X - Ds_OWNPV_X, 2) + pow(Ds_ENDV_Y - Ds_OWNPV_Y, 2)), 5) AS "lab2_RFD",
      round(ln(Ds_ENDV_CHI2DOF), 5) + 0e0 AS "lab2_VCHI2NDOF_Log", round(ln(piplus_MINIPCHI2), 5) + 0e0 AS "lab1_MINIPCHI2_Log",
      round(piplus_PT, 5) AS "lab1_PT", round(costh, 5) + 0e0 AS "lab1_CosTheta", round(least(hplus_PT, hminus_PT, piminus_PT), 5) AS "lab345_MIN_PT",
      round(ln(least(hplus_OWNPV_IPCHI2, hminus_OWNPV_IPCHI2, piminus_OWNPV_IPCHI2)), 5) + 0e0 AS "lab345_MIN_MINIPCHI2_Log",
      round(greatest(piplus_TRGHOSTPROB, hplus_TRGHOSTPROB, hminus_TRGHOSTPROB, piminus_TRGHOSTPROB), 5) AS "lab1345_TRACK_GhostProb" FROM c""",
)
def bdt_inputs(spark: SparkSession, sf: str) -> DataFrame:
    source = [f"{e} AS {n}" for n, e in {**b.KEYS, **_input_roles()}.items()]
    df = features.signal_inputs(b.table(spark, sf, "lineitem").selectExpr(*source), b.ROW_KEYS)
    return df.select(*b.ROW_KEYS, *[fixed(F.col(c).cast("double"), 5).alias(c) for c in features.SIGNAL_INPUTS])


@query(
    "P29_transform_dira",
    f"""SELECT {K}, round({DIRA.format('x')}, 6) + 0e0 AS dira FROM (SELECT *, (track_part % 2001 - 1000) / 9.9e2 AS x FROM {src()})""",
)
def transform_dira(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf).withColumn("x", (F.col("track_part") % 2001 - 1000) / 990.0)
    return rounded(df, {"dira": kin.transformed_direction(F.col("x"))})


@query("P30_cos_theta_star", f"WITH i AS ({INPUT_SQL}), {BOOST} SELECT {K}, round(costh, 5) + 0e0 AS cos_theta FROM c")
def cos_theta_star(spark: SparkSession, sf: str) -> DataFrame:
    source = [f"{e} AS {n}" for n, e in {**b.KEYS, **_input_roles()}.items()]
    df = b.table(spark, sf, "lineitem").selectExpr(*source)
    parent = tuple(F.col(f"B_P{a}") for a in "XYZ")
    daughter = tuple(F.col(f"piplus_P{a}") for a in "XYZ")
    return rounded(df, {"cos_theta": kin.cos_theta_star(F.col("B_M"), parent, F.col("piplus_M"), daughter)}, 5)


@query(
    "P31_combined_mass",
    f"""WITH e AS (SELECT *, sqrt(493.677e0 * 493.677e0 + {' + '.join(f'{c}*{c}' for c in T)}) AS e1,
        sqrt(B_M * B_M + {' + '.join(f'{c}*{c}' for c in B)}) AS e2 FROM {src(*B, *T, 'B_M')})
      SELECT {K}, round(sqrt(pow(e1 + e2, 2) - pow(B_PX + B_Tr_T_PX, 2) - pow(B_PY + B_Tr_T_PY, 2) - pow(B_PZ + B_Tr_T_PZ, 2)), 4) AS mass FROM e""",
)
def combined_mass(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, *B, *T, "B_M")
    bodies = [
        (F.lit(493.677), features.track_vector()),
        (F.col("B_M"), features.signal_vector()),
    ]
    return rounded(df, {"mass": kin.invariant_mass(bodies)}, 4)


RUN = "255900 + l_orderkey % 400"


@query(
    "P32_good_run_filter",
    f"SELECT {K}, run FROM (SELECT *, 255900 + entry % 400 AS run FROM {src()}) WHERE run IN ({', '.join(map(str, cuts.GOOD_RUNS))})",
)
def good_run_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf).withColumn("run", F.lit(255900) + F.col("entry") % 400)
    return cuts.good_runs(df, "run")


@query(
    "P33_quality_gate",
    f"""SELECT {K}, CASE WHEN chi >= 0 AND chi <= 20 AND ip >= 0 THEN round(prob, 8) ELSE -2e0 END AS score
      FROM (SELECT *, B_Tr_T_OWNPVIPCHI2 - 1e1 AS chi, B_Tr_T_OWNPVIP AS ip FROM {src('B_Tr_T_OWNPVIPCHI2', 'B_Tr_T_OWNPVIP', 'prob')})""",
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_OWNPVIPCHI2", "B_Tr_T_OWNPVIP", "prob")
    passed = cuts.quality_passed(F.col("B_Tr_T_OWNPVIPCHI2") - 10.0, F.col("B_Tr_T_OWNPVIP"))
    return df.select(*b.ROW_KEYS, cuts.gated_score(fixed("prob", 8), passed).alias("score"))


@query(
    "P34_float_downcast",
    f"SELECT {K}, CAST(CAST(prob AS FLOAT) AS DOUBLE) AS prob32 FROM {src('prob')}",
)
def float_downcast(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "prob")
    return df.select(*b.ROW_KEYS, F.col("prob").cast("float").cast("double").alias("prob32"))


FORMULAS = {
    "ratio": "abs(B_Tr_T_PIDK) / (1 + B_Tr_T_PT)",
    "bounded": "min(max(prob, 0.1), 0.9)",
    "angle": "arctan2(sin(prob), cos(prob)) - sqrt(prob) * 2.5e-1",
    "passes": "(prob > 0.25) & !(B_Tr_T_PIDK == 0) | prob >= 0.9",
}


@query(
    "X1_formula_dictionary",
    f"""SELECT {K}, round(abs(B_Tr_T_PIDK) / (1 + B_Tr_T_PT), 8) AS ratio, round(least(greatest(prob, 1e-1), 9e-1), 8) AS bounded,
      round(atan2(sin(prob), cos(prob)) - sqrt(prob) * 2.5e-1, 8) + 0e0 AS angle, (prob > 2.5e-1 AND NOT (B_Tr_T_PIDK = 0)) OR prob >= 9e-1 AS passes
      FROM {src("B_Tr_T_PIDK", "B_Tr_T_PT", "prob")}""",
)
def formula_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Columns from user-written formulas."""
    df = expressions.derive(b.tracks(spark, sf, "B_Tr_T_PIDK", "B_Tr_T_PT", "prob"), FORMULAS)
    kept = df.select(*b.ROW_KEYS, *FORMULAS)
    return kept.withColumns({n: fixed(F.col(n), 8) for n in ("ratio", "bounded", "angle")})
