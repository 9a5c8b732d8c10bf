"""Column functions and cuts on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tagloom.functions import kinematics as kin
from tagloom.functions import tagging as tag
from tagloom.functions import transforms as tr
from tagloom.operators import cuts, features


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("a,b", [(3.1, -3.1), (0.0, 0.0), (1.0, 2.5), (-2.0, 2.9)])
def test_phi_distance_wraps(spark, a, b):
    got = one(spark, kin.phi_distance(F.col("a"), F.col("b")), a=a, b=b)
    want = math.atan2(
        math.cos(b) * math.sin(a) - math.cos(a) * math.sin(b), math.cos(b) * math.cos(a) + math.sin(a) * math.sin(b)
    )
    assert got == pytest.approx(want, abs=1e-12) and -math.pi <= got <= math.pi


def test_cos_theta_star_is_a_boost(spark):
    parent, daughter, m, dm = np.array([300.0, -200.0, 5000.0]), np.array([100.0, 50.0, 900.0]), 5279.0, 139.57
    e, de = math.sqrt(m * m + parent @ parent), math.sqrt(dm * dm + daughter @ daughter)
    beta = parent / e
    gamma = 1 / math.sqrt(1 - beta @ beta)
    rest = daughter + ((gamma - 1) * (beta @ daughter) / (beta @ beta) - gamma * de) * beta
    got = one(
        spark,
        kin.cos_theta_star(F.lit(m), tuple(F.lit(float(x)) for x in parent), F.lit(dm), tuple(F.lit(float(x)) for x in daughter)),
    )
    assert got == pytest.approx(rest[2] / np.linalg.norm(rest), rel=1e-9)
    at_rest = kin.cos_theta_star(F.lit(m), (F.lit(0.0),) * 3, F.lit(dm), tuple(F.lit(float(x)) for x in daughter))
    assert one(spark, at_rest) == pytest.approx(daughter[2] / np.linalg.norm(daughter))


def test_near_zero_guards(spark):
    zero = (F.lit(0.0),) * 3
    assert one(spark, kin.approach_parameter((F.lit(1.0),) * 3, zero, zero)) is None
    assert one(spark, kin.safe_log(F.lit(0.0))) is None
    assert math.isnan(one(spark, F.sqrt(F.lit(-1.0))))


@pytest.mark.parametrize("x,want", [(1.0, -math.log(1e-6)), (0.0, math.log(1 + 1e-6)), (-1.0, math.log(1e-6)), (1.5, 0.0)])
def test_transformed_direction(spark, x, want):
    assert one(spark, kin.transformed_direction(F.lit(x))) == pytest.approx(want, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("power", [-1.0, 0.0, 0.5, 2.0])
@pytest.mark.parametrize("x", [-3.0, -0.1, 0.0, 0.1, 4.0])
def test_yeo_johnson(spark, x, power):
    if x >= 0:
        want = math.log(x + 1) if power == 0 else ((x + 1) ** power - 1) / power
    else:
        want = -math.log(1 - x) if power == 2 else -((1 - x) ** (2 - power) - 1) / (2 - power)
    assert one(spark, tr.yeo_johnson(F.lit(x), power)) == pytest.approx(want, abs=1e-12)


def test_tag_decision_table(spark):
    table = {("Bs2DsPi", "SSKaon"): 1, ("Bd2JpsiKst", "SSPion"): 1, ("Bd2JpsiKst", "SSProton"): -1, ("Bu2JpsiK", "SSPion"): -1, ("Bs2DsPi", "OSKaon"): -1}
    for (decay, tagger), want in table.items():
        assert one(spark, tag.tag_decision(F.lit(1), decay, tagger)) == want


def test_time_units(spark):
    assert one(spark, tag.decay_time(F.lit(0.3), "c_ps")) == pytest.approx(0.3 / 0.29979)
    assert one(spark, tag.decay_time(F.lit(0.3), "fs")) == pytest.approx(300.0)
    with pytest.raises(ValueError):
        tag.decay_time(F.lit(1.0), "s")


def test_mixing_probability_limits(spark):
    assert one(spark, tag.mixing_probability(F.lit(0.0), 0.5)) == 0.0
    assert one(spark, tag.mixing_probability(F.lit(math.pi / 0.5), 0.5)) == pytest.approx(1.0)


def test_cut_text_translation():
    text = "(a <= 0.5) & (b == 2) & (B_Tr_T_Origin_Flag !=0)\nOR\n\n(a > 3)"
    assert cuts.cut_predicate(text) == "((a <= 0.5)  AND  (b = 2)  AND  (B_Tr_T_Origin_Flag !=0)) OR ((a > 3))"
    assert "(B_Tr_T_IsInTree != 1)" in cuts.cut_predicate(text, data=True)
    with pytest.raises(ValueError):
        cuts.cut_predicate("OR\n")


def test_cut_rejects_unknown_columns(spark):
    with pytest.raises(AnalysisException):
        cuts.add_selected(spark.range(1), "(nope > 1)").collect()


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, k int")
    assert [r.k for r in cuts.drop_incomplete(df, ["x"]).collect()] == [1]
    assert [r.selected for r in cuts.add_selected(df.filter("k <> 2"), "(x > 0)").orderBy("k").collect()] == [1, 0]


def test_origin_order_matters(spark):
    df = spark.createDataFrame([(11, 2, 22), (11, 2, 5), (321, 1, 0), (2212, 2, 0), (13, 100, 0), (99, 1, 0)], "i int, o int, m int")
    plain = cuts.origin_class(F.col("i"), F.col("o"), F.col("m"))
    merged = cuts.origin_class(F.col("i"), F.col("o"), F.col("m"), merge_same_side=True)
    got = df.select(plain.alias("a"), merged.alias("b")).collect()
    assert [r.a for r in got] == ["Others", "OSElectron", "SSKaon", "Others", "notSamePV", "Others"]
    assert [r.b for r in got] == ["Others", "OSElectron", "SSProton+SSKaon", "OSProton", "notSamePV", "Others"]


def test_rename_only_at_word_boundaries():
    assert cuts.rename_in_text("min(lab3_PT, lab33_PT) > lab0_M") == "min(hplus_PT, lab33_PT) > B_M"


def test_truth_columns_removed():
    assert cuts.without_truth(["B_TRUEID", "B_PT", "B_BKGCAT", "B_Tr_T_Origin_Flag", "B_Tr_T_MC_MOTHER_ID"]) == ["B_PT"]


def test_blocks_overlap(spark):
    df = spark.createDataFrame([(9960,), (9982,), (10000,), (9912,), (1,)], "f int")
    got = sorted((r.f, r.block) for r in cuts.label_blocks(df, "f").collect())
    assert got == [(9912, "2_3"), (9912, "3"), (9960, "1_2"), (9960, "2"), (9960, "2_3"), (9982, "1_2"), (10000, "1"), (10000, "1_2")]


def test_all_features_on_physics_columns(spark):
    columns = {
        "entry": 1, "B_PHI": 0.1, "B_ETA": 3.0, "B_PX": 100.0, "B_PY": 50.0, "B_PZ": 9000.0, "B_P": 9001.0, "B_M": 5279.0, "B_ENERGY": 10440.0,
        "B_OWNPV_Z": 1.0, "B_ENDV_X": 0.5, "B_ENDV_Y": 0.2, "B_ENDV_Z": 12.0, "B_Tr_T_PX": 300.0, "B_Tr_T_PY": -20.0, "B_Tr_T_PZ": 4000.0,
        "B_Tr_T_P": 4011.0, "B_Tr_T_PT": 301.0, "B_Tr_T_Eta": 3.2, "B_Tr_T_Phi": -0.2, "B_Tr_T_X": 0.1, "B_Tr_T_Y": 0.1, "B_Tr_T_Z": 3.0,
        "B_Tr_T_firstZ": 10.0, "B_Tr_T_OWNPV_Z": 0.0, "B_Tr_T_OWNPVIP": -0.3, "B_Tr_T_OWNPVIPCHI2": 4.0, "B_Tr_T_TRUE_PARTICLE_ID": -321,
    }
    df = spark.createDataFrame([tuple(columns.values())], list(columns))
    row = features.add_features(df, ["entry"]).first()
    assert row["B_Tr_T_OWNPVIPSig"] == 2.0 and row["B_Tr_T_absOWNPV_IP"] == 0.3 and row["B_Tr_T_absID"] == 321
    assert row["B_Tr_T_minPhiDistance"] == pytest.approx(0.3) and row["B_Tr_T_DeltaR"] == pytest.approx(0.04 + 0.09)
    e = math.sqrt(493.677**2 + 300**2 + 20**2 + 4000**2)
    want = math.sqrt((e + 10440.0) ** 2 - (400.0**2 + 30.0**2 + 13000.0**2)) - 5279.0 - 493.677
    assert row["B_Tr_T_DeltaQ_Kaon"] == pytest.approx(want)
    assert not [c for c in row.asDict() if c in ("x_arctan", "y_arctan")]
