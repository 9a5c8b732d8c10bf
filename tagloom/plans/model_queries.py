"""Catalogue: preprocessing, scoring, training, mass model, sWeights, calibration, combination."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions import tagging as tag
from tagloom.functions.transforms import fixed
from tagloom.operators import calibration, cuts, group_calibration, joins, models, networks, preprocessing, stats, training, trees, weights
from tagloom.operators.sampling import hash_split
from tagloom.plans import bindings as b
from tagloom.plans import chains, stat_queries, tree_sql
from tagloom.plans.column_queries import K, src
from tagloom.plans.event_queries import PER_TAGGER, per_tagger_events
from tagloom.plans.flagship import FIGURES, performance_sql, rounded
from tagloom.plans.registry import query
from tagloom.session import shared_dir, stored
from tagloom.sources import results
from tagloom.sources import tables as tables_of

# preprocessing ----------------------------------------------------------------------------------------


@query(
    "M5_standard_scale",
    f"""WITH t AS {src('B_Tr_T_PT', 'B_Tr_T_PIDK', 'prob')}, m AS (SELECT avg(B_Tr_T_PT) AS a, stddev_pop(B_Tr_T_PT) AS sa, avg(B_Tr_T_PIDK) AS c,
        stddev_pop(B_Tr_T_PIDK) AS sc, avg(prob) AS e, stddev_pop(prob) AS se FROM t)
      SELECT {K}, round((B_Tr_T_PT - a) / sa, 6) + 0e0 AS B_Tr_T_PT, round((B_Tr_T_PIDK - c) / sc, 6) + 0e0 AS B_Tr_T_PIDK, round((prob - e) / se, 6) + 0e0 AS prob FROM t, m""",
)
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    names = ["B_Tr_T_PT", "B_Tr_T_PIDK", "prob"]
    df = b.tracks(spark, sf, *names)
    return rounded(preprocessing.apply_scaler(df, preprocessing.fit_scaler(df, names)), *names, digits=6)


def _yj(x: str, p: str) -> str:
    return f"""CASE WHEN {x} >= 0 THEN CASE WHEN {p} = 0 THEN ln({x} + 1) ELSE (pow({x} + 1, {p}) - 1) / {p} END
      ELSE CASE WHEN {p} = 2 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {p}) - 1) / (2 - {p}) END END"""


POWERS = {"p_half": 0.5, "p_zero": 0.0, "p_two": 2.0, "p_neg": -0.7}


@query(
    "M6_yeo_johnson_apply",
    f"SELECT {K}, " + ", ".join(f"round({_yj('B_Tr_T_PIDK', f'CAST({p} AS DOUBLE)')}, 6) + 0e0 AS {n}" for n, p in POWERS.items()) + f" FROM {src('B_Tr_T_PIDK')}",
)
def yeo_johnson_apply(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_PIDK").withColumns({n: F.col("B_Tr_T_PIDK") for n in POWERS})
    return rounded(preprocessing.apply_power(df, POWERS), *POWERS, digits=6).drop("B_Tr_T_PIDK")


def _power_fit_sql() -> str:
    grid = "(SELECT f, round(lo + (hi - lo) * unnest(range(13)) / 12e0, 12) AS lam FROM {span})"
    ctes = [
        "x AS (SELECT 'pidk' AS f, (l_quantity - 2.55e1) / 1e1 AS v FROM lineitem UNION ALL SELECT 'prob', l_extendedprice / 1.05e5 FROM lineitem)",
        "s0 AS (SELECT DISTINCT f, -2e0 AS lo, 4e0 AS hi FROM x)",
    ]
    rounds = 9  # steps shrink by 6 from 0.5 to 3e-7
    for i in range(rounds):
        ctes.append(
            f"l{i} AS (SELECT g.f, g.lam, -5e-1 * count(*) * ln(var_pop({_yj('v', 'lam')})) + (lam - 1) * sum(sign(v) * ln(1 + abs(v))) AS llf "
            f"FROM x JOIN {grid.format(span=f's{i}')} g ON x.f = g.f GROUP BY g.f, g.lam)"
        )
        ctes.append(f"b{i} AS (SELECT f, arg_max(lam, llf) AS lam, max(llf) AS llf FROM l{i} GROUP BY f)")
        step = f"(s{i}.hi - s{i}.lo) / 12e0"
        ctes.append(f"s{i + 1} AS (SELECT f, lam - {step} AS lo, lam + {step} AS hi FROM b{i} JOIN s{i} USING (f))")
    return "WITH " + ", ".join(ctes) + " SELECT f AS feature, round(lam, 4) + 0e0 AS power, round(llf, 2) AS llf FROM b8"


@query("M7_yeo_johnson_fit", _power_fit_sql())
def yeo_johnson_fit(spark: SparkSession, sf: str) -> DataFrame:
    df = b.table(spark, sf, "lineitem").selectExpr("(l_quantity - 2.55e1) / 1e1 AS pidk", "l_extendedprice / 1.05e5 AS prob")
    found = preprocessing.fit_powers(df, ["pidk", "prob"])
    rows = [(f, round(p, 4), round(llf, 2)) for f, (p, llf) in found.items()]
    return spark.createDataFrame(rows, "feature string, power double, llf double")


# networks -----------------------------------------------------------------------------------------------

NET_INPUTS = ("prob", "B_Tr_T_PROBNN_K", "B_Tr_T_PROBNN_MU")
NET = networks.Network.initial(3, [4, 4], seed=6)
VECTOR_NET = networks.Network.initial(64, [8], seed=6)


def _net_sql(source: str, inputs: list[str], net: networks.Network, keys: str, first: str | None = None) -> str:
    """Nested relations, one per layer."""
    relation, names = source, inputs
    for depth, (w, c) in enumerate(net.layers):
        made, last = [], depth == len(net.layers) - 1
        for unit in range(w.shape[0]):
            if depth == 0 and first:
                terms = f"list_dot_product(CAST({first} AS DOUBLE[]), [{', '.join(f'{x:.17e}' for x in w[unit])}])"
            else:
                terms = " + ".join(f"{x:.17e} * {n}" for x, n in zip(w[unit], names))
            z = f"({c[unit]:.17e} + {terms})"
            made.append(f"round(1e0 / (1e0 + exp(-{z})), 8) AS prob_nn" if last else f"CASE WHEN {z} > 0 THEN {z} ELSE exp({z}) - 1 END AS h{depth}_{unit}")
        relation = f"(SELECT {keys}, {', '.join(made)} FROM {relation})"
        names = [f"h{depth}_{u}" for u in range(w.shape[0])]
    return f"SELECT * FROM {relation}"


@query("M8_nn_score", _net_sql(src(*NET_INPUTS), list(NET_INPUTS), NET, K))
def nn_score(spark: SparkSession, sf: str) -> DataFrame:
    made = networks.score(b.tracks(spark, sf, *NET_INPUTS), NET_INPUTS, NET, "prob_nn")
    return rounded(made, "prob_nn").select(*b.ROW_KEYS, "prob_nn")


@query("M8_nn_score_columns", _net_sql(src(*NET_INPUTS), list(NET_INPUTS), NET, K))
def nn_score_columns(spark: SparkSession, sf: str) -> DataFrame:
    made = networks.score_columns(b.tracks(spark, sf, *NET_INPUTS), NET_INPUTS, NET, "prob_nn")
    return rounded(made, "prob_nn").select(*b.ROW_KEYS, "prob_nn")


@query("M8_nn_score_vector", _net_sql("embeddings", [], VECTOR_NET, "vec_id", "embedding"))
def nn_score_vector(spark: SparkSession, sf: str) -> DataFrame:
    made = networks.score_vector(b.table(spark, sf, "embeddings"), "embedding", VECTOR_NET, "prob_nn")
    return rounded(made, "prob_nn").select("vec_id", "prob_nn")


def training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Features with a learnable label and a validation flag."""
    df = b.tracks(spark, sf, *NET_INPUTS)
    label = (F.col("prob") + F.col("B_Tr_T_PROBNN_K") + (F.col("track_part") % 7) / 10.0 > 1.3).cast("int")
    return df.withColumns({"label": label, "held": (F.col("entry") % 5 == 0).cast("int")})


NET_PLAN = training.Plan((16, 16), learning_rate=1e-2, batch_size=4096, dropout=0.1, min_delta=1e-3)
NET_GRID = training.grid([1e-4, 1e-3, 1e-2], [2048, 4096, 8192], [1, 2, 3], [3, 8, 16], dropout=0.1, min_delta=3e-3)


@query("M9_nn_train")
def nn_train(spark: SparkSession, sf: str) -> DataFrame:
    """Losses by epoch of a mini-batch training with dropout, up to its early stop."""
    df = training_rows(spark, sf)
    return training.train(df, NET_INPUTS, "label", "held", b.ROW_KEYS, NET_PLAN).loss_table(df)


def _raw_net(sql: str) -> str:
    """Network scores as they are, not rounded."""
    return sql.replace("round(1e0 / (1e0 + exp(-", "(1e0 / (1e0 + exp(-").replace("))), 8) AS prob_nn", ")))) AS prob_nn")


def _logistic_sql(steps: int = 12) -> str:
    """Newton's method on the likelihood of intercept and slope."""
    net = _net_sql(src(*NET_INPUTS), list(NET_INPUTS), NET, K + ", (prob + B_Tr_T_PROBNN_K + (track_part % 7) / 1e1 > 1.3) AS label")
    for depth in range(len(NET.layers) - 1):  # the label is made with the first layer and carried on
        net = net.replace("(prob + B_Tr_T_PROBNN_K + (track_part % 7) / 1e1 > 1.3) AS label", "label", 1)
    ctes = [f"n AS MATERIALIZED (SELECT label::INT AS label, prob_nn AS nn FROM ({_raw_net(net)}))", "b0 AS (SELECT 0e0 AS a, 0e0 AS s)"]
    for i in range(steps):
        sums = "sum(label - p) AS g0, sum((label - p) * nn) AS g1, sum(p * (1 - p)) AS h0, sum(p * (1 - p) * nn) AS h1, sum(p * (1 - p) * nn * nn) AS h2"
        ctes.append(f"c{i} AS (SELECT any_value(a) AS a, any_value(s) AS s, {sums} FROM (SELECT *, 1e0 / (1e0 + exp(-a - s * nn)) AS p FROM n, b{i}))")
        ctes.append(f"b{i + 1} AS (SELECT a + (h2 * g0 - h1 * g1) / (h0 * h2 - h1 * h1) AS a, s + (h0 * g1 - h1 * g0) / (h0 * h2 - h1 * h1) AS s FROM c{i})")
    return (
        f"WITH {', '.join(ctes)} SELECT label, count(*) AS n, round(avg(nn), 6) + 0e0 AS mean_score, round(avg(1e0 / (1e0 + exp(-a - s * nn))), 5) + 0e0 AS mean_probability "
        f"FROM n, b{steps} GROUP BY label"
    )


@query("M10_logreg_on_score", _logistic_sql())
def logreg_on_score(spark: SparkSession, sf: str) -> DataFrame:
    """Regression of the label on the network output; the score distribution before and after."""
    df = training_rows(spark, sf)
    scored = networks.score_columns(df, NET_INPUTS, NET, "nn").select("nn", "label")
    model = models.logistic_on_score(scored, "nn", "label")
    sums = models.predict(model, scored, ["nn"], "p").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("nn").alias("mean_score"), F.avg("p").alias("mean_probability")
    )
    return rounded(rounded(sums, "mean_score", digits=6), "mean_probability", digits=5)


@query("M11_grid_search")
def grid_search(spark: SparkSession, sf: str) -> DataFrame:
    """All 81 networks of the grid, trained in one scan an epoch, each up to its own stop."""
    df = training_rows(spark, sf)
    return training.scan_table(df, NET_GRID, training.train_many(df, NET_INPUTS, "label", "held", b.ROW_KEYS, NET_GRID))


# trees --------------------------------------------------------------------------------------------------

TREE_INPUTS = ("B_Tr_T_PROBNN_K", "B_Tr_T_PROBNN_MU", "B_Tr_T_PROBNN_E", "B_Tr_T_diff_z", "B_Tr_T_IPChi2BVTX")
TREE_CLASSES = ["OSKaon", "OSMuon", "OSElectron", "notSamePV"]
TREE_TRUTH = """CASE WHEN B_Tr_T_PROBNN_E > 0.7 THEN 'OSElectron' WHEN B_Tr_T_PROBNN_MU > 0.7 AND track_part % 11 > 0 THEN 'OSMuon'
  WHEN B_Tr_T_diff_z > 1e1 AND track_supp % 13 > 0 THEN 'notSamePV' ELSE 'OSKaon' END"""


def tree_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, *TREE_INPUTS, "B_Tr_T_Origin_Flag").withColumn("particle", F.expr(TREE_TRUTH))
    return df.withColumn("code", models.class_codes(TREE_CLASSES, F.col("particle")))


TREE_BINS = 64  # more than the distinct values of any input: the library then tries every split
TREE_SOURCE = f"SELECT {K}, {TREE_TRUTH} AS particle, {', '.join(TREE_INPUTS)}, B_Tr_T_Origin_Flag FROM {src(*TREE_INPUTS, 'B_Tr_T_Origin_Flag')} v"
CODE_SQL = "CASE particle " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(TREE_CLASSES)) + " END"
BALANCED_ROWS = f"""SELECT row_number() OVER () AS id, *, {CODE_SQL} AS code, count(*) OVER () / (SELECT count(DISTINCT particle) FROM ({TREE_SOURCE})) / CAST(count(*) OVER (PARTITION BY particle) AS DOUBLE) AS w
  FROM ({TREE_SOURCE})"""
GROWN = tree_sql.grown(BALANCED_ROWS, TREE_INPUTS, len(TREE_CLASSES), 6, 0.009)


@query("M1_dt_train", tree_sql.importances(GROWN, TREE_INPUTS))
def dt_train(spark: SparkSession, sf: str) -> DataFrame:
    """Feature importances of the class-balanced tree."""
    df = tree_rows(spark, sf)
    model = models.train_tree(df, TREE_INPUTS, "code", bins=TREE_BINS)
    return rounded(models.feature_importances(model, df, TREE_INPUTS), "importance", digits=6)


@query(
    "M1_class_weights",
    f"""WITH t AS (SELECT {TREE_TRUTH} AS particle FROM {src(*TREE_INPUTS)} v)
      SELECT particle, count(*) AS n, round((SELECT count(*) FROM t) / (SELECT count(DISTINCT particle) FROM t), 6) AS total_weight FROM t GROUP BY particle""",
)
def class_weight_sums(spark: SparkSession, sf: str) -> DataFrame:
    """What the tree is trained on: every class has the same total weight."""
    weighted = models.class_weights(tree_rows(spark, sf), "code")
    sums = weighted.groupBy("particle").agg(F.count(F.lit(1)).alias("n"), F.sum("class_weight").alias("total_weight"))
    return rounded(sums, "total_weight", digits=6)


NAMED = f"CASE prediction {' '.join(f'WHEN {i} THEN {chr(39)}{c}{chr(39)}' for i, c in enumerate(TREE_CLASSES))} END"


@query(
    "M2_dt_to_cuts",
    f"""WITH {', '.join(GROWN)}, src AS MATERIALIZED ({BALANCED_ROWS})
      SELECT {NAMED} AS predicted, {NAMED} AS cut_class, count(*) AS n FROM src JOIN leaf USING (id) WHERE B_Tr_T_Origin_Flag <> 0 GROUP BY prediction""",
)
def dt_to_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks per class passing the exported cut texts, against the tree's own prediction."""
    df = tree_rows(spark, sf)
    model = models.train_tree(df, TREE_INPUTS, "code", bins=TREE_BINS)
    texts = models.cut_texts(models.tree_paths(model, df, TREE_INPUTS, TREE_CLASSES))
    scored = models.apply_cut_texts(models.assemble(df, TREE_INPUTS), texts)
    scored = model.transform(scored).withColumn("predicted", models.class_names(TREE_CLASSES, F.col("prediction")))
    return scored.filter("B_Tr_T_Origin_Flag <> 0").groupBy("predicted", "cut_class").agg(F.count(F.lit(1)).alias("n"))


@query("M2_cuts_reproduce_tree", f"SELECT CAST(count(*) AS BIGINT) AS tracks, CAST(0 AS BIGINT) AS differing FROM {src('B_Tr_T_Origin_Flag')} WHERE B_Tr_T_Origin_Flag <> 0")
def cuts_reproduce_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The exported cut texts select exactly the tracks that the tree gives to each class."""
    found = dt_to_cuts(spark, sf)
    wrong = F.when(F.col("predicted").eqNullSafe(F.col("cut_class")), 0).otherwise(F.col("n"))
    return found.agg(F.sum("n").alias("tracks"), F.sum(wrong).cast("long").alias("differing"))


@query(
    "M3_dt_eval_sums",
    f"""WITH t AS (SELECT {TREE_TRUTH} AS particle FROM {src(*TREE_INPUTS)} v)
      SELECT particle AS class, 'truth' AS normalised_by, 1e0 AS total FROM t GROUP BY particle
      UNION ALL SELECT particle, 'prediction', 1e0 FROM t GROUP BY particle""",
)
def dt_eval_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Both normalisations of the tree's confusion table: the shares of every class add up to one."""
    df = tree_rows(spark, sf)
    model = models.train_tree(df, TREE_INPUTS, "code")
    scored = model.transform(models.assemble(df, TREE_INPUTS))
    scored = scored.withColumn("predicted", models.class_names(TREE_CLASSES, F.col("prediction")))
    parts = []
    for name, side in (("truth", "particle"), ("prediction", "predicted")):
        total = F.col("weight") / F.sum("weight").over(Window.partitionBy(side))
        cells = scored.groupBy("particle", "predicted").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        shares = cells.withColumn("share", total).groupBy(F.col(side).alias("class")).agg(F.sum("share").alias("total"))
        parts.append(shares.select("class", F.lit(name).alias("normalised_by"), "total"))
    return rounded(parts[0].unionByName(parts[1]), "total", digits=9)


PID_SOURCE = f"""SELECT row_number() OVER () AS id, *, CASE WHEN particle = 'OSKaon' THEN 1 ELSE 0 END AS code, CASE WHEN subset = 'train' THEN 1e0 ELSE 0e0 END AS w
  FROM (SELECT *, CASE WHEN CAST(('0x' || substr(md5(concat_ws('_', {K}, '42')), 1, 8)) AS BIGINT) < {int(0.7 * 16**8)} THEN 'train' ELSE 'test' END AS subset FROM ({TREE_SOURCE}))"""
PID_GROWN = tree_sql.grown(PID_SOURCE, TREE_INPUTS, 2, 5, 0.0)
PID_SCORES = f"src AS MATERIALIZED ({PID_SOURCE}), sc AS (SELECT subset, src.code, leaf.c1 / leaf.w AS score FROM src JOIN leaf USING (id))"


def pid_split(spark: SparkSession, sf: str) -> DataFrame:
    df = tree_rows(spark, sf).withColumn("target", (F.col("particle") == "OSKaon").cast("double"))
    return hash_split(df, b.ROW_KEYS, {"train": 0.7, "test": 0.3}, 42)


def pid_tree(split: DataFrame):
    train = split.filter("subset = 'train'")
    return models.train_tree(train, TREE_INPUTS, "target", depth=5, min_gain=0.0, balanced=False, bins=TREE_BINS)


@query("M4_dt_binary_pid_importances", tree_sql.importances(PID_GROWN, TREE_INPUTS))
def dt_binary_pid_importances(spark: SparkSession, sf: str) -> DataFrame:
    """Feature importances of the kaon identification tree."""
    split = pid_split(spark, sf)
    return rounded(models.feature_importances(pid_tree(split), split, TREE_INPUTS), "importance", digits=6)


@query(
    "M4_dt_binary_pid_roc",
    f"""WITH {', '.join(PID_GROWN)}, {PID_SCORES}, v AS (SELECT round(score, 9) AS s, count(*) FILTER (code = 1) AS p, count(*) FILTER (code = 0) AS m FROM sc WHERE subset = 'test' GROUP BY ALL),
      r AS (SELECT s, sum(p) OVER w AS tp, sum(m) OVER w AS fp, sum(p) OVER () AS np, sum(m) OVER () AS nm FROM v WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
      SELECT s AS score, round(CAST(fp AS DOUBLE) / nm, 8) AS fpr, round(CAST(tp AS DOUBLE) / np, 8) AS tpr FROM r
      UNION ALL SELECT CAST(NULL AS DOUBLE), 0e0, 0e0""",
)
def dt_binary_pid_roc(spark: SparkSession, sf: str) -> DataFrame:
    """ROC points of that tree on the test sample."""
    split = pid_split(spark, sf)
    scored = rounded(models.predict(pid_tree(split), split.filter("subset = 'test'"), TREE_INPUTS), "score", digits=9)
    return rounded(stats.roc_curve(scored, "score", "target"), "fpr", "tpr", digits=8)


@query(
    "M3_dt_eval",
    f"""WITH {', '.join(GROWN)}, src AS MATERIALIZED ({BALANCED_ROWS}), p AS (SELECT particle AS truth, prediction FROM src JOIN leaf USING (id)), t AS (SELECT truth, count(*) AS n FROM p GROUP BY truth)
      SELECT truth, {', '.join(f"CASE WHEN any_value(n) > 0 THEN printf('%.2f', 100e0 * count(*) FILTER (prediction = {i}) / any_value(n)) ELSE 'Not predicted' END AS {c}" for i, c in enumerate(TREE_CLASSES))}
      FROM p JOIN t USING (truth) GROUP BY truth""",
)
def dt_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Confusion table of the tree normalised by truth."""
    df = tree_rows(spark, sf)
    model = models.train_tree(df, TREE_INPUTS, "code", bins=TREE_BINS)
    scored = model.transform(models.assemble(df, TREE_INPUTS))
    scored = scored.withColumn("predicted", models.class_names(TREE_CLASSES, F.col("prediction")))
    return stats.confusion_table(scored, "particle", "predicted", TREE_CLASSES)


@query(
    "M4_dt_binary_pid",
    f"""WITH {', '.join(PID_GROWN)}, {PID_SCORES}, v AS (SELECT subset, round(score, 9) AS s, count(*) FILTER (code = 1) AS p, count(*) FILTER (code = 0) AS m FROM sc GROUP BY ALL),
      r AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY subset ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
      SELECT subset, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(m) AS BIGINT) AS negatives, round(sum(p * (below + 5e-1 * m)) / (sum(p) * CAST(sum(m) AS DOUBLE)), 8) AS auc FROM r GROUP BY subset""",
)
def dt_binary_pid(spark: SparkSession, sf: str) -> DataFrame:
    """Area under the curve of a depth-5 kaon identification tree on both hash-split samples."""
    split = pid_split(spark, sf).persist()
    try:
        model, out = pid_tree(split), None
        for name in ("train", "test"):
            scored = rounded(models.predict(model, split.filter(F.col("subset") == name), TREE_INPUTS), "score", digits=9)
            auc = stats.roc_auc(scored, "score", "target").withColumn("subset", F.lit(name))
            out = auc if out is None else out.unionByName(auc)
        return rounded(out, "auc")
    finally:
        split.unpersist()


def bdt_rows(spark: SparkSession, sf: str) -> DataFrame:
    target = F.expr(f"CASE WHEN ({TREE_TRUTH}) = 'OSKaon' THEN 1 ELSE 0 END")
    return b.tracks(spark, sf, *TREE_INPUTS, "B_Tr_T_OWNPVIPCHI2", "B_Tr_T_OWNPVIP").withColumn("target", target)


def bdt_gate() -> Column:
    return cuts.quality_passed(F.col("B_Tr_T_OWNPVIPCHI2") - 10.0, F.col("B_Tr_T_OWNPVIP"))


@query("M12_bdt_two_fold_score")
def bdt_two_fold_score(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every track by the ensemble of 20 trees fitted to the other parity."""
    df = bdt_rows(spark, sf)
    fitted = models.two_fold_models(df, TREE_INPUTS, "target", "entry")
    return models.two_fold_score(df, fitted, TREE_INPUTS, "entry", bdt_gate()).select(*b.ROW_KEYS, "score")


@query("M12_compiled_equals_library", f"SELECT count(*) AS tracks, CAST(0 AS BIGINT) AS differing FROM {src('prob')} v")
def compiled_equals_library(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks whose score by the compiled ensemble differs from the library's own prediction."""
    df = bdt_rows(spark, sf)
    model = models.two_fold_models(df, TREE_INPUTS, "target", "entry")[0]
    text = trees.compiled(model, df, TREE_INPUTS, tests := {})
    both = models.predict(model, trees.with_tests(df, tests), TREE_INPUTS, "library").withColumn("compiled", F.expr(text))
    wrong = F.when(F.abs(F.col("library") - F.col("compiled")) > 1e-12, 1).otherwise(0)
    return both.agg(F.count(F.lit(1)).alias("tracks"), F.sum(wrong).cast("long").alias("differing"))


def made_ensemble(trees_: int = 20) -> list[Row]:
    """Nodes of full trees of depth 3 by a rule; the tests lie in each feature's range, the leaves between -0.4 and 0.4."""
    top, rows = (1.0, 1.0, 1.0, 19.0, 25.0), []
    for t in range(trees_):
        for n in range(15):
            f, share = (t * 7 + n * 3) % 5, ((t * 31 + n * 17) % 97 + 1) / 98
            leaf = n >= 7
            rows.append(
                Row(tree=t, node=n, left=-1 if leaf else 2 * n + 1, right=-1 if leaf else 2 * n + 2, feature=None if leaf else f, threshold=None if leaf else share * top[f], prediction=((t * 13 + n * 29) % 41 - 20) / 50)
            )
    return rows


def _walk_sql() -> str:
    """The same trees walked as a table of nodes, a join a level."""
    number = lambda x: "NULL" if x is None else f"{x:.17e}" if isinstance(x, float) else str(x)
    values = ", ".join(f"({', '.join(number(r[c]) for c in ('tree', 'node', 'left', 'feature', 'threshold', 'prediction'))})" for r in made_ensemble())
    value = "CASE feature " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(TREE_INPUTS)) + " END"
    ctes = [f"nodes(tree, node, l, feature, threshold, prediction) AS (VALUES {values})", f"t AS MATERIALIZED (SELECT row_number() OVER () AS row, {K}, {', '.join(TREE_INPUTS)} FROM {src(*TREE_INPUTS)} v)"]
    ctes.append("w0 AS (SELECT t.*, tree, 0 AS node FROM t, (SELECT DISTINCT tree FROM nodes))")
    for d in range(3):
        ctes.append(f"w{d + 1} AS (SELECT w.* REPLACE (CASE WHEN {value} <= threshold THEN l ELSE l + 1 END AS node) FROM w{d} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)")
    weight = "CASE WHEN w.tree = 0 THEN 1e0 ELSE 1e-1 END"
    return f"WITH {', '.join(ctes)} SELECT {K}, round(1e0 / (1e0 + exp(-2e0 * sum({weight} * prediction))), 9) AS score FROM w3 w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY row, {K}"


@query("M12_compiled_score", _walk_sql())
def compiled_score(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of a fixed ensemble of 20 trees, compiled; the check walks its node table."""
    text = trees.ensemble_text(made_ensemble(), [1.0] + [0.1] * 19, TREE_INPUTS)
    df = b.tracks(spark, sf, *TREE_INPUTS).withColumn("score", F.expr(text))
    return rounded(df, "score", digits=9).select(*b.ROW_KEYS, "score")


MVA = "o_orderkey AS entry, 4.9e3 + o_totalprice / 5e2 AS mass, 255500 + o_orderkey % 400 AS run, CAST(o_custkey % 2 AS INT) AS mc"


@query(
    "M13_mva_training_cuts",
    f"""SELECT * FROM (SELECT *, CASE WHEN mc = 1 AND mass > 5000 AND mass < 5600 THEN 1 WHEN mc = 0 AND mass > 5400 AND run >= 255623 THEN 0 END AS target
      FROM (SELECT {MVA} FROM orders)) WHERE target IS NOT NULL""",
)
def mva_training_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return cuts.mva_samples(b.table(spark, sf, "orders").selectExpr(*MVA.split(", ")), "mass", "run", "mc")


# mass model and weights ------------------------------------------------------------------------------------

SHAPE = weights.Shape(mean=5280.0, sigma=6.0, g_sigma=9.0, fraction=0.6, n_l=3.0, n_r=3.0, c0=0.05, c1=-0.02, c2=0.01)


def _density_sql(x: str, s: weights.Shape = SHAPE) -> str:
    ball, gauss, cheb = weights.norms(s)
    t = f"(({x} - {s.mean:e}) / {s.sigma:e})"

    def tail(side: str, a: float, n: float) -> str:
        return f"exp({-0.5 * a * a:.17e}) * pow(greatest(1e0 + ({side}{t} - {a:e}) * {a / n:.17e}, 1e-12), {-n:e})"

    core = f"exp(-5e-1 * {t} * {t})"
    dcb = f"CASE WHEN {t} < {-s.alpha_l:e} THEN {tail('-', s.alpha_l, s.n_l)} WHEN {t} > {s.alpha_r:e} THEN {tail('', s.alpha_r, s.n_r)} ELSE {core} END"
    g = f"exp(-5e-1 * pow(({x} - {s.mean:e}) / {s.g_sigma:e}, 2))"
    u = f"(({x} - {s.low:e}) * {2.0 / (s.high - s.low):.17e} - 1e0)"
    poly = f"1e0 + {s.c0:e} * {u} + {s.c1:e} * (2e0 * {u} * {u} - 1e0) + {s.c2:e} * (4e0 * pow({u}, 3) - 3e0 * {u})"
    return f"({dcb}) * {s.fraction / ball:.17e} + {g} * {(1 - s.fraction) / gauss:.17e} AS f_sig, ({poly}) / {cheb:.17e} AS f_bkg"


EM_STEPS, STEPS = 4, 12  # of the check: expectation-maximisation first, then Newton
DENSITY_SQL = f"md AS (SELECT entry, run, B_ID, mass_peak, {_density_sql('mass_peak')} FROM ({b.candidates_sql('entry', 'run', 'B_ID', 'mass_peak')}) WHERE mass_peak > 5200 AND mass_peak < 5400)"


def _yields_sql() -> str:
    ctes = [DENSITY_SQL, "y0 AS (SELECT count(*) / 2e0 AS ns, count(*) / 2e0 AS nb FROM md)"]
    for i in range(STEPS):
        sums = f"""(SELECT any_value(ns) AS ns, any_value(nb) AS nb, sum(f_sig / m) AS gs, sum(f_bkg / m) AS gb, sum(f_sig * f_sig / (m * m)) AS ss,
          sum(f_sig * f_bkg / (m * m)) AS sb, sum(f_bkg * f_bkg / (m * m)) AS bb FROM (SELECT *, f_sig * ns + f_bkg * nb AS m FROM md, y{i}))"""
        step = "ns * gs AS ns, nb * gb AS nb"
        if i >= EM_STEPS:
            step = "ns + (bb * (gs - 1) - sb * (gb - 1)) / (ss * bb - sb * sb) AS ns, nb + (ss * (gb - 1) - sb * (gs - 1)) / (ss * bb - sb * sb) AS nb"
        ctes.append(f"y{i + 1} AS MATERIALIZED (SELECT {step} FROM {sums})")
    return ", ".join(ctes)


YIELDS_SQL = _yields_sql()


def mass_rows(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    df = b.candidates(spark, sf, "entry", "run", "B_ID", "mass_peak", *names)
    return weights.with_densities(cuts.mass_window(df, "mass_peak"), "mass_peak", SHAPE)


@query("M14_mass_fit_yields", f"WITH {YIELDS_SQL} SELECT round(ns, 3) AS yield_signal, round(nb, 3) AS yield_background FROM y{STEPS}")
def mass_fit_yields(spark: SparkSession, sf: str) -> DataFrame:
    found = weights.fit_yields(mass_rows(spark, sf))
    return spark.createDataFrame([tuple(round(y, 3) for y in found)], "yield_signal double, yield_background double")


def unbinned_fit(spark: SparkSession, sf: str) -> weights.UnbinnedFit:
    """Simulation fit for the tails, then the data fit with the tails fixed; both from a binned start."""
    df = b.candidates(spark, sf, "entry", "mass_peak", "simulated")
    simulated = df.filter("simulated = 1")
    first = weights.fit_unbinned(simulated, "mass_peak", weights.fit_mass(simulated, "mass_peak", replace(SHAPE, mean=5279.0), simulation=True), simulation=True)
    start = weights.fit_mass(df, "mass_peak", replace(first.shape, c0=0.1, c1=-0.2, c2=0.03))
    return weights.fit_unbinned(df, "mass_peak", start)


@query("M14_mass_fit_shapes")
def mass_fit_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Parameters of the unbinned fit with errors."""
    return unbinned_fit(spark, sf).table(spark)


@query(
    "M14_unbinned_stationary",
    "SELECT unnest(['mean', 'sigma', 'g_sigma', 'fraction', 'c0', 'c1', 'c2', 'yield_signal', 'yield_background']) AS name, true AS stationary",
)
def unbinned_stationary(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the likelihood's gradient vanishes at the fit, to a thousandth of a parameter's error (or the parameter is at a bound)."""
    pulls = unbinned_fit(spark, sf).pulls
    return spark.createDataFrame([(n, abs(p) < 1e-3) for n, p in pulls], "name string, stationary boolean")


SWEIGHT_SQL = f"""{YIELDS_SQL}, mx AS (SELECT md.*, f_sig * ns + f_bkg * nb AS m FROM md, y{STEPS}),
  vv AS (SELECT sum(f_sig * f_sig / (m * m)) AS ss, sum(f_sig * f_bkg / (m * m)) AS sb, sum(f_bkg * f_bkg / (m * m)) AS bb FROM mx),
  sw AS (SELECT mx.*, (bb * f_sig - sb * f_bkg) / ((ss * bb - sb * sb) * m) AS w_sig, (ss * f_bkg - sb * f_sig) / ((ss * bb - sb * sb) * m) AS w_bkg FROM mx, vv)"""


@query("M15_sweights", f"WITH {SWEIGHT_SQL} SELECT entry, round(w_sig, 6) + 0e0 AS signal_weights, round(w_bkg, 6) + 0e0 AS background_weights FROM sw")
def sweights(spark: SparkSession, sf: str) -> DataFrame:
    df = mass_rows(spark, sf)
    found = weights.fit_yields(df)
    made = weights.sweights(df, found)
    return rounded(made.select("entry", "signal_weights", "background_weights"), "signal_weights", "background_weights", digits=6)


# calibration and combination ------------------------------------------------------------------------------

NEWTON = 8
LONG_SQL = f"""{PER_TAGGER}, lg AS (SELECT o.entry, o.flag AS tagger, o.d, o.eta, c.B_ID, (c.run % 10 - 2) / 4e0 AS w
  FROM one o JOIN ({b.candidates_sql('entry', 'run', 'B_ID')}) c ON o.entry = c.entry)"""


def long_taggers(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """(event, tagger) rows with decision, mistag, flavour and a signed weight."""
    df = per_tagger_events(spark, sf).select("entry", F.col("flag").alias("tagger"), "d", "eta")
    df = df.join(b.candidates(spark, sf, "entry", "run", "B_ID", *names), "entry")
    return df.withColumn("w", (F.col("run") % 10 - 2) / 4.0).drop("run")


def _newton_sql(weight: str, link: str, rows: str = "lg", mark: str = "", chi: str = "0e0", steps: int = NEWTON) -> str:
    """Unrolled Fisher scoring of two parameters per (tagger, sign) of ``rows``; ``mark`` ends the names of its tables, ``chi`` is the mixing probability."""
    value = "ln(eta / (1e0 - eta))" if link == "logit" else "eta"
    centre = "ln(m / (1e0 - m))" if link == "logit" else "m"
    start = "ln(f / (1e0 - f))" if link == "logit" else "f"
    omega = "1e0 / (1e0 + exp(-(a + bb * x)))" if link == "logit" else "greatest(least(a + bb * x, 1e0 - 1e-9), 1e-9)"
    slope = "om * (1e0 - om)" if link == "logit" else "1e0"
    ctes = [
        f"fr{mark} AS (SELECT tagger, CAST(sign(B_ID) AS INT) AS sg, CASE WHEN d * sign(B_ID) < 0 THEN 1e0 ELSE 0e0 END AS y, eta, {weight} AS fw, {chi} AS chi FROM {rows} WHERE d <> 0 AND eta < 0.5)",
        f"fc{mark} AS (SELECT tagger, {centre} AS c FROM (SELECT tagger, sum(fw * eta) / sum(fw) AS m FROM fr{mark} GROUP BY tagger))",
        f"fx{mark} AS MATERIALIZED (SELECT f.*, {value} - c AS x FROM fr{mark} f JOIN fc{mark} USING (tagger))",
        f"q{mark}0 AS (SELECT tagger, sg, {start} AS a, 0e0 AS bb FROM (SELECT tagger, sg, sum(fw * y) / sum(fw) AS f FROM fr{mark} GROUP BY tagger, sg))",
    ]
    for i in range(steps):
        ctes.append(
            f"""q{mark}{i + 1} AS MATERIALIZED (SELECT tagger, sg, a + (h2 * g0 - h1 * g1) / det AS a, bb + (h0 * g1 - h1 * g0) / det AS bb,
             sqrt((h2 * h2 * v0 - 2 * h1 * h2 * v1 + h1 * h1 * v2) / (det * det)) AS ea, sqrt((h1 * h1 * v0 - 2 * h0 * h1 * v1 + h0 * h0 * v2) / (det * det)) AS eb,
             (h0 * h2 * v1 + h1 * h1 * v1 - h1 * h2 * v0 - h0 * h1 * v2) / (det * det) AS eab
             FROM (SELECT *, h0 * h2 - h1 * h1 AS det FROM (SELECT tagger, sg, any_value(a) AS a, any_value(bb) AS bb,
               sum(fw * (y - pi) * sl / sp) AS g0, sum(fw * (y - pi) * sl / sp * x) AS g1, sum(fw * sl * sl / sp) AS h0, sum(fw * sl * sl / sp * x) AS h1, sum(fw * sl * sl / sp * x * x) AS h2,
               sum(fw * fw * sl * sl / sp) AS v0, sum(fw * fw * sl * sl / sp * x) AS v1, sum(fw * fw * sl * sl / sp * x * x) AS v2
               FROM (SELECT *, {slope} * (1e0 - 2e0 * chi) AS sl, pi * (1e0 - pi) AS sp FROM (SELECT *, om + chi - 2e0 * om * chi AS pi FROM (SELECT x.*, a, bb, {omega} AS om FROM fx{mark} x JOIN q{mark}{i} USING (tagger, sg)))) GROUP BY tagger, sg)))"""
        )
    return ", ".join(ctes)


def _parameters_sql(digits: int) -> str:
    last = f"q{NEWTON}"
    flavour = ", ".join(
        f"('p{k}' || CASE WHEN sg > 0 THEN '+' ELSE '-' END, 'flavour', {v}, {e})" for k, v, e in ((0, "a", "ea"), (1, "bb", "eb"))
    )
    rows = f"SELECT tagger, u.style, u.name, u.value, u.error FROM {last}, LATERAL (VALUES {flavour}) AS u(name, style, value, error)"
    delta = []
    for k, v, e in ((0, "a", "ea"), (1, "bb", "eb")):
        delta.append(f"SELECT p.tagger, 'delta', 'p{k}', (p.{v} + n.{v}) / 2, sqrt(p.{e} * p.{e} + n.{e} * n.{e}) / 2 FROM pl p JOIN mi n USING (tagger)")
        delta.append(f"SELECT p.tagger, 'delta', 'Dp{k}', p.{v} - n.{v}, sqrt(p.{e} * p.{e} + n.{e} * n.{e}) FROM pl p JOIN mi n USING (tagger)")
    return (
        f"pl AS (SELECT * FROM {last} WHERE sg = 1), mi AS (SELECT * FROM {last} WHERE sg = -1) "
        f"SELECT tagger, style, name, round(value, {digits}) + 0e0 AS value, round(error, {digits}) AS error, true AS converged FROM ({rows} UNION ALL {' UNION ALL '.join(delta)})"
    )


def fitted(df: DataFrame, link: str = "logit", weight: str | None = "w") -> calibration.Calibration:
    return calibration.calibrate(df, "tagger", "d", "eta", "B_ID", weight, link, 2, tolerance=1e-9, fallback=False)


@query("M16_glm_calibrate_logit", f"WITH {LONG_SQL}, {_newton_sql('w', 'logit')}, {_parameters_sql(5)}")
def glm_calibrate_logit(spark: SparkSession, sf: str) -> DataFrame:
    """Logit link with signed weights, both parameter styles."""
    return rounded(fitted(long_taggers(spark, sf)).parameter_table(spark), "value", "error", digits=5)


@query("M16_glm_calibrate_mistag", f"WITH {LONG_SQL}, {_newton_sql('1e0', 'mistag')}, {_parameters_sql(5)}")
def glm_calibrate_mistag(spark: SparkSession, sf: str) -> DataFrame:
    """Identity link without weights."""
    return rounded(fitted(long_taggers(spark, sf), "mistag", None).parameter_table(spark), "value", "error", digits=5)


SPLITS = {n: stat_queries.BIN_EDGES[n] for n in ("B_PT", "B_ETA", "B_nPVs", "B_nTracks")}
BINNED_SQL = f"""{PER_TAGGER}, lk AS (SELECT o.entry, o.flag, o.d, o.eta, c.* EXCLUDE (entry) FROM one o JOIN ({b.candidates_sql('entry', 'B_ID', *SPLITS)}) c ON o.entry = c.entry),
  lg AS (SELECT split || '|' || bin || '|' || flag AS tagger, d, eta, B_ID FROM ({' UNION ALL '.join(f"SELECT '{n}' AS split, {stat_queries._bin_sql(n)} AS bin, flag, d, eta, B_ID FROM lk" for n in SPLITS)}) WHERE bin IS NOT NULL)"""


def binned_taggers(spark: SparkSession, sf: str) -> DataFrame:
    """Every (event, tagger) once for each kinematic split."""
    df = long_taggers(spark, sf, *SPLITS)
    bins = {n: stats.bucket_of(n, edges) for n, edges in SPLITS.items()}
    return group_calibration.by_splits(df, bins, ["tagger", "d", "eta", "B_ID"])


@query(
    "M16_binned_calibration",
    f"""WITH {BINNED_SQL}, {_newton_sql('1e0', 'logit')}
      SELECT split_part(tagger, '|', 1) AS split, CAST(split_part(tagger, '|', 2) AS INT) AS bin, split_part(tagger, '|', 3) AS tagger, sg AS flavour,
      round(a, 4) + 0e0 AS p0, round(ea, 4) AS p0_err, round(bb, 4) + 0e0 AS p1, round(eb, 4) AS p1_err, round(eab, 5) + 0e0 AS covariance FROM q{NEWTON}""",
)
def binned_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """A calibration of every tagger in every bin of every split, all fitted together; a flavour that a bin lacks gives no row."""
    by = ["split", "bin", "tagger"]
    rows = binned_taggers(spark, sf)
    table = group_calibration.calibrate_groups(rows, by, "d", "eta", "B_ID", tolerance=1e-9).table(rows)
    sides = F.explode(F.array(*[F.struct(F.lit(sign).alias("flavour"), F.col(n).alias("p"), F.col(f"{n}_cov").alias("v")) for sign, n in ((1, "plus"), (-1, "minus"))]))
    out = table.select(*by, sides.alias("s")).filter("s.p IS NOT NULL").select(
        *by, "s.flavour", F.col("s.p")[0].alias("p0"), F.sqrt(F.col("s.v")[0]).alias("p0_err"), F.col("s.p")[1].alias("p1"), F.sqrt(F.col("s.v")[3]).alias("p1_err"), F.col("s.v")[1].alias("covariance")
    )
    return rounded(rounded(out, "p0", "p0_err", "p1", "p1_err", digits=4), "covariance", digits=5)


CAL_POWER_SQL = f"""mv AS (SELECT tagger, sum(ea * ea) / 4 AS va, sum(eb * eb) / 4 AS vb, sum(eab) / 4 AS vab FROM q{NEWTON} GROUP BY tagger),
  mq AS (SELECT tagger, avg(a) AS a, avg(bb) AS bb FROM q{NEWTON} GROUP BY tagger),
  om AS (SELECT lg.*, ln(eta / (1e0 - eta)) - c AS x, CASE WHEN d <> 0 AND eta < 0.5 THEN 1e0 / (1e0 + exp(-(a + bb * (ln(eta / (1e0 - eta)) - c)))) END AS om FROM lg JOIN mq USING (tagger) JOIN fc USING (tagger)),
  cs AS (SELECT tagger, count(*) AS n, count(*) FILTER (om < 0.5) AS n_tagged, coalesce(sum((1 - 2 * om) * (1 - 2 * om)) FILTER (om < 0.5), 0) AS d2,
    sum(-4 * (1 - 2 * om) * om * (1 - om)) FILTER (om < 0.5) AS s0, sum(-4 * (1 - 2 * om) * om * (1 - om) * x) FILTER (om < 0.5) AS s1 FROM om GROUP BY tagger)"""
CAL_ERROR = "sqrt(greatest(s0 * s0 * va + 2 * s0 * s1 * vab + s1 * s1 * vb, 0))"


@query(
    "M16_power_error",
    f"""WITH {LONG_SQL}, {_newton_sql('1e0', 'logit')}, {CAL_POWER_SQL} SELECT tagger, n, n_tagged, round(d2 / n, 8) AS tagging_power, round({CAL_ERROR} / n, 8) AS tagging_power_cal_err,
      round({CAL_ERROR} / (4 * nullif(n_tagged, 0) * sqrt(d2 / nullif(n_tagged, 0))), 8) AS effective_mistag_cal_err FROM cs JOIN mv USING (tagger)""",
)
def power_error(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrated power of every tagger with the error that its calibration parameters contribute."""
    df = long_taggers(spark, sf)
    fit = group_calibration.calibrate_groups(df, ["tagger"], "d", "eta", "B_ID", tolerance=1e-9)
    made = group_calibration.calibrated_performance(df, fit, ["tagger"], "d", "eta", "B_ID")
    names = ["tagging_power", "tagging_power_cal_err", "effective_mistag_cal_err"]
    return rounded(made.select("tagger", "n", "n_tagged", *names), *names)


@query(
    "S7_nested_result",
    f"""WITH {LONG_SQL}, {_newton_sql('1e0', 'logit')}, {CAL_POWER_SQL}, p AS (SELECT * FROM q{NEWTON} WHERE sg = 1), m AS (SELECT * FROM q{NEWTON} WHERE sg = -1)
      SELECT tagger, round(p.a, 4) + 0e0 AS p0_plus, round(m.bb, 4) + 0e0 AS p1_minus, round((p.a + m.a) / 2, 4) + 0e0 AS p0, round(p.bb - m.bb, 4) + 0e0 AS dp1, round(sqrt(p.eb * p.eb + m.eb * m.eb), 4) AS dp1_err,
      round((p.eab - m.eab) / 2, 5) + 0e0 AS cov_p0_dp1, round(d2 / n, 8) AS tagging_power, round({CAL_ERROR} / n, 8) AS tagging_power_cal_err, true AS styles_agree, true AS osc_missing
      FROM p JOIN m USING (tagger) JOIN cs USING (tagger) JOIN mv USING (tagger)""",
)
def nested_result(spark: SparkSession, sf: str) -> DataFrame:
    """Whole calibration results written as nested documents and read back; the flavour style must give the delta style."""
    df = long_taggers(spark, sf)
    fit = group_calibration.calibrate_groups(df, ["tagger"], "d", "eta", "B_ID", tolerance=1e-9)
    before = stats.tagging_performance(df, "d", "eta", "B_ID", by=["tagger"], sums=True)
    after = group_calibration.calibrated_performance(df, fit, ["tagger"], "d", "eta", "B_ID")
    path = shared_dir(spark, "nested")
    results.write_nested(results.nested_results(fit.table(df), before, after, "tagger", 2), path)
    read = results.read_nested(spark, path)
    flavour, delta = F.col("calibration.flavour_style"), F.col("calibration.delta_style")
    value = lambda style, k: style["params"][k]["value"]
    agree = F.lit(True)
    for k in range(2):
        agree = agree & (F.abs((value(flavour, k) + value(flavour, k + 2)) / 2 - value(delta, k)) < 1e-9) & (F.abs(value(flavour, k) - value(flavour, k + 2) - value(delta, k + 2)) < 1e-9)
    power = F.col("calibrated.selected.tagging_power")
    out = read.select(
        "tagger", value(flavour, 0).alias("p0_plus"), value(flavour, 3).alias("p1_minus"), value(delta, 0).alias("p0"), value(delta, 3).alias("dp1"), delta["params"][3]["error"].alias("dp1_err"),
        delta["cov"][0][3].alias("cov_p0_dp1"), power[0].alias("tagging_power"), power[2].alias("tagging_power_cal_err"), agree.alias("styles_agree"), F.col("osc").isNull().alias("osc_missing"),
    )
    made = rounded(out, "p0_plus", "p1_minus", "p0", "dp1", "dp1_err", digits=4)
    return rounded(rounded(made, "cov_p0_dp1", digits=5), "tagging_power", "tagging_power_cal_err")


@query("M16_glm_calibrate_npar")
def glm_calibrate_npar(spark: SparkSession, sf: str) -> DataFrame:
    """Different polynomial orders and links per tagger in one fit."""
    fit = calibration.calibrate(
        long_taggers(spark, sf), "tagger", "d", "eta", "B_ID", None,
        links={"A": "logit", "N": "mistag", "R": "logit"}, npar={"A": 4, "N": 3, "R": 2},
    )
    return fit.parameter_table(spark)


APPLY_SQL = f"""mp AS (SELECT tagger, avg(a) AS a, avg(bb) AS bb FROM q{NEWTON} GROUP BY tagger),
  ap AS (SELECT lg.*, CASE WHEN d <> 0 AND eta < 0.5 THEN 1e0 / (1e0 + exp(-(a + bb * (ln(eta / (1e0 - eta)) - c)))) END AS om
    FROM lg JOIN mp USING (tagger) JOIN fc USING (tagger)),
  ca AS (SELECT entry, tagger, B_ID, CAST(CASE WHEN om < 0.5 THEN d ELSE 0 END AS INT) AS d_cal, CASE WHEN om < 0.5 THEN om ELSE 5e-1 END AS omega FROM ap)"""


@query(
    "M18_apply_calibration",
    f"WITH {LONG_SQL}, {_newton_sql('1e0', 'logit')}, {APPLY_SQL} SELECT entry, tagger, d_cal, round(omega, 6) AS omega FROM ca",
)
def apply_calibration(spark: SparkSession, sf: str) -> DataFrame:
    df = long_taggers(spark, sf)
    made = calibration.apply_calibration(df, fitted(df, weight=None), "tagger", "d", "eta")
    return rounded(made.select("entry", "tagger", "d_cal", "omega"), "omega", digits=6)


ODDS_SQL = "sum(CASE WHEN {d} <> 0 THEN {d} * ln((1e0 - {e}) / {e}) ELSE 0e0 END)"


@query(
    "M19_combine_taggers",
    f"""WITH {LONG_SQL}, pb AS (SELECT entry, product((1 + d) / 2e0 - d * (1e0 - eta)) AS pb, product((1 - d) / 2e0 + d * (1e0 - eta)) AS pa FROM lg GROUP BY entry),
      n AS (SELECT entry, pb / (pa + pb) AS b, pa / (pa + pb) AS a FROM pb)
      SELECT entry, CAST(CASE WHEN abs(a - b) < 1e-13 THEN 0 WHEN a > b THEN 1 ELSE -1 END AS INT) AS d, round(1e0 - greatest(a, b), 7) AS eta FROM n""",
)
def combine_taggers(spark: SparkSession, sf: str) -> DataFrame:
    df = per_tagger_events(spark, sf).select("entry", "d", "eta")
    return rounded(calibration.combine_taggers(df, "entry", "d", "eta"), "eta", digits=7)


@query(
    "M19_combine_wide",
    f"""WITH {LONG_SQL}, l AS (SELECT entry, {ODDS_SQL.format(d='d', e='eta')} AS s FROM lg GROUP BY entry)
      SELECT entry, CAST(sign(s) AS INT) AS d, round(1e0 / (1e0 + exp(abs(s))), 7) AS eta FROM l""",
)
def combine_wide(spark: SparkSession, sf: str) -> DataFrame:
    made = calibration.combine_wide([(f"{t}_d", f"{t}_eta") for t in "ANR"])
    df = joins.widen_taggers(per_tagger_events(spark, sf), "entry", "flag", ["A", "N", "R"]).withColumns(made)
    return rounded(df.select("entry", "d", "eta"), "eta", digits=7)


@query(
    "M20_oscillation_time_input",
    f"""SELECT entry, round(t, 6) AS time, round(5e-1 * (1e0 - cos(5.069e-1 * t)), 6) AS chi_d, round(5e-1 * (1e0 - cos(1.7765e1 * t) / cosh(4.2e-2 * t)), 6) AS chi_s
      FROM (SELECT entry, B_DTF_PV_CTAU / 2.9979e-1 AS t FROM ({b.candidates_sql('entry', 'B_DTF_PV_CTAU')}))""",
)
def oscillation_time_input(spark: SparkSession, sf: str) -> DataFrame:
    df = b.candidates(spark, sf, "entry", "B_DTF_PV_CTAU")
    time = tag.decay_time(F.col("B_DTF_PV_CTAU"), "c_ps")
    chi = {
        f"chi_{m}": tag.mixing_probability(time, tag.frequency_of(f"B{m}"), tag.WIDTH_DIFFERENCE[f"B{m}"]) for m in "ds"
    }
    return df.select("entry", fixed(time, 6).alias("time"), *[fixed(c, 6).alias(n) for n, c in chi.items()])


MIXING_SQL = f"""{PER_TAGGER}, lg AS (SELECT o.flag AS tagger, o.d, o.eta, c.B_ID, 5e-1 * (1e0 - cos(5.069e-1 * (B_DTF_PV_CTAU / 2.9979e-1))) AS chi
  FROM one o JOIN ({b.candidates_sql('entry', 'B_ID', 'B_DTF_PV_CTAU')}) c ON o.entry = c.entry)"""


@query("M20_mixing_calibration", f"WITH {MIXING_SQL}, {_newton_sql('1e0', 'logit', chi='chi')}, {_parameters_sql(4)}")
def mixing_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration with the oscillation-aware likelihood of a neutral mode."""
    df = long_taggers(spark, sf, "B_DTF_PV_CTAU")
    time = tag.decay_time(F.col("B_DTF_PV_CTAU"), "c_ps")
    chi = tag.mixing_probability(time, tag.frequency_of("Bd2JpsiKst"))
    return rounded(calibration.calibrate(df, "tagger", "d", "eta", "B_ID", None, mixing=chi).parameter_table(spark), "value", "error", digits=4)


@query(
    "M21_run_compare",
    f"""WITH {b.TAGGED_SQL}, two AS (SELECT entry, 'new' AS generation, d, eta FROM tagged UNION ALL
        SELECT entry, 'previous', CAST(CASE WHEN 1e0 - prob2 > 0.5 THEN -d0 ELSE d0 END AS INT), CASE WHEN 1e0 - prob2 > 0.5 THEN prob2 ELSE 1e0 - prob2 END FROM tagged),
      pt AS (SELECT t.generation, t.d, t.eta, c.B_ID FROM two t JOIN ({b.candidates_sql('entry', 'B_ID')}) c ON t.entry = c.entry), {performance_sql('pt', 'generation')} SELECT * FROM figures""",
)
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Track-level performance of two tagger generations."""
    return rounded(stats.tagging_performance(generations(spark, sf), "d", "eta", "B_ID", by=["generation"]).drop("n_eff"), *FIGURES)


def generations(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of two tagger generations on the same tracks, stacked to one long table."""
    df = b.tagged_tracks(spark, sf)
    before = 1.0 - F.col("prob2")
    df = df.withColumns(
        {
            "d_old": F.when(before > 0.5, F.col("charge")).otherwise(-F.col("charge")),
            "eta_old": F.when(before > 0.5, F.col("prob2")).otherwise(before),
        }
    )
    sources = {("new",): ("d", "eta"), ("previous",): ("d_old", "eta_old")}
    long = calibration.to_long(df, ["entry"], sources, ["generation"])
    return long.join(b.candidates(spark, sf, "entry", "B_ID"), "entry")


GENERATIONS_SQL = f"""{b.TAGGED_SQL}, two AS (SELECT entry, 'new' AS generation, d, eta FROM tagged UNION ALL
    SELECT entry, 'previous', CAST(CASE WHEN 1e0 - prob2 > 0.5 THEN -d0 ELSE d0 END AS INT), CASE WHEN 1e0 - prob2 > 0.5 THEN prob2 ELSE 1e0 - prob2 END FROM tagged),
  lg AS (SELECT t.generation AS tagger, t.d, t.eta, c.B_ID FROM two t JOIN ({b.candidates_sql('entry', 'B_ID')}) c ON t.entry = c.entry)"""


@query(
    "M21_calibrated_compare",
    f"""WITH {GENERATIONS_SQL}, {_newton_sql('1e0', 'logit')}, {CAL_POWER_SQL} SELECT tagger AS generation, n, n_tagged, round(d2 / n, 8) AS tagging_power, round({CAL_ERROR} / n, 8) AS tagging_power_cal_err
      FROM cs JOIN mv USING (tagger)""",
)
def calibrated_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Both generations calibrated in one fit and compared by their calibrated power."""
    long = generations(spark, sf)
    fit = group_calibration.calibrate_groups(long, ["generation"], "d", "eta", "B_ID", tolerance=1e-9)
    made = group_calibration.calibrated_performance(long, fit, ["generation"], "d", "eta", "B_ID")
    return rounded(made.select("generation", "n", "n_tagged", "tagging_power", "tagging_power_cal_err"), "tagging_power", "tagging_power_cal_err")


# chains ------------------------------------------------------------------------------------------------


@query(
    "E2_combined_performance",
    f"""WITH {LONG_SQL}, {_newton_sql('1e0', 'logit')}, {APPLY_SQL}, cb AS (SELECT entry, any_value(B_ID) AS B_ID, {ODDS_SQL.format(d='d_cal', e='omega')} AS s FROM ca GROUP BY entry),
      cmb AS (SELECT entry, B_ID, CAST(sign(s) AS INT) AS d, 1e0 / (1e0 + exp(abs(s))) AS eta FROM cb), {performance_sql('cmb')} SELECT * FROM figures""",
)
def combined_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Calibrate every tagger, combine the calibrated taggers per event, report the combination."""
    df = long_taggers(spark, sf)
    made = calibration.apply_calibration(df, fitted(df, weight=None), "tagger", "d", "eta")
    joined = calibration.combine_taggers(made, "entry", "d_cal", "omega", ["B_ID"])
    return rounded(stats.tagging_performance(joined, "d", "eta", "B_ID").drop("n_eff"), *FIGURES)


CHAIN_TRACK = ("PX", "PY", "PZ", "P", "PT", "Eta", "Phi", "X", "Y", "Z", "firstZ", "OWNPV_Z", "OWNPVIP", "OWNPVIPCHI2", "PROBNN_K", "Charge", "IsInTree", "Origin_Flag", "TRUE_PARTICLE_ID")
CHAIN_SIGNAL = ("B_PX", "B_PY", "B_PZ", "B_P", "B_M", "B_ENERGY", "B_ETA", "B_PHI", "B_OWNPV_Z", "B_ENDV_X", "B_ENDV_Y", "B_ENDV_Z", "B_TRUEID")
CHAIN_CUT = "(B_Tr_T_PROBNN_K > 0.4) & (B_Tr_T_Origin_Flag !=0)"
CHAIN_INPUTS = ("B_Tr_T_PROBNN_K", "B_Tr_T_OWNPVIP")
CHAIN_NET = networks.Network.initial(2, [3, 3], seed=5)


#: What the track roles are made of; flags as numbers. The order is that of the roles, so that rows with equal keys sort alike.
CHAIN_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
CHAIN_FLAGS = ("B_Tr_T_Charge", "B_Tr_T_IsInTree")


def nested_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their tracks nested, in the order of line, part and supplier; an order has a few lines.

    Only a line's own columns travel to its event. Signal and track roles are made of them afterwards, so what an event is chosen by is
    known from its key before the shuffle.
    """
    known = b.roles(*CHAIN_SIGNAL, *[f"B_Tr_T_{n}" for n in CHAIN_TRACK])
    line = F.struct(*CHAIN_LINE, *[F.expr(known[n]).cast("int").alias(n) for n in CHAIN_FLAGS])
    rows = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("_lines"))
    whole = ("Charge", "IsInTree", "Origin_Flag", "TRUE_PARTICLE_ID")
    fields = []
    for n in CHAIN_TRACK:
        name = f"B_Tr_T_{n}"
        made = f"t.{name}" if name in CHAIN_FLAGS else re.sub(r"\bl_", "t.l_", known[name])
        fields.append(f"'{name}', CAST({made} AS {'int' if n in whole else 'double'})")
    tracks = f"transform(_lines, t -> named_struct({', '.join(fields)})) AS tracks"
    signal = [f"{known[n]} AS {n}" for n in ("entry", *CHAIN_SIGNAL)]
    return rows.selectExpr(*signal, tracks, "1 AS RUNNUMBER", "l_orderkey AS EVENTNUMBER")


@query(
    "C1_tag_events",
    f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY subentry, track_part, track_supp) AS sub, CASE WHEN B_Tr_T_PROBNN_K > 0.4 AND B_Tr_T_Origin_Flag <> 0 THEN 1 ELSE 0 END AS selected,
        -B_Tr_T_Charge AS d0 FROM {src('B_TRUEID', 'B_Tr_T_Charge', 'B_Tr_T_Origin_Flag', *CHAIN_INPUTS)} v WHERE abs(B_TRUEID) = 521),
      s AS (SELECT entry, sub, selected, d0, 1e0 - prob_nn AS e0 FROM ({_raw_net(_net_sql('t', list(CHAIN_INPUTS), CHAIN_NET, 'entry, sub, selected, d0'))})),
      f AS (SELECT entry, sub, selected, CAST(CASE WHEN selected = 0 THEN 0 WHEN e0 > 0.5 THEN -d0 ELSE d0 END AS INT) AS d, CASE WHEN selected = 0 THEN 5e-1 WHEN e0 > 0.5 THEN 1e0 - e0 ELSE e0 END AS eta FROM s)
      SELECT entry, d AS "OSKaon_TagDec", round(eta, 7) AS "OSKaon_Eta" FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY selected DESC, eta, sub) AS rn FROM f) WHERE rn = 1""",
)
def tag_events_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chain: nested events, species, complete tracks, derived columns, cut text, network, decision, best track."""
    out = chains.tag_events(nested_events(spark, sf), "Bu2JpsiK", "OSKaon", CHAIN_CUT, CHAIN_NET, CHAIN_INPUTS)
    return rounded(out, "OSKaon_Eta", digits=7).select("entry", "OSKaon_TagDec", "OSKaon_Eta")


RECALIBRATED_SQL = f"""{LONG_SQL}, {_newton_sql('1e0', 'logit')}, {APPLY_SQL}, cb AS (SELECT entry, any_value(B_ID) AS B_ID, {ODDS_SQL.format(d='d_cal', e='omega')} AS s FROM ca GROUP BY entry),
  cmb AS MATERIALIZED (SELECT 'combination' AS tagger, entry, B_ID, CAST(sign(s) AS INT) AS d, 1e0 / (1e0 + exp(abs(s))) AS eta FROM cb), {_newton_sql('1e0', 'mistag', 'cmb', 'z', steps=40)},
  fin AS (SELECT entry, B_ID, CASE WHEN om < 0.5 THEN d ELSE 0 END AS d, CASE WHEN om < 0.5 THEN greatest(om, 0e0) ELSE 5e-1 END AS eta
    FROM (SELECT cmb.*, CASE WHEN d <> 0 AND eta < 0.5 THEN a + bb * (eta - c) END AS om FROM cmb, (SELECT avg(a) AS a, avg(bb) AS bb FROM qz40), fcz))"""


@query("E2_recalibrated_combination", f"WITH {RECALIBRATED_SQL}, {performance_sql('fin', digits=6)} SELECT * FROM figures")
def recalibrated_combination(spark: SparkSession, sf: str) -> DataFrame:
    """The same chain with the combination itself calibrated once more (identity link)."""
    df = long_taggers(spark, sf)
    made = calibration.apply_calibration(df, fitted(df, weight=None), "tagger", "d", "eta")
    joined = stored(calibration.combine_taggers(made, "entry", "d_cal", "omega", ["B_ID"]).withColumn("tagger", F.lit("combination")), "combination")
    fit = calibration.calibrate(joined, "tagger", "d", "eta", "B_ID", links="mistag")
    final = calibration.apply_calibration(joined, fit, "tagger", "d", "eta")
    return rounded(stats.tagging_performance(final, "d_cal", "omega", "B_ID").drop("n_eff"), *FIGURES, digits=6)


@query("C2_combine_files", f"WITH {RECALIBRATED_SQL}, {performance_sql('fin', digits=6)} SELECT * FROM figures")
def combine_files(spark: SparkSession, sf: str) -> DataFrame:
    """Chain: one file per tagger and sample, keys from file names, outer join, calibration, combination, its calibration."""
    best = per_tagger_events(spark, sf).select("entry", "flag", "d", "eta").join(b.candidates(spark, sf, "entry", "run", "B_ID"), "entry")
    root = shared_dir(spark, "taggers")
    best.withColumn("sample", F.concat(F.lit("sample"), F.col("run") % 3)).repartition("flag", "sample").write.partitionBy("flag", "sample").parquet(root)
    tables = {}
    for t in "ANR":
        named = tables_of.keyed_events(spark, f"{root}/flag={t}", r"sample=([^/]+)/", "run", "entry")
        tables[t] = named.select("key", "B_ID", F.col("d").alias(f"{t}_TagDec"), F.col("eta").alias(f"{t}_Eta"))
    return rounded(chains.combine_and_calibrate(tables, "key", "B_ID").performance("B_ID").drop("n_eff"), *FIGURES, digits=6)


@query(
    "C3_trends",
    f"""WITH {b.BEST_SQL}, {stat_queries.WEIGHTED_EV}, bn AS ({' UNION ALL '.join(f"SELECT d, eta, B_ID, w, '{n}' AS split, coalesce({stat_queries._bin_sql(n)}, -2) AS bin FROM wev" for n in stat_queries.BIN_EDGES)}),
      wb AS (SELECT * FROM bn UNION ALL SELECT * REPLACE (-1 AS bin) FROM bn), {performance_sql('wb', 'split, bin', 'w', 12)}
      SELECT a.split, a.bin, round(1e2 * a.tagging_power, 5) AS value, round(1e2 * (a.tagging_power - o.tagging_power), 5) + 0e0 AS deviation
      FROM figures a JOIN (SELECT * FROM figures WHERE bin = -1) o USING (split) WHERE a.bin >= 0""",
)
def trend_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chain: deviation of the weighted power in every bin of all kinematic splits from the whole sample."""
    df = stat_queries.weighted_events(spark, sf, *stat_queries.BIN_EDGES)
    out = chains.trends(df, stat_queries.BIN_EDGES, "d", "eta", "B_ID", "w")
    return rounded(out.select("split", "bin", "value", "deviation"), "value", "deviation", digits=5)


PT_EDGES = [0, 5000, 10000, 15000, 20000, 25000]


@query(
    "E3_weighted_trend",
    f"""WITH {b.BEST_SQL}, {SWEIGHT_SQL}, we AS (SELECT ev.d, ev.eta, ev.B_ID, w_sig, CASE WHEN B_PT < 5000 THEN 0 WHEN B_PT < 10000 THEN 1 WHEN B_PT < 15000 THEN 2 WHEN B_PT < 20000 THEN 3 ELSE 4 END AS bin
        FROM ev JOIN sw ON ev.entry = sw.entry), wb AS (SELECT * FROM we UNION ALL SELECT * REPLACE (-1 AS bin) FROM we), {performance_sql('wb', 'bin', 'w_sig', 12)}
      SELECT a.bin, round(1e2 * a.tagging_power, 5) AS value, round(1e2 * (a.tagging_power - o.tagging_power), 5) + 0e0 AS deviation FROM figures a, (SELECT * FROM figures WHERE bin = -1) o WHERE a.bin >= 0""",
)
def weighted_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Mass fit, sWeights, weighted performance per transverse-momentum bin, deviation from the whole."""
    df = mass_rows(spark, sf, "B_PT")
    found = weights.fit_yields(df)
    weighted = weights.sweights(df, found).select("entry", "B_ID", "B_PT", "signal_weights")
    tagged = b.best_tracks(spark, sf).select("entry", "d", "eta").join(weighted, "entry")
    made = stats.binned_performance(tagged, "B_PT", PT_EDGES, "d", "eta", "B_ID", "signal_weights", overall=True)
    out = stats.trend_deviation(made, "tagging_power", "tagging_power_err")
    return rounded(out.select("bin", "value", "deviation"), "value", "deviation", digits=5)
