"""Catalogue: counts, confusion tables, histograms, performance figures, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagloom.functions.transforms import fixed
from tagloom.operators import calibration, events, hist, joins, stats
from tagloom.plans import bindings as b
from tagloom.plans.column_queries import K, MERGED_CASE, ORIGIN, PLAIN_CASE, classified, src
from tagloom.plans.event_queries import PER_TAGGER, SPLIT_SQL, labelled, per_tagger_events, split_tracks
from tagloom.plans.flagship import FIGURES, performance_sql, rounded
from tagloom.plans.registry import query

CODES = {"Kaon": 321, "Muon": 13, "Electron": 11, "Pion": 211, "Proton": 2212}
CLASSES = ["OSKaon", "OSMuon", "OSElectron", "SSPion", "SSProton", "SSKaon", "notSamePV", "Others"]
# a second opinion on the class, standing in for a prediction
GUESS = "CASE WHEN B_Tr_T_PROBNN_K > 0.8 THEN 'OSKaon' WHEN B_Tr_T_PROBNN_MU > 0.8 THEN 'OSMuon' WHEN B_Tr_T_PROBNN_E > 0.8 THEN 'OSElectron' WHEN B_Tr_T_PROBNN_PI > 0.5 THEN 'SSPion' ELSE 'notSamePV' END"
GUESSED = (*ORIGIN, "B_Tr_T_PROBNN_K", "B_Tr_T_PROBNN_MU", "B_Tr_T_PROBNN_E", "B_Tr_T_PROBNN_PI")


def guessed(spark: SparkSession, sf: str) -> DataFrame:
    return classified(b.tracks(spark, sf, *GUESSED)).withColumn("predicted", F.expr(GUESS))


GUESSED_SQL = f"p AS (SELECT *, {PLAIN_CASE} AS particle, {GUESS} AS predicted FROM {src(*GUESSED)})"


@query(
    "A1_value_counts",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(100e0 * count(*) / (SELECT count(*) FROM lineitem), 6) AS percent
      FROM lineitem GROUP BY 1, 2""",
)
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = stats.value_counts(b.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return rounded(counted, "percent", digits=6)


@query(
    "A2_bkgcat_composition",
    f"""WITH p AS (SELECT {PLAIN_CASE} AS particle, B_BKGCAT FROM {src(*ORIGIN, 'B_BKGCAT')}),
      c AS (SELECT particle, B_BKGCAT, count(*) AS n FROM p GROUP BY 1, 2)
      SELECT *, round(100e0 * n / sum(n) OVER (PARTITION BY particle), 6) AS percent FROM c""",
)
def bkgcat_composition(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(b.tracks(spark, sf, *ORIGIN, "B_BKGCAT"))
    return rounded(stats.value_counts(df, ["particle", "B_BKGCAT"], ["particle"]), "percent", digits=6)


@query(
    "A3_id_composition",
    "SELECT "
    + ", ".join(
        f"round(round(avg(CASE WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = {c} THEN 1e0 ELSE 0e0 END), 2) * 100, 6) AS \"{n}\"" for n, c in CODES.items()
    )
    + f" FROM {src('B_Tr_T_TRUE_PARTICLE_ID')}",
)
def id_composition(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.composition(b.tracks(spark, sf, "B_Tr_T_TRUE_PARTICLE_ID"), "B_Tr_T_TRUE_PARTICLE_ID", CODES)
    return rounded(made, *CODES, digits=6)


@query(
    "A4_distinct_events",
    f"""WITH {b.TAGGED_SQL}, {SPLIT_SQL} SELECT subset, count(DISTINCT entry) AS events, count(DISTINCT CASE WHEN selected = 1 THEN entry END) AS selected_events,
      count(*) AS tracks, CAST(sum(selected) AS BIGINT) AS selected_tracks FROM lab GROUP BY subset""",
)
def distinct_events(spark: SparkSession, sf: str) -> DataFrame:
    return events.count_events(split_tracks(spark, sf), "entry", "selected", ["subset"])


def _asymmetry_sql() -> str:
    cells = ", ".join(
        f"count(*) FILTER (label = {c} AND B_TRUEID {op} 0) AS n_{n}_l{c}" for c in (1, 0) for n, op in (("b", ">"), ("antib", "<"))
    )
    extra = ", ".join(
        f"round(1e2 * n_b_l{c} / n, 6) AS percent_b_l{c}, round(1e2 * n_antib_l{c} / n, 6) AS percent_antib_l{c}, "
        f"round(1e2 * (n_b_l{c} - n_antib_l{c}) / (n_b_l{c} + n_antib_l{c}), 6) AS asymmetry_l{c}"
        for c in (1, 0)
    )
    return f"WITH {b.TAGGED_SQL}, {SPLIT_SQL}, c AS (SELECT subset, count(*) AS n, {cells} FROM lab GROUP BY subset) SELECT *, {extra} FROM c"


@query("A5_label_asymmetry", _asymmetry_sql())
def label_asymmetry(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.label_asymmetry(split_tracks(spark, sf), ["subset"], "label", "B_TRUEID")
    return rounded(made, *[c for c in made.columns if c.startswith(("percent", "asym"))], digits=6)


def _confusion_sql(normalise: str, merged: list[str]) -> str:
    names = [c for c in CLASSES if c not in merged] + ["UnifiedOthers"]
    listed = ", ".join(f"'{m}'" for m in merged)

    def fold(c: str) -> str:
        return f"CASE WHEN {c} IN ({listed}) THEN 'UnifiedOthers' ELSE {c} END"

    counts = ", ".join(f"count(*) FILTER (q = '{n}') AS \"c_{n}\"" for n in names)
    whole = " + ".join(f'"c_{n}"' for n in names)

    def cell(n: str) -> str:
        total = f'sum("c_{n}") OVER ()' if normalise == "predicted" else f"({whole})"
        return f"CASE WHEN {total} > 0 THEN printf('%.2f', 1e2 * \"c_{n}\" / {total}) ELSE 'Not predicted' END AS \"{n}\""

    return (
        f"WITH {GUESSED_SQL}, m AS (SELECT {fold('particle')} AS truth, {fold('predicted')} AS q FROM p), "
        f"c AS (SELECT truth, {counts} FROM m GROUP BY truth) SELECT truth, {', '.join(cell(n) for n in names)} FROM c"
    )


@query("A6_confusion_matrix", _confusion_sql("truth", ["SSKaon", "Others"]))
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confusion_table(guessed(spark, sf), "particle", "predicted", CLASSES, "truth", ["SSKaon", "Others"])


@query("A6_confusion_by_prediction", _confusion_sql("predicted", ["SSKaon", "Others"]))
def confusion_by_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confusion_table(guessed(spark, sf), "particle", "predicted", CLASSES, "predicted", ["SSKaon", "Others"])


@query(
    "A7_confusion_weighted",
    f"""WITH {GUESSED_SQL}, c AS (SELECT particle, predicted, count(*) AS n FROM p GROUP BY 1, 2),
      w AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY particle) AS DOUBLE) AS weight FROM c),
      s AS (SELECT *, sum(weight) OVER (PARTITION BY predicted) AS total FROM w), k AS (SELECT *, weight / total AS k FROM s)
      SELECT particle, predicted, n, round(k, 8) AS share, round(k * (1 - k) / total, 8) AS variance,
      round(sqrt(greatest(k * (1 - k) / total, 0)), 6) AS error FROM k""",
)
def confusion_weighted(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.confusion_weighted(guessed(spark, sf), "particle", "predicted", True, "predicted")
    return rounded(rounded(made, "share", "variance", digits=8), "error", digits=6)


@query(
    "A8_mask_counts",
    f"""SELECT count(*) FILTER (B_Tr_T_PROBNN_K > 0.4192) AS "OSKaon", count(*) FILTER (B_Tr_T_PROBNN_MU > 0.6472) AS "OSMuon",
      count(*) FILTER (B_Tr_T_PROBNN_E > 0.6606) AS "OSElectron" FROM {src('B_Tr_T_PROBNN_K', 'B_Tr_T_PROBNN_MU', 'B_Tr_T_PROBNN_E')}""",
)
def mask_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_PROBNN_K", "B_Tr_T_PROBNN_MU", "B_Tr_T_PROBNN_E")
    masks = {
        "OSKaon": F.col("B_Tr_T_PROBNN_K") > 0.4192,
        "OSMuon": F.col("B_Tr_T_PROBNN_MU") > 0.6472,
        "OSElectron": F.col("B_Tr_T_PROBNN_E") > 0.6606,
    }
    return stats.mask_counts(df, masks)


def hist_sql(source: str, value: str, low: str, high: str, bins: int, by: str = "", weight: str = "", ctes: str = "") -> str:
    """Check SQL of a zero-filled histogram with density."""
    width = f"(({high} - {low}) / {bins}e0)"
    group = f"{by}, " if by else ""
    content = f"sum({weight})" if weight else "count(*)"
    zero = "0e0" if weight else "0"
    n = f"round(coalesce(n, {zero}), 6)" if weight else f"coalesce(n, {zero})"
    keys = f"(SELECT DISTINCT {by} FROM c), " if by else ""
    on = f"g.bin = c.bin AND {' AND '.join(f'g.{x} = c.{x}' for x in by.split(', '))}" if by else "g.bin = c.bin"
    over = f"PARTITION BY {', '.join('g.' + x for x in by.split(', '))}" if by else ""
    out = ", ".join(f"g.{x} AS {x}" for x in by.split(", ")) + ", " if by else ""
    return f"""WITH {ctes + ', ' if ctes else ''}c AS (SELECT {group}CAST(least(floor(({value} - {low}) / {width}), {bins - 1}) AS INT) AS bin, {content} AS n
      FROM {source} WHERE {value} >= {low} AND {value} <= {high} GROUP BY ALL),
      g AS (SELECT * FROM {keys}(SELECT CAST(unnest(range({bins})) AS INT) AS bin))
      SELECT {out}g.bin AS bin, round({low} + g.bin * {width}, 6) AS bin_low, {n} AS n,
      round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER ({over}) * {width}), 10) AS density FROM g LEFT JOIN c ON {on}"""


def shown(histogram: DataFrame, weighted: bool = False) -> DataFrame:
    out = rounded(rounded(histogram, "bin_low", digits=6), "density", digits=10)
    return rounded(out, "n", digits=6) if weighted else out


@query("A9_hist1d", hist_sql("lineitem", "l_extendedprice", "1e3", "1e5", 50, "l_returnflag"))
def hist1d(spark: SparkSession, sf: str) -> DataFrame:
    df = b.table(spark, sf, "lineitem")
    return shown(hist.histogram(df, "l_extendedprice", 1e3, 1e5, 50, ["l_returnflag"]))


WEIGHT = "(o_custkey % 10 - 2) / 4e0"


@query(
    "A10_hist1d_weighted",
    hist_sql(f"(SELECT o_totalprice, {WEIGHT} AS w FROM orders)", "o_totalprice", "0e0", "5e5", 40, weight="w"),
)
def hist1d_weighted(spark: SparkSession, sf: str) -> DataFrame:
    df = b.table(spark, sf, "orders").selectExpr("o_totalprice", f"{WEIGHT} AS w")
    return shown(hist.histogram(df, "o_totalprice", 0.0, 5e5, 40, weight="w"), True)


@query(
    "A11_hist_common_bins",
    hist_sql(
        "(SELECT l.*, lo, hi FROM lineitem l, r)", "l_extendedprice", "(SELECT lo FROM r)", "(SELECT hi FROM r)", 60, "l_returnflag",
        ctes="r AS (SELECT min(l_extendedprice) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem)",
    ),
)
def hist_common_bins(spark: SparkSession, sf: str) -> DataFrame:
    return shown(hist.histogram_common(b.table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@query("A11_hist_integer_bins", hist_sql("lineitem", "l_linenumber", "5e-1", "7.5e0", 7, "l_returnflag"))
def hist_integer_bins(spark: SparkSession, sf: str) -> DataFrame:
    return shown(hist.histogram_common(b.table(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", integer=True))


@query(
    "A11_exact_quantile",
    "SELECT round(quantile_cont(l_extendedprice, 0.995), 6) AS q FROM lineitem",
)
def exact_quantile(spark: SparkSession, sf: str) -> DataFrame:
    made = hist.exact_quantile(b.table(spark, sf, "lineitem"), "l_extendedprice", 0.995, "q")
    return rounded(made, "q", digits=6)


@query(
    "A12_hist_difference",
    """WITH c AS (SELECT CAST(least(floor((l_quantity - 1e0) / (49e0 / 25)), 24) AS INT) AS bin, count(*) FILTER (l_returnflag = 'N') AS p,
        count(*) FILTER (l_returnflag <> 'N') AS m FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1),
      d AS (SELECT bin, p / (sum(p) OVER () * (49e0 / 25)) AS dp, m / (sum(m) OVER () * (49e0 / 25)) AS dm FROM c)
      SELECT bin, round(dp, 8) AS density_positive, round(dm, 8) AS density_negative, round(dp - dm, 8) + 0e0 AS difference FROM d""",
)
def hist_difference(spark: SparkSession, sf: str) -> DataFrame:
    df, flag = b.table(spark, sf, "lineitem"), F.col("l_returnflag")
    made = hist.histogram_difference(df, "l_quantity", 1.0, 50.0, 25, flag == "N", flag != "N")
    return rounded(made, "density_positive", "density_negative", "difference", digits=8)


@query(
    "A13_fit_pulls",
    """WITH c AS (SELECT CAST(least(floor(o_totalprice / 1e4), 49) AS INT) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1),
      g AS (SELECT CAST(unnest(range(50)) AS INT) AS bin), f AS (SELECT g.bin, coalesce(n, 0) AS n, sum(n) OVER () / 5e1 AS model FROM g LEFT JOIN c ON g.bin = c.bin)
      SELECT bin, n, round(model, 6) AS model, CASE WHEN n > 0 THEN round((n - model) / sqrt(n), 6) END AS pull FROM f""",
)
def fit_pulls(spark: SparkSession, sf: str) -> DataFrame:
    """Pulls of a spectrum against a flat model with the same total."""
    counted = hist.histogram(b.table(spark, sf, "orders"), "o_totalprice", 0.0, 5e5, 50)
    model = F.sum("n").over(Window.partitionBy()) / 50.0  # one row per bin
    made = hist.pulls(counted.withColumn("model", model), "n", "model")
    return rounded(made, "model", "pull", digits=6).select("bin", "n", "model", "pull")


@query(
    "A15_roc_auc",
    f"""WITH {b.TAGGED_SQL}, {SPLIT_SQL}, v AS (SELECT prob, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS m FROM lab GROUP BY prob),
      r AS (SELECT *, coalesce(sum(m) OVER (ORDER BY prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v)
      SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(m) AS BIGINT) AS negatives, round(sum(p * (below + 5e-1 * m)) / (sum(p) * CAST(sum(m) AS DOUBLE)), 8) AS auc FROM r""",
)
def roc_auc(spark: SparkSession, sf: str) -> DataFrame:
    df = scored(spark, sf)
    return rounded(stats.roc_auc(df, "prob", "label"), "auc")


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Track score and correctness label."""
    lines = b.table(spark, sf, "lineitem").selectExpr(
        "l_extendedprice / 1.05e5 AS prob",
        "CASE WHEN (CASE WHEN l_returnflag = 'N' THEN -1 ELSE 1 END) * (CASE WHEN l_orderkey % 3 = 1 THEN -1 ELSE 1 END) = 1 THEN 1 ELSE 0 END AS label",
    )
    return lines


@query(
    "A15_roc_curve",
    f"""WITH {b.TAGGED_SQL}, {SPLIT_SQL}, v AS (SELECT prob, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS m FROM lab GROUP BY prob),
      r AS (SELECT prob, sum(p) OVER w AS tp, sum(m) OVER w AS fp, sum(p) OVER () AS np, sum(m) OVER () AS nm FROM v WINDOW w AS (ORDER BY prob DESC ROWS UNBOUNDED PRECEDING))
      SELECT round(prob, 9) AS score, round(CAST(fp AS DOUBLE) / nm, 8) AS fpr, round(CAST(tp AS DOUBLE) / np, 8) AS tpr FROM r
      UNION ALL SELECT CAST(NULL AS DOUBLE), 0e0, 0e0""",
)
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.roc_curve(scored(spark, sf), "prob", "label")
    return rounded(rounded(made, "fpr", "tpr", digits=8), "score", digits=9)


WEIGHTED_EV = f"wev AS (SELECT *, (run % 10 - 2) / 4e0 AS w FROM ev)"


def weighted_events(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    df = b.tagged_events(spark, sf, "run", "B_ID", *names)
    return df.withColumn("w", (F.col("run") % 10 - 2) / 4.0)


@query("A16_tagging_performance", f"WITH {PER_TAGGER}, pt AS (SELECT o.flag AS tagger, o.d, o.eta, c.B_ID FROM one o JOIN ({b.candidates_sql('entry', 'B_ID')}) c ON o.entry = c.entry), {performance_sql('pt', 'tagger')} SELECT * FROM figures")
def tagging_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Performance of every tagger."""
    df = per_tagger_events(spark, sf).select("entry", F.col("flag").alias("tagger"), "d", "eta")
    df = df.join(b.candidates(spark, sf, "entry", "B_ID"), "entry")
    return rounded(stats.tagging_performance(df, "d", "eta", "B_ID", by=["tagger"]).drop("n_eff"), *FIGURES)


@query("A16_weighted_performance", f"WITH {b.BEST_SQL}, {WEIGHTED_EV}, {performance_sql('wev', weight='w')} SELECT * FROM figures")
def weighted_performance(spark: SparkSession, sf: str) -> DataFrame:
    """The same with signed weights."""
    made = stats.tagging_performance(weighted_events(spark, sf), "d", "eta", "B_ID", "w")
    return rounded(made.drop("n_eff"), *FIGURES)


# Bin edges of the kinematic splits.
BIN_EDGES = {
    "B_PT": [0, 5000, 10000, 15000, 20000, 25000],
    "B_ETA": [2.0, 3.0, 4.0, 5.0],
    "B_nPVs": [0, 4, 5, 6, 7, 100],
    "B_nTracks": [0, 250, 500, 750, 10000],
}


def _bin_sql(name: str) -> str:
    edges = BIN_EDGES[name]
    arms = " ".join(f"WHEN {name} >= {lo} AND {name} < {hi} THEN {i}" for i, (lo, hi) in enumerate(zip(edges, edges[1:])))
    return f"CASE {arms} END"


@query(
    "A17_binned_performance",
    f"WITH {b.BEST_SQL}, {WEIGHTED_EV}, bn AS (SELECT *, {_bin_sql('B_PT')} AS bin FROM wev), bb AS (SELECT * FROM bn WHERE bin IS NOT NULL), {performance_sql('bb', 'bin', 'w')} SELECT * FROM figures",
)
def binned_performance(spark: SparkSession, sf: str) -> DataFrame:
    df = weighted_events(spark, sf, "B_PT")
    made = stats.binned_performance(df, "B_PT", BIN_EDGES["B_PT"], "d", "eta", "B_ID", "w")
    return rounded(made.drop("n_eff"), *FIGURES)


def all_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once per kinematic split, labelled (split, bin); one job for all splits."""
    df = weighted_events(spark, sf, *BIN_EDGES)
    labels = [
        F.struct(F.lit(name).alias("split"), stats.bucket_of(name, edges).alias("bin")) for name, edges in BIN_EDGES.items()
    ]
    return df.select("d", "eta", "B_ID", "w", F.explode(F.array(*labels)).alias("_s")).select("d", "eta", "B_ID", "w", "_s.*")


@query(
    "A17_all_splits",
    f"WITH {b.BEST_SQL}, {WEIGHTED_EV}, bn AS ("
    + " UNION ALL ".join(f"SELECT d, eta, B_ID, w, '{n}' AS split, {_bin_sql(n)} AS bin FROM wev" for n in BIN_EDGES)
    + f"), bb AS (SELECT * FROM bn WHERE bin IS NOT NULL), {performance_sql('bb', 'split, bin', 'w')} SELECT * FROM figures",
)
def binned_all_splits(spark: SparkSession, sf: str) -> DataFrame:
    df = all_splits(spark, sf).filter("bin IS NOT NULL")
    made = stats.tagging_performance(df, "d", "eta", "B_ID", "w", ["split", "bin"])
    return rounded(made.drop("n_eff"), *FIGURES)


@query(
    "A18_trend_deviation",
    f"""WITH {b.BEST_SQL}, {WEIGHTED_EV}, bn AS (SELECT *, {_bin_sql('B_PT')} AS bin FROM wev),
      bb AS (SELECT * FROM bn WHERE bin IS NOT NULL UNION ALL SELECT * REPLACE (-1 AS bin) FROM bn), {performance_sql('bb', 'bin', 'w', 12)},
      t AS (SELECT a.bin, 1e2 * a.tag_efficiency AS v, 1e2 * (a.tag_efficiency - o.tag_efficiency) AS dv, 1e2 * abs(a.tag_efficiency_err - o.tag_efficiency_err) AS de
        FROM figures a, (SELECT * FROM figures WHERE bin = -1) o WHERE a.bin >= 0)
      SELECT bin, round(v, 6) AS value, round(dv, 6) + 0e0 AS deviation, round(de, 6) AS deviation_err, round(dv / de, 4) + 0e0 AS deviation_normed FROM t""",
)
def trend_deviation(spark: SparkSession, sf: str) -> DataFrame:
    df = weighted_events(spark, sf, "B_PT")
    made = stats.binned_performance(df, "B_PT", BIN_EDGES["B_PT"], "d", "eta", "B_ID", "w", overall=True)
    out = stats.trend_deviation(made, "tag_efficiency", "tag_efficiency_err")
    return rounded(rounded(out, "value", "deviation", "deviation_err", digits=6), "deviation_normed", digits=4)


def _curve_sql(binning: str, by: str = "", extra: str = "") -> str:
    group = f"{by}, " if by else ""
    return f"""WITH {b.BEST_SQL}, {WEIGHTED_EV}, r AS (SELECT eta, w, sign(B_ID)::INT AS flavour, CASE WHEN d * sign(B_ID) < 0 THEN 1e0 ELSE 0e0 END AS wrong
        FROM wev WHERE d <> 0 AND eta < 0.5), {extra} q AS (SELECT *, CAST(greatest(least({binning}, 9), 0) AS INT) AS bin FROM {'o' if extra else 'r'}),
      s AS (SELECT {group}bin, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, sum(w * wrong) AS sx, sum(w * eta) AS se FROM q GROUP BY {group}bin)
      SELECT {group}bin, n, round(se / sw, 8) AS mean_eta, round(sx / sw, 8) AS omega,
      round(sqrt(greatest(sx / sw * (1 - sx / sw) / (sw * sw / sw2), 0)), 8) AS omega_err FROM s"""


def _ordered(by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    key = f"{by}, eta" if by else "eta"
    return f"""vals AS (SELECT {key}, sum(w) AS vw FROM r GROUP BY {key}),
      cum AS (SELECT *, coalesce(sum(vw) OVER ({part} ORDER BY eta ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(vw) OVER ({part}) AS total FROM vals),
      o AS (SELECT r.*, before, total FROM r JOIN cum USING ({key})),"""


@query("A19_calibration_curve", _curve_sql("floor(1e1 * before / total)", extra=_ordered()))
def calibration_curve(spark: SparkSession, sf: str) -> DataFrame:
    made = calibration.calibration_curve(weighted_events(spark, sf), "d", "eta", "B_ID", "w")
    return rounded(made, "mean_eta", "omega", "omega_err")


@query("A19_calibration_curve_fixed", _curve_sql("floor(eta / (5e-1 / 1e1))"))
def calibration_curve_fixed(spark: SparkSession, sf: str) -> DataFrame:
    made = calibration.calibration_curve(weighted_events(spark, sf), "d", "eta", "B_ID", "w", equal_yield=False)
    return rounded(made, "mean_eta", "omega", "omega_err")


@query("M22_flavour_split_calibration", _curve_sql("floor(1e1 * before / total)", "flavour", _ordered("flavour")))
def flavour_split_calibration(spark: SparkSession, sf: str) -> DataFrame:
    df = weighted_events(spark, sf).withColumn("flavour", F.signum("B_ID").cast("int"))
    made = calibration.calibration_curve(df, "d", "eta", "B_ID", "w", by=["flavour"])
    return rounded(made, "mean_eta", "omega", "omega_err")


def _sig(x: str, digits: str) -> str:
    return f"(round({x} * pow(1e1, {digits})) / pow(1e1, {digits}))"


@query(
    "A20_error_combine",
    f"""WITH e AS (SELECT tagger, seed, numlayers, batch_size, 1e2 * power AS v, 1e2 * sqrt(sigma * sigma + sigma_cal * sigma_cal) AS err FROM ({b.GRID_SQL})),
      r AS (SELECT *, {_sig('err', '(-floor(log10(err)))')} AS er FROM e)
      SELECT tagger, seed, numlayers, batch_size, round(v, 6) AS value_scaled, round(err, 6) AS error_scaled, round(er, 8) AS error_rounded,
      round({_sig('v', '(-floor(log10(er)))')}, 8) AS value_rounded FROM r""",
)
def error_combine(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.combine_errors(b.grid_results(spark, sf), "power", ["sigma", "sigma_cal"])
    out = rounded(rounded(made, "value_scaled", "error_scaled", digits=6), "error_rounded", "value_rounded")
    return out.drop("n", "power", "sigma", "sigma_cal")


@query(
    "A21_neff_per_lumi",
    f"""SELECT tagger, seed, numlayers, batch_size, round(n / 2.19e0 * power, 6) AS neff_per_lumi,
      round(n / 2.19e0 * power * sqrt(pow(sigma / power, 2) + pow(2e-2, 2)), 6) AS neff_per_lumi_err FROM ({b.GRID_SQL})""",
)
def neff_per_lumi(spark: SparkSession, sf: str) -> DataFrame:
    df = b.grid_results(spark, sf).withColumns({"lumi": F.lit(2.19), "lumi_rel": F.lit(0.02)})
    made = stats.effective_yield(df, "n", "lumi", "power", "sigma", "lumi_rel")
    return rounded(
        made.select("tagger", "seed", "numlayers", "batch_size", "neff_per_lumi", "neff_per_lumi_err"),
        "neff_per_lumi", "neff_per_lumi_err", digits=6,
    )


@query(
    "A22_sum_of_taggers",
    f"SELECT seed, round(sum(power), 6) AS sum_power, max(sigma_cal) AS combined_power FROM ({b.GRID_SQL}) GROUP BY seed",
)
def sum_of_taggers(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.sum_of_taggers(b.grid_results(spark, sf), "power", "sigma_cal", ["seed"])
    return rounded(made, "sum_power", digits=6)


@query(
    "A23_seed_spread",
    f"SELECT seed, count(*) AS n, round(avg(power), 6) AS mean, round(avg(sigma), 6) AS mean_error FROM ({b.GRID_SQL}) WHERE numlayers = 3 AND batch_size = 256 GROUP BY seed",
)
def seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.seed_spread(b.grid_results(spark, sf), "seed", "power", "sigma", {"numlayers": 3, "batch_size": 256})
    return rounded(made, "mean", "mean_error", digits=6)


@query(
    "A24_pivot_heatmap",
    f"""WITH g AS ({b.GRID_SQL}), m AS (SELECT numlayers, batch_size, max(power) AS p FROM g GROUP BY 1, 2)
      SELECT numlayers, {', '.join(f'max(p) FILTER (batch_size = {v}) AS batch_size_{v}' for v in (128, 256, 384, 512))},
      (SELECT min(p) FROM m) AS vmin, (SELECT max(p) FROM m) AS vmax FROM m GROUP BY numlayers""",
)
def pivot_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pivot_heatmap(b.grid_results(spark, sf), "numlayers", "batch_size", [128, 256, 384, 512], "power")


# report tables --------------------------------------------------------------------------------------


@query("R1_mistag_distribution", hist_sql("m", "eta", "0e0", "5e-1", 50, "d", ctes=f"{b.TAGGED_SQL}, m AS (SELECT * FROM tagged WHERE d <> 0)"))
def mistag_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """Mistag distribution per decision value."""
    return shown(hist.histogram(b.tagged_tracks(spark, sf).filter("d <> 0"), "eta", 0.0, 0.5, 50, ["d"]))


@query(
    "R2_feature_by_class",
    hist_sql(f"(SELECT {PLAIN_CASE} AS particle, B_Tr_T_OWNPVIPCHI2 FROM {src(*ORIGIN, 'B_Tr_T_OWNPVIPCHI2')})", "B_Tr_T_OWNPVIPCHI2", "0e0", "5e1", 25, "particle"),
)
def feature_by_class(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(b.tracks(spark, sf, *ORIGIN, "B_Tr_T_OWNPVIPCHI2"))
    return shown(hist.histogram(df, "B_Tr_T_OWNPVIPCHI2", 0.0, 50.0, 25, ["particle"]))


@query("R3_mass_histogram", hist_sql(f"({b.candidates_sql('mass')})", "mass", "5.2e3", "5.4e3", 100))
def mass_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return shown(hist.histogram(b.candidates(spark, sf, "mass"), "mass", 5200.0, 5400.0, 100))


@query(
    "R4_data_simulation_events",
    hist_sql("u", "npv", "-5e-1", "8.5e0", 9, "sample", ctes=f"""f AS (SELECT *, row_number() OVER (PARTITION BY track_part, track_supp ORDER BY entry, subentry) AS rn FROM {src()}),
      u AS (SELECT CASE WHEN track_supp % 2 = 0 THEN 'data' ELSE 'simulation' END AS sample, entry % 9 AS npv FROM f WHERE rn = 1)"""),
)
def data_simulation_events(spark: SparkSession, sf: str) -> DataFrame:
    """Event-level feature of two samples on common integer bins, after event de-duplication."""
    df = events.first_per_group(b.tracks(spark, sf), ["track_part", "track_supp"], ["entry", "subentry"])
    sample = F.when(F.col("track_supp") % 2 == 0, "data").otherwise("simulation")
    df = df.select(sample.alias("sample"), (F.col("entry") % 9).alias("npv"))
    return shown(hist.histogram_common(df, "npv", "sample", integer=True))


@query(
    "R5_pid_species",
    """WITH p AS (SELECT CASE l_suppkey % 6 WHEN 0 THEN 321 WHEN 1 THEN -13 WHEN 2 THEN 11 WHEN 3 THEN -211 WHEN 4 THEN 2212 ELSE 211 END AS id,
        CAST(least(floor(l_quantity / 5), 9) AS INT) AS bx, CAST(least(floor(l_discount * 1e2 / 2), 4) AS INT) AS py FROM lineitem)
      SELECT abs(id) AS species, bx, py, count(*) AS n FROM p GROUP BY ALL""",
)
def pid_species(spark: SparkSession, sf: str) -> DataFrame:
    """Two-dimensional identification plane per species, as binned counts."""
    df = b.table(spark, sf, "lineitem").selectExpr(
        f"abs({b.TRACK['B_Tr_T_TRUE_PARTICLE_ID']}) AS species",
        "CAST(least(floor(l_quantity / 5), 9) AS INT) AS bx",
        "CAST(least(floor(l_discount * 1e2 / 2), 4) AS INT) AS py",
    )
    return df.groupBy("species", "bx", "py").agg(F.count(F.lit(1)).alias("n"))


@query(
    "R6_feature_by_sign",
    hist_sql(
        f"(SELECT {PLAIN_CASE} AS particle, CAST(sign(B_TRUEID) * B_Tr_T_Charge AS INT) AS sign_tag, B_Tr_T_PIDK FROM {src(*ORIGIN, 'B_Tr_T_Charge', 'B_TRUEID', 'B_Tr_T_PIDK')})",
        "B_Tr_T_PIDK", "-2.5e1", "2.5e1", 20, "particle, sign_tag",
    ),
)
def feature_by_sign(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(b.tracks(spark, sf, *ORIGIN, "B_Tr_T_Charge", "B_TRUEID", "B_Tr_T_PIDK"))
    df = df.withColumn("sign_tag", (F.signum("B_TRUEID") * F.col("B_Tr_T_Charge")).cast("int"))
    return shown(hist.histogram(df, "B_Tr_T_PIDK", -25.0, 25.0, 20, ["particle", "sign_tag"]))


@query(
    "R7_power_table",
    f"""WITH {PER_TAGGER}, pt AS (SELECT o.flag AS tagger, o.d, o.eta, c.B_ID FROM one o JOIN ({b.candidates_sql('entry', 'B_ID')}) c ON o.entry = c.entry),
      {performance_sql('pt', 'tagger', digits=12)} SELECT tagger, round(1e2 * tag_efficiency, 4) AS efficiency_percent, round(1e2 * tagging_power, 4) AS power_percent,
      round(1e2 * tagging_power_err, 4) AS power_error_percent, round(1e2 * sum(tagging_power) OVER (), 4) AS sum_power_percent FROM figures""",
)
def power_table(spark: SparkSession, sf: str) -> DataFrame:
    """Percent table of efficiency and power per tagger with the sum of single powers."""
    df = per_tagger_events(spark, sf).select("entry", F.col("flag").alias("tagger"), "d", "eta")
    df = df.join(b.candidates(spark, sf, "entry", "B_ID"), "entry")
    made = stats.tagging_performance(df, "d", "eta", "B_ID", by=["tagger"])
    total = F.sum("tagging_power").over(Window.partitionBy())  # one row per tagger
    percent = {
        "efficiency_percent": F.col("tag_efficiency"),
        "power_percent": F.col("tagging_power"),
        "power_error_percent": F.col("tagging_power_err"),
        "sum_power_percent": total,
    }
    return made.select("tagger", *[fixed(100.0 * c, 4).alias(n) for n, c in percent.items()])


BY_ID = ("B_Tr_T_PIDK", "B_Tr_T_PT")
BY_ID_RANGES = {"B_Tr_T_PIDK": (-25.0, 25.0), "B_Tr_T_PT": (0.0, 2000.0)}


def _by_id_sql() -> str:
    rows = f"(SELECT l.*, r.B_Tr_T_PIDK, r.B_Tr_T_PT FROM lab l JOIN (SELECT DISTINCT {K}, B_Tr_T_PIDK, B_Tr_T_PT FROM {src(*BY_ID)}) r USING ({K}))"
    parts = []
    for name, (low, high) in BY_ID_RANGES.items():
        one = hist_sql(rows, name, f"{low:e}", f"{high:e}", 20, "label, flavour")
        one = one.replace(rows, f"(SELECT *, CAST(sign(B_TRUEID) AS INT) AS flavour FROM {rows} WHERE abs(B_TRUEID) = 521)")
        parts.append(f"SELECT '{name}' AS feature, * FROM ({one})")
    return f"WITH {b.TAGGED_SQL}, {SPLIT_SQL} " + " UNION ALL ".join(parts)


@query("R8_feature_by_true_id", _by_id_sql())
def feature_by_true_id(spark: SparkSession, sf: str) -> DataFrame:
    """Input features by label and sign of the true flavour, several features from one scan, on fixed edges."""
    df = labelled(spark, sf).filter("abs(B_TRUEID) = 521").withColumn("flavour", F.signum("B_TRUEID").cast("int"))
    df = df.join(b.tracks(spark, sf, *BY_ID).distinct(), b.ROW_KEYS)
    return shown(hist.histograms(df, BY_ID_RANGES, 20, ["label", "flavour"]))


TRACK_FEATURES = {"B_Tr_T_PROBNN_K": (0.0, 1.0), "B_Tr_T_PROBNN_MU": (0.0, 1.0), "B_Tr_T_PIDK": (-25.0, 25.0)}
SAMPLE_SQL = "CASE WHEN entry % 3 = 0 THEN 'Bu_data' WHEN entry % 3 = 1 THEN 'Bu_mc' ELSE 'Bd_mc' END"


@query(
    "R9_track_features_by_sample",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, * FROM ({hist_sql(f'(SELECT {SAMPLE_SQL} AS sample, {n} FROM {src(n)})', n, f'{lo:e}', f'{hi:e}', 25, 'sample')})" for n, (lo, hi) in TRACK_FEATURES.items()
    ),
)
def track_features_by_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Track-level features of data and simulation, each sample normalised, on common edges."""
    df = b.tracks(spark, sf, *TRACK_FEATURES).withColumn("sample", F.expr(SAMPLE_SQL))
    return shown(hist.histograms(df, TRACK_FEATURES, 25, ["sample"]))
