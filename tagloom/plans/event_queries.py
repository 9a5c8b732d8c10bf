"""Catalogue: event reductions, joins, unions, splits and balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import tagging as tag
from tagloom.functions.transforms import fixed
from tagloom.operators import cuts, events, joins, ranking, sampling, stats
from tagloom.plans import bindings as b
from tagloom.plans.column_queries import GAPS, K, ORIGIN, PLAIN_CASE, classified, src
from tagloom.plans.registry import query


@query("W1_best_track_per_event", f"WITH {b.BEST_SQL} SELECT {K}, selected, d, round(eta, 8) AS eta FROM best")
def best_track_per_event(spark: SparkSession, sf: str) -> DataFrame:
    return b.best_tracks(spark, sf).select(*b.ROW_KEYS, "selected", "d", fixed("eta", 8).alias("eta"))


@query(
    "W2_multi_candidate_removal",
    f"""SELECT {K} FROM (SELECT *, min(entry) OVER (PARTITION BY track_part, track_supp) AS keep FROM {src()}) WHERE entry = keep""",
)
def multi_candidate_removal(spark: SparkSession, sf: str) -> DataFrame:
    """(part, supplier) plays (run, event); the order key is the candidate number."""
    df = events.drop_multiple_candidates(b.tracks(spark, sf), ["track_part", "track_supp"], "entry")
    return df.select(*b.ROW_KEYS)


@query(
    "W3_event_dedupe",
    f"""SELECT {K} FROM (SELECT *, row_number() OVER (PARTITION BY track_part, track_supp ORDER BY entry, subentry) AS rn FROM {src()}) WHERE rn = 1""",
)
def event_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return events.first_per_group(b.tracks(spark, sf), ["track_part", "track_supp"], ["entry", "subentry"])


@query(
    "W4_best_candidate_per_tagger",
    f"""WITH r AS (SELECT *, power / sigma AS ratio FROM ({b.GRID_SQL}) WHERE power <> 0 AND sigma <> 0)
      SELECT tagger, seed, numlayers, batch_size, power, sigma, round(ratio, 6) AS ratio, goal FROM (
        SELECT *, 'nominal' AS goal, row_number() OVER (PARTITION BY tagger ORDER BY power DESC, seed, numlayers, batch_size) AS rn FROM r
        UNION ALL
        SELECT *, 'ratio' AS goal, row_number() OVER (PARTITION BY tagger ORDER BY ratio DESC, seed, numlayers, batch_size) AS rn FROM r) WHERE rn = 1""",
)
def best_candidate_per_tagger(spark: SparkSession, sf: str) -> DataFrame:
    results, ties = b.grid_results(spark, sf), ["seed", "numlayers", "batch_size"]
    both = [
        stats.best_candidate(results, ["tagger"], "power", "sigma", goal, ties).withColumn("goal", F.lit(goal))
        for goal in ("nominal", "ratio")
    ]
    out = joins.concat_tables(both)
    return out.select("tagger", *ties, "power", "sigma", fixed("ratio", 6).alias("ratio"), "goal")


@query(
    "W5_dense_event_id",
    f"SELECT {K}, dense_rank() OVER (ORDER BY track_part, track_supp) - 1 AS event_id FROM {src()}",
)
def dense_event_id(spark: SparkSession, sf: str) -> DataFrame:
    df = ranking.dense_ids(b.tracks(spark, sf), "track_part", "track_supp", "event_id")
    return df.select(*b.ROW_KEYS, "event_id")


@query(
    "W6_top_n_report",
    """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL
      ORDER BY n DESC, l_returnflag, l_linestatus, l_linenumber LIMIT 10""",
)
def top_n_report(spark: SparkSession, sf: str) -> DataFrame:
    by = ["l_returnflag", "l_linestatus", "l_linenumber"]
    counted = b.table(spark, sf, "lineitem").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return stats.top_values(counted, 10, by)


def _hash(keys: str, seed: int) -> str:
    return f"md5(concat_ws('_', {keys}, '{seed}'))"


@query("W7_shuffle", f"SELECT {K}, {_hash(K, 42)} AS shuffle_key FROM {src()}")
def shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """The permutation key; a consumer that needs the order sorts by it."""
    return sampling.shuffle_order(b.tracks(spark, sf), b.ROW_KEYS, 42)


@query(
    "A14_group_first",
    f"""WITH g AS (SELECT {', '.join(f'{e} AS {n}' for n, e in b.KEYS.items())}, {', '.join(GAPS)} FROM lineitem)
      SELECT {K}, a, b FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY subentry, track_part, track_supp, a, b) AS rn
        FROM g WHERE a IS NOT NULL AND NOT isnan(b)) WHERE rn = 1""",
)
def group_first(spark: SparkSession, sf: str) -> DataFrame:
    keys = [f"{e} AS {n}" for n, e in b.KEYS.items()]
    complete = cuts.drop_incomplete(b.table(spark, sf, "lineitem").selectExpr(*keys, *GAPS), ["a", "b"])
    return events.first_per_group(complete, ["entry"], ["subentry", "track_part", "track_supp", "a", "b"])


# joins ------------------------------------------------------------------------------------------

PER_TAGGER = f"""{b.TAGGED_SQL}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry, flag
   ORDER BY selected DESC, eta, subentry, track_part, track_supp, d) AS rn FROM tagged) WHERE rn = 1)"""


def per_tagger_events(spark: SparkSession, sf: str) -> DataFrame:
    """Best track per (event, tagger); the return flag plays the tagger."""
    slim = b.tagged_tracks(spark, sf).select("flag", *b.ROW_KEYS, "selected", "d", "eta")
    ties = ["subentry", "track_part", "track_supp", "d"]
    return events.best_track_per_event(slim, ["entry", "flag"], "selected", "eta", ties)


def wide_taggers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event of the long table; tables that come apart are joined by ``outer_join_taggers``, as in C2."""
    return joins.widen_taggers(per_tagger_events(spark, sf).select("entry", "flag", "d", "eta"), "entry", "flag", ["A", "N", "R"])


@query(
    "J1_outer_join_taggers",
    f"""WITH {PER_TAGGER}, a AS (SELECT * FROM one WHERE flag = 'A'), n AS (SELECT * FROM one WHERE flag = 'N'), r AS (SELECT * FROM one WHERE flag = 'R')
      SELECT coalesce(a.entry, n.entry, r.entry) AS entry, a.d AS "A_d", round(a.eta, 8) AS "A_eta", n.d AS "N_d",
      round(n.eta, 8) AS "N_eta", r.d AS "R_d", round(r.eta, 8) AS "R_eta"
      FROM a FULL OUTER JOIN n ON a.entry = n.entry FULL OUTER JOIN r ON coalesce(a.entry, n.entry) = r.entry""",
)
def outer_join_taggers(spark: SparkSession, sf: str) -> DataFrame:
    wide = wide_taggers(spark, sf)
    return wide.withColumns({f"{t}_eta": fixed(f"{t}_eta", 8) for t in "ANR"})


@query(
    "J3_semi_join_list",
    f"SELECT {K} FROM {src()} WHERE track_supp IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
)
def semi_join_list(spark: SparkSession, sf: str) -> DataFrame:
    listed = b.table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("track_supp"))
    return joins.keep_listed(b.tracks(spark, sf), listed, "track_supp").select(*b.ROW_KEYS)


@query(
    "J4_keyed_attach",
    f"""SELECT {K}, w FROM {src()} JOIN (SELECT o_orderkey AS k, (o_custkey % 10 - 2) / 4e0 AS w FROM orders) ON entry = k""",
)
def keyed_attach(spark: SparkSession, sf: str) -> DataFrame:
    weights = b.table(spark, sf, "orders").selectExpr("o_orderkey AS entry", "(o_custkey % 10 - 2) / 4e0 AS w")
    return joins.attach_by_key(b.tracks(spark, sf), weights, "entry")


# the configured axes; the part table lists the combinations that exist
GRID_AXES = {
    "p_brand": [f"Brand#{i}" for i in range(1, 26)],
    "p_type": ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"],
    "p_size": list(range(1, 51)),
}


@query(
    "J6_missing_grid_points",
    f"""SELECT * FROM (SELECT 'Brand#' || unnest(range(1, 26)) AS p_brand), (SELECT unnest({GRID_AXES['p_type']}) AS p_type),
      (SELECT CAST(unnest(range(1, 51)) AS INT) AS p_size) EXCEPT SELECT p_brand, p_type, p_size FROM part""",
)
def missing_grid_points(spark: SparkSession, sf: str) -> DataFrame:
    return joins.missing_grid_points(b.table(spark, sf, "part"), GRID_AXES)


@query(
    "J7_mask_overlap",
    f"""WITH m AS (SELECT B_Tr_T_IsInTree <> 1 AS a, B_Tr_T_Origin_Flag <> 0 AS o FROM {src('B_Tr_T_IsInTree', 'B_Tr_T_Origin_Flag')})
      SELECT count(*) FILTER (a AND NOT o) AS only_first, count(*) FILTER (o AND NOT a) AS only_second,
      count(*) FILTER (a AND o) AS both, count(*) FILTER (a <> o) = 0 AS equivalent FROM m""",
)
def mask_overlap(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_IsInTree", "B_Tr_T_Origin_Flag")
    return joins.mask_overlap(df, F.col("B_Tr_T_IsInTree") != 1, F.col("B_Tr_T_Origin_Flag") != 0)


# unions -----------------------------------------------------------------------------------------


@query(
    "U1_concat",
    """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
      UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier""",
)
def concat(spark: SparkSession, sf: str) -> DataFrame:
    customer = b.table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_nationkey AS nation", "c_acctbal AS balance")
    supplier = b.table(spark, sf, "supplier").selectExpr("s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS balance")
    return joins.concat_tables([customer, supplier])


@query("U2_concat_restore", f"WITH {b.TAGGED_SQL} SELECT {K}, selected FROM tagged")
def concat_restore(spark: SparkSession, sf: str) -> DataFrame:
    """Selected and unselected rows re-united; row keys carry the original order."""
    df = b.tagged_tracks(spark, sf).select(*b.ROW_KEYS, "selected")
    return joins.concat_tables([df.filter("selected = 1"), df.filter("selected = 0")])


# splits and balancing -----------------------------------------------------------------------------

SPLIT_SQL = f"""e AS MATERIALIZED (SELECT entry, row_number() OVER (ORDER BY h) AS rk, count(*) OVER () AS ne FROM
   (SELECT DISTINCT entry, md5(concat_ws('_', entry, '3')) AS h FROM tagged)),
 sp AS MATERIALIZED (SELECT t.*, CASE WHEN rk <= floor(0.8e0 * floor(0.6e0 * ne)) THEN 'train' WHEN rk <= floor(0.6e0 * ne) THEN 'val' ELSE 'test' END AS subset,
   CASE WHEN t.entry % 3 = 1 THEN -521 WHEN t.entry % 3 = 0 THEN 521 ELSE 531 END AS B_TRUEID FROM tagged t JOIN e ON t.entry = e.entry),
 lab AS MATERIALIZED (SELECT *, CASE WHEN d0 * sign(B_TRUEID) = 1 THEN 1 ELSE 0 END AS label, CASE WHEN B_TRUEID > 0 THEN 1 ELSE 0 END AS s,
   md5(concat_ws('_', {K}, '3')) AS h FROM sp)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks with selected, flavour and label."""
    df = b.tagged_tracks(spark, sf).select(*b.ROW_KEYS, "selected", "charge")
    df = df.withColumn("B_TRUEID", F.expr("CASE WHEN entry % 3 = 1 THEN -521 WHEN entry % 3 = 0 THEN 521 ELSE 531 END"))
    decision = tag.tag_decision(F.col("charge"), "Bu2JpsiK", "OSKaon")
    return df.withColumn("label", tag.tag_label(decision, F.col("B_TRUEID"))).drop("charge")


def split_tracks(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.split_by_event(labelled(spark, sf), "entry", train_val_fraction=0.6)


@query("B1_split_by_event", f"WITH {b.TAGGED_SQL}, {SPLIT_SQL} SELECT {K}, selected, subset FROM lab WHERE selected = 1 OR subset = 'test'")
def split_by_event(spark: SparkSession, sf: str) -> DataFrame:
    """Train and val keep selected rows, test keeps all."""
    df = split_tracks(spark, sf).filter((F.col("selected") == 1) | (F.col("subset") == "test"))
    return df.select(*b.ROW_KEYS, "selected", "subset")


def _balance_sql(classes: str, where: str = "selected = 1") -> str:
    return f"""c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {classes} ORDER BY h) AS rn, count(*) OVER (PARTITION BY {classes}) AS sz FROM lab WHERE {where})"""


@query(
    "B2_balance_four_bins",
    f"WITH {b.TAGGED_SQL}, {SPLIT_SQL}, {_balance_sql('s, label')} SELECT {K}, B_TRUEID, label FROM c WHERE rn <= (SELECT min(sz) FROM c)",
)
def balance_four_bins(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).filter("selected = 1").withColumn("sign", (F.col("B_TRUEID") > 0).cast("int"))
    kept = sampling.balance_classes(df, ["sign", "label"], b.ROW_KEYS, expected=4)
    return kept.select(*b.ROW_KEYS, "B_TRUEID", "label")


@query(
    "B3_balance_by_label",
    f"WITH {b.TAGGED_SQL}, {SPLIT_SQL}, {_balance_sql('label')} SELECT {K}, label FROM c WHERE rn <= (SELECT min(sz) FROM c)",
)
def balance_by_label(spark: SparkSession, sf: str) -> DataFrame:
    df = labelled(spark, sf).filter("selected = 1")
    return sampling.balance_classes(df, ["label"], b.ROW_KEYS, expected=2).select(*b.ROW_KEYS, "label")


def _level_sql(level: int) -> str:
    sets = "('train', 'val', 'test')" if level == 0 else "('train', 'val')"
    classes = "subset, label" if level == 2 else "subset, s, label"
    rest = "subset = 'test' AND selected = 0" if level == 0 else "subset = 'test'"
    return f"""WITH {b.TAGGED_SQL}, {SPLIT_SQL}, {_balance_sql(classes, f"selected = 1 AND subset IN {sets}")},
      k AS (SELECT *, min(sz) OVER (PARTITION BY subset) AS k FROM c)
      SELECT {K}, subset, selected, B_TRUEID, label FROM k WHERE rn <= k
      UNION ALL SELECT {K}, subset, selected, B_TRUEID, label FROM lab WHERE {rest}"""


def _level(spark: SparkSession, sf: str, level: int) -> DataFrame:
    sets = sampling.balanced_sets(
        split_tracks(spark, sf), level, "subset", "selected", "B_TRUEID", "label", b.ROW_KEYS
    )
    return sets.select(*b.ROW_KEYS, "subset", "selected", "B_TRUEID", "label")


@query("B4_asym_level0", _level_sql(0))
def asym_level0(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, 0)


@query("B4_asym_level1", _level_sql(1))
def asym_level1(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, 1)


@query("B4_asym_level2", _level_sql(2))
def asym_level2(spark: SparkSession, sf: str) -> DataFrame:
    return _level(spark, sf, 2)


@query(
    "B5_downsample_majority",
    f"""WITH p AS (SELECT {K}, {PLAIN_CASE} AS particle, {_hash(K, 42)} AS h FROM {src(*ORIGIN)}),
      r AS (SELECT *, row_number() OVER (PARTITION BY particle ORDER BY h) AS rn FROM p)
      SELECT {K}, particle FROM r WHERE particle <> 'notSamePV' OR rn <= (SELECT count(*) FROM p WHERE particle = 'SSPion')""",
)
def downsample_majority(spark: SparkSession, sf: str) -> DataFrame:
    df = classified(b.tracks(spark, sf, *ORIGIN)).select(*b.ROW_KEYS, "particle")
    size = sampling.class_size(df, "particle", "SSPion")
    return sampling.downsample_class(df, "particle", "notSamePV", size, b.ROW_KEYS)


@query(
    "B6_class_balance_head",
    f"""WITH p AS (SELECT {K}, CASE WHEN abs(B_Tr_T_TRUE_PARTICLE_ID) = 321 THEN 1 ELSE 0 END AS label, {_hash(K, 42)} AS h FROM {src('B_Tr_T_TRUE_PARTICLE_ID')}),
      r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM p)
      SELECT {K}, label FROM r WHERE label = 1 OR rn <= (SELECT count(*) FROM p WHERE label = 1)""",
)
def class_balance_head(spark: SparkSession, sf: str) -> DataFrame:
    df = b.tracks(spark, sf, "B_Tr_T_TRUE_PARTICLE_ID")
    df = df.select(*b.ROW_KEYS, (F.abs("B_Tr_T_TRUE_PARTICLE_ID") == 321).cast("int").alias("label"))
    return sampling.balance_head(df, "label", b.ROW_KEYS)


@query(
    "B8_random_test_split",
    f"SELECT {K}, CASE WHEN substr({_hash(K, 42)}, 1, 8) < '{int(0.7 * 16**8):08x}' THEN 'train' ELSE 'test' END AS subset FROM {src()}",
)
def random_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_split(b.tracks(spark, sf), b.ROW_KEYS, {"train": 0.7, "test": 0.3}, 42)
