"""Catalogue: sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions import kinematics as kin
from tagloom.functions.transforms import fixed
from tagloom.plans import bindings as b
from tagloom.plans.column_queries import K, src
from tagloom.plans.event_queries import SPLIT_SQL, split_tracks
from tagloom.plans.flagship import FIGURES, performance_sql, rounded
from tagloom.plans.registry import query
from tagloom.session import shared_dir
from tagloom.sources import results, stages, tables
from tagloom.streaming import incremental


@query("S1_scan_columns", "SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem")
def scan_columns(spark: SparkSession, sf: str) -> DataFrame:
    return tables.scan_columns(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_returnflag"])


MERGED = ("c_custkey", "c_acctbal", "s_suppkey", "s_acctbal")
UNION_SQL = """SELECT c_custkey, c_acctbal, CAST(NULL AS BIGINT) AS s_suppkey, CAST(NULL AS DOUBLE) AS s_acctbal, 'customer' AS sample FROM customer
  UNION ALL SELECT NULL, NULL, s_suppkey, s_acctbal, 'supplier' FROM supplier"""


@query("S2_scan_many_union", UNION_SQL)
def scan_many_union(spark: SparkSession, sf: str) -> DataFrame:
    """A glob over two files with different columns, rows tagged by file."""
    return tables.scan_many(spark, f"{sf}/[cs]u*.parquet", MERGED, merge=True)


@query("B7_holdout_by_file", f"SELECT * FROM ({UNION_SQL}) WHERE sample <> 'supplier'")
def holdout_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return tables.without_file(spark, f"{sf}/[cs]u*.parquet", "supplier", columns=MERGED, merge=True)


@query(
    "S3_jagged_flatten",
    """SELECT vec_id AS entry, label, CAST(unnest(range(len(embedding))) AS INT) AS subentry, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0e0 AS x,
      round(CAST(unnest(list_reverse(embedding)) AS DOUBLE), 6) + 0e0 AS y FROM embeddings""",
)
def jagged_flatten(spark: SparkSession, sf: str) -> DataFrame:
    df = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("entry"), "label", F.col("embedding").alias("x"), F.reverse("embedding").alias("y")
    )
    flat = tables.flatten(df, ["x", "y"])
    return flat.withColumns({c: fixed(F.col(c).cast("double"), 6) for c in ("x", "y")})


@query("S4_chunked_append", f"SELECT {K}, round(prob, 8) AS prob FROM {src('prob')}")
def chunked_append(spark: SparkSession, sf: str) -> DataFrame:
    """Two disjoint halves appended to one output, the second one twice as after an interrupted run."""
    path = shared_dir(spark, "chunks")
    df = b.tracks(spark, sf, "prob")
    for batch in (0, 1, 1):
        stages.append_in_chunks(df.filter(F.col("entry") % 2 == batch), "entry", 10, path, f"half{batch}")
    return rounded(stages.read_batches(spark, path, df.schema).drop("batch", "chunk"), "prob")


@query("S5_write_stage", f"WITH {b.TAGGED_SQL} SELECT {K}, selected, 'Bu2JpsiK' AS decay, 'OSKaon' AS tagger FROM tagged WHERE selected = 1")
def write_stage(spark: SparkSession, sf: str) -> DataFrame:
    """Two stage tables below one root; reading one prunes the other's directories."""
    root = shared_dir(spark, "stage")
    df = b.tagged_tracks(spark, sf).select(*b.ROW_KEYS, "selected")
    stages.write_stage(df.filter("selected = 1"), root, {"decay": "Bu2JpsiK", "tagger": "OSKaon"})
    stages.write_stage(df.filter("selected = 0"), root, {"decay": "Bs2DsPi", "tagger": "SSKaon"})
    return stages.read_stage(spark, root, decay="Bu2JpsiK", tagger="OSKaon")


@query("S6_parquet_sets", f"WITH {b.TAGGED_SQL}, {SPLIT_SQL} SELECT {K}, selected, label, B_TRUEID, subset FROM lab WHERE selected = 1 OR subset = 'test'")
def parquet_sets(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_dir(spark, "sets")

    def build() -> DataFrame:
        return split_tracks(spark, sf).filter("selected = 1 OR subset = 'test'")

    stages.cached_sets(spark, root, build)
    return stages.cached_sets(spark, root, build)  # second call reads the stored sets


RESULT_SCHEMA = "power struct<value: double, sigma: double>, n long"
RESULT_KEYS = {
    "tagger": (r"tagger=([^/]+)/", "string"),
    "seed": (r"seed=(\d+)/", "int"),
    "numlayers": (r"numlayers=(\d+)/", "int"),
    "batch_size": (r"batch_size=(\d+)/", "int"),
}


@query("S7_json_results_scan", f"SELECT tagger, seed, numlayers, batch_size, n, power, sigma FROM ({b.GRID_SQL})")
def json_results_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Nested JSON files written by key directories, keys read back from the paths."""
    root = shared_dir(spark, "results")
    rows = b.grid_results(spark, sf)
    nested = rows.select(*RESULT_KEYS, F.struct(F.col("power").alias("value"), "sigma").alias("power"), "n")
    nested.write.partitionBy(*RESULT_KEYS).json(root)
    found = results.scan_results(spark, root, RESULT_SCHEMA, RESULT_KEYS)
    return found.select(*RESULT_KEYS, "n", F.col("power.value").alias("power"), F.col("power.sigma").alias("sigma"))


@query("S9_csv_sets", f"SELECT {K}, round(prob, 8) AS prob FROM {src('prob')}")
def csv_sets(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "csv")
    stages.write_csv(rounded(b.tracks(spark, sf, "prob"), "prob"), path)
    return stages.read_csv(spark, path, "entry long, subentry int, track_part long, track_supp long, prob double")


# streams -------------------------------------------------------------------------------------------------


def _lineitem_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = b.table(spark, sf, "lineitem").schema
    return incremental.file_stream(spark, sf, schema, "lineitem.parquet")


@query(
    "T1s_incremental_features",
    f"SELECT {K}, round(atan2(sin(B_PHI - B_Tr_T_Phi), cos(B_PHI - B_Tr_T_Phi)), 6) + 0e0 AS dphi FROM {src('B_PHI', 'B_Tr_T_Phi')}",
)
def incremental_features(spark: SparkSession, sf: str) -> DataFrame:
    output, checkpoint = shared_dir(spark, "features"), shared_dir(spark, "features-state")
    names = [f"{e} AS {n}" for n, e in b.roles("B_PHI", "B_Tr_T_Phi").items()]

    def derive(df: DataFrame) -> DataFrame:
        tracks = df.selectExpr(*names)
        dphi = kin.phi_distance(F.col("B_PHI"), F.col("B_Tr_T_Phi"))
        return tracks.select(*b.ROW_KEYS, fixed(dphi, 6).alias("dphi"))

    incremental.run_available(incremental.incremental_features(_lineitem_stream(spark, sf), derive), output, checkpoint)
    return spark.read.parquet(output)


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = b.table(spark, sf, "events").schema
    stream = incremental.file_stream(spark, sf, schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("T2s_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """(user, type) plays (run, event); the delay exceeds the replayed time span."""
    output, checkpoint = shared_dir(spark, "dedupe"), shared_dir(spark, "dedupe-state")
    stream = incremental.dedupe_events(_event_stream(spark, sf), ["user_id", "event_type"], "ts", "60 days")
    incremental.run_available(stream.select("user_id", "event_type"), output, checkpoint)
    return spark.read.parquet(output)


EVENT_ROLES = {
    "d": "CASE WHEN event_type = 'view' THEN 0 WHEN user_id % 2 = 0 THEN 1 ELSE -1 END",
    "eta": "(event_id % 499) / 1e3",
    "B_ID": "CASE WHEN event_id % 3 = 0 THEN -521 ELSE 521 END",
}


@query(
    "T3s_windowed_performance",
    f"""WITH v AS (SELECT date_trunc('day', ts) AS day, {', '.join(f'{e} AS {n}' for n, e in EVENT_ROLES.items())} FROM events),
      k AS (SELECT strftime(day, '%Y-%m-%d') AS day, d, eta, B_ID FROM v), {performance_sql('k', 'day')} SELECT * FROM figures""",
)
def windowed_performance(spark: SparkSession, sf: str) -> DataFrame:
    """Daily performance of a replayed stream: closed windows from its output, those left open from its state."""
    output, checkpoint = shared_dir(spark, "windows"), shared_dir(spark, "windows-state")
    stream = _event_stream(spark, sf).withColumns({n: F.expr(e) for n, e in EVENT_ROLES.items()})
    made = incremental.windowed_performance(stream, "ts", "10 minutes", "1 day", "d", "eta", "B_ID")
    incremental.run_available(made, output, checkpoint)
    closed = spark.read.parquet(output)
    left = incremental.open_windows(spark, checkpoint)
    df = closed.unionByName(left).withColumn("day", F.date_format("window_start", "yyyy-MM-dd"))
    return rounded(df.drop("window_start", "window_end", "n_eff"), *FIGURES)
