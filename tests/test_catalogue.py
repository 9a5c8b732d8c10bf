"""Every catalogue query runs, and agrees with its check SQL where there is one."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from tools.check import TABLES, compare  # noqa: E402
from tools.plans import facts  # noqa: E402

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    verdict = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert not verdict.startswith("FAIL"), verdict


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n"] > 0


@pytest.mark.parametrize("name", ["E1_best_track_performance", "J1_outer_join_taggers", "M19_combine_taggers", "A17_all_splits", "W2_multi_candidate_removal"])
def test_no_quadratic_join_and_no_row_udf(spark, sf_dir, name):
    found = facts(QUERIES[name](spark, sf_dir))
    assert not {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"} & set(found)


def test_best_track_reduces_before_the_shuffle(spark, sf_dir):
    found = facts(QUERIES["W1_best_track_per_event"](spark, sf_dir))
    assert found["WindowGroupLimit"] == 2 and found["Exchange hashpartitioning"] == 1


def test_cut_reaches_the_scan(spark, sf_dir):
    plan = QUERIES["S1_scan_columns"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_returnflag:string>" in plan
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    from tagloom.operators.cuts import keep_passing

    filtered = keep_passing(df, "(l_quantity > 45) & (l_tax <= 0.01)\nOR\n(l_discount >= 0.1)")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
