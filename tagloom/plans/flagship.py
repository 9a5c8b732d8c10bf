"""The end-to-end chain: scan, select, tag, best track per event, performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.transforms import fixed
from tagloom.operators.stats import tagging_performance
from tagloom.plans import bindings as b
from tagloom.plans.registry import query

FIGURES = (
    "tag_efficiency", "tag_efficiency_err", "mistag_rate", "mistag_rate_err", "effective_mistag",
    "effective_mistag_err", "tagging_power", "tagging_power_err",
)


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    """Round the named double columns: sums of floats depend on the order of addition."""
    return df.withColumns({n: fixed(F.col(n), digits) for n in names})


def performance_sql(source: str, by: str = "", weight: str = "1e0", digits: int = 8) -> str:
    """Check SQL of the performance figures over a relation with d, eta, B_ID (and the weight)."""
    group = f"{by}, " if by else ""
    tail = f"GROUP BY {by}" if by else ""
    return f"""s AS (SELECT {group}count(*) AS n,
  CAST(coalesce(sum(CASE WHEN d <> 0 AND eta < 0.5 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_tagged,
  sum({weight}) AS sw, sum({weight} * {weight}) AS sw2,
  sum(CASE WHEN d <> 0 AND eta < 0.5 THEN {weight} ELSE 0e0 END) AS swt,
  sum(CASE WHEN d <> 0 AND eta < 0.5 THEN {weight} * {weight} ELSE 0e0 END) AS sw2t,
  sum(CASE WHEN d <> 0 AND eta < 0.5 AND d * sign(B_ID) < 0 THEN {weight} ELSE 0e0 END) AS sww,
  sum(CASE WHEN d <> 0 AND eta < 0.5 THEN {weight} * pow(1e0 - 2e0 * eta, 2) ELSE 0e0 END) AS sd2,
  sum(CASE WHEN d <> 0 AND eta < 0.5 THEN {weight} * pow(1e0 - 2e0 * eta, 4) ELSE 0e0 END) AS sd4
  FROM {source} {tail}),
f AS (SELECT *, swt / sw AS eff, sww / nullif(swt, 0) AS om, sd2 / nullif(swt, 0) AS m2, sd4 / nullif(swt, 0) AS m4,
  sw * sw / sw2 AS ne, swt * swt / nullif(sw2t, 0) AS nt, sd2 / sw AS pw FROM s),
g AS (SELECT *, sqrt(greatest(eff * (1 - eff) / ne, 0)) AS effe, sqrt(greatest(m2, 0)) AS dil,
  sqrt(greatest((m4 - m2 * m2) / nt, 0)) / (4e0 * sqrt(m2)) AS eme FROM f),
figures AS (SELECT {group}n, n_tagged, round(eff, {digits}) AS tag_efficiency, round(effe, {digits}) AS tag_efficiency_err,
  round(om, {digits}) AS mistag_rate, round(sqrt(greatest(om * (1 - om) / nt, 0)), {digits}) AS mistag_rate_err,
  round(0.5 - 0.5 * dil, {digits}) AS effective_mistag, round(eme, {digits}) AS effective_mistag_err,
  round(pw, {digits}) AS tagging_power,
  round(pw * sqrt(pow(effe / eff, 2) + pow(4e0 * eme / dil, 2)), {digits}) AS tagging_power_err FROM g)"""


BEST_TRACK_SQL = f"WITH {b.BEST_SQL}, {performance_sql('ev')} SELECT * FROM figures"


@query("E1_best_track_performance", BEST_TRACK_SQL)
def best_track_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, select by text cut, tag, keep the best track per event, report the performance."""
    events = b.tagged_events(spark, sf_dir, "B_ID")
    figures = tagging_performance(events, "d", "eta", "B_ID").drop("n_eff")
    return rounded(figures, *FIGURES)
