"""Registered queries: exact quantiles by series, winsorised rows and outlier fences."""

from __future__ import annotations

from marketflow.operators import quantiles
from marketflow.plans.oracle import with_panel
from marketflow.plans.panel import PANEL_COLUMNS
from marketflow.plans.queries_stats import round_doubles
from marketflow.plans.registry import panel, query, table

PROBS = [0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
VALUES = ["l_quantity", "l_extendedprice", "l_discount"]
COLUMNS = [c for c in PANEL_COLUMNS if c != "date_id"]


def _long_sql(cols: list[str], source: str, keys: str = "") -> str:
    key = keys and keys + ", "
    return " UNION ALL ".join(f"""SELECT {key}'{c}' AS "column", CAST({p} AS DOUBLE) AS p, count({c}) AS n, round(quantile_cont({c}::DOUBLE, {p}), 6) AS value
FROM {source} {keys and 'GROUP BY ' + keys}""" for c in cols for p in PROBS)


@query("quant1_keyed_hot_groups", _long_sql(VALUES, "lineitem", "l_returnflag, l_linestatus"))
def q_hot(spark, sf_dir):
    """Quantiles of three columns in a few series that hold up to half of all rows each."""
    return round_doubles(quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), VALUES, PROBS, ["l_returnflag", "l_linestatus"]))


@query("quant2_keyed_many_series", _long_sql(VALUES, "lineitem", "l_suppkey"))
def q_many(spark, sf_dir):
    """The same for every supplier."""
    return round_doubles(quantiles.exact_quantiles(table(spark, sf_dir, "lineitem"), VALUES, PROBS, ["l_suppkey"]))


@query("quant3_panel", with_panel(_long_sql(COLUMNS, "panel")))
def q_panel(spark, sf_dir):
    """Quantiles of every panel column, nulls skipped, without keys."""
    return round_doubles(quantiles.exact_quantiles(panel(spark, sf_dir), COLUMNS, PROBS))


_PULLED = ", ".join(f"CASE WHEN {c} < a{i} THEN a{i} WHEN {c} > z{i} THEN z{i} ELSE {c} END AS {c}" for i, c in enumerate(VALUES))
_ENDS = ", ".join(f"quantile_cont({c}, 0.05) AS a{i}, quantile_cont({c}, 0.95) AS z{i}" for i, c in enumerate(VALUES))


@query("quant4_winsorised_rows", f"""WITH w AS (SELECT l_suppkey, {_ENDS} FROM lineitem GROUP BY l_suppkey),
p AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_PULLED} FROM lineitem JOIN w USING (l_suppkey))
SELECT l_orderkey, l_linenumber, l_suppkey, {', '.join(f'round({c}, 6) AS {c}' for c in VALUES)} FROM p""")
def q_winsorised(spark, sf_dir):
    """All line items with three columns pulled to their supplier's 5th and 95th percentile."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", *VALUES)
    return round_doubles(quantiles.winsorise(rows, VALUES, ["l_suppkey"], 0.05, 0.95))


_FENCED = " UNION ALL ".join(f"""SELECT "column", any_value(n) AS n, round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper,
  count(*) FILTER (v < lo) AS n_low, count(*) FILTER (v > hi) AS n_high
FROM (SELECT '{c}' AS "column", {c}::DOUBLE AS v FROM panel), (SELECT n, a - 1.5 * (z - a) AS lo, z + 1.5 * (z - a) AS hi
  FROM (SELECT count({c}) AS n, quantile_cont({c}::DOUBLE, 0.25) AS a, quantile_cont({c}::DOUBLE, 0.75) AS z FROM panel)) GROUP BY "column" """ for c in COLUMNS)


@query("quant5_panel_outliers", with_panel(_FENCED))
def q_outliers(spark, sf_dir):
    """Values of every panel column outside the fences of 1.5 interquartile ranges."""
    return round_doubles(quantiles.outlier_counts(panel(spark, sf_dir), COLUMNS))
