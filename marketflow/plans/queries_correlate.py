"""Registered queries: correlation matrices of the panel, with the target and between feature groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.functions.rowwise import feature_groups
from marketflow.operators import correlate
from marketflow.plans.oracle import with_panel
from marketflow.plans.panel import PANEL_COLUMNS
from marketflow.plans.queries_stats import round_doubles
from marketflow.plans.registry import cached, panel, query

TARGET = "forward_returns"
COLUMNS = [c for c in PANEL_COLUMNS if c not in ("date_id", "market_forward_excess_returns")]
GROUPS = {g: cs for g, cs in feature_groups(COLUMNS).items() if cs}


def _matrix_ctes(source: str) -> str:
    """CTE mat (a, b, n, corr) of all pairs over ``source`` by DuckDB's own corr."""
    items = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'n': count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL), 'corr': corr({a}::DOUBLE, {b}::DOUBLE)}}"
                      for a in COLUMNS for b in COLUMNS)
    return (f"mat AS (SELECT e.a AS a, e.b AS b, e.n AS n, CASE WHEN isfinite(e.corr) THEN e.corr END AS corr "
            f"FROM (SELECT unnest([{items}]) AS e FROM {source}))")


_RANKS = "ranks AS (SELECT " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (PARTITION BY {c} IS NULL ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 END AS {c}"
    for c in COLUMNS) + " FROM panel)"
_SHOW = "SELECT a, b, n, round(corr, 6) AS corr FROM mat"


def _matrix(spark, sf_dir, kind):
    from marketflow.plans.materialize import materialize
    return cached(f"{kind}_matrix", spark, sf_dir, lambda: materialize(getattr(correlate, kind)(panel(spark, sf_dir), COLUMNS), kind))


@query("corr1_pearson", with_panel(_SHOW, _matrix_ctes("panel")))
def q_pearson(spark, sf_dir):
    """Pearson correlation of all pairs of panel columns, nulls left out pair by pair."""
    return round_doubles(_matrix(spark, sf_dir, "pearson"))


@query("corr2_spearman", with_panel(_SHOW, _RANKS + ",\n" + _matrix_ctes("ranks")))
def q_spearman(spark, sf_dir):
    """Spearman correlation of all pairs of panel columns: average ranks, nulls left out pair by pair."""
    return round_doubles(_matrix(spark, sf_dir, "spearman"))


_MEMBERS = ", ".join(f"('{c}', '{g}')" for g, cs in GROUPS.items() for c in cs)


@query("corr3_between_groups", with_panel(f"""SELECT x.g AS group_a, y.g AS group_b, count(corr) AS n_pairs, round(avg(abs(corr)), 6) AS mean_abs,
  round(max(abs(corr)), 6) AS max_abs FROM mat JOIN names x ON a = x.c JOIN names y ON b = y.c WHERE a <> b AND x.g <= y.g GROUP BY ALL""",
    _matrix_ctes("panel") + f",\nnames(c, g) AS (VALUES {_MEMBERS})"))
def q_groups(spark, sf_dir):
    """Mean and largest absolute Pearson correlation between (and inside) the feature groups."""
    return round_doubles(correlate.between_groups(_matrix(spark, sf_dir, "pearson"), GROUPS))


@query("corr4_with_target", with_panel(f"""SELECT p.a AS "column", p.n AS n, round(p.corr, 6) AS pearson, round(s.corr, 6) AS spearman
FROM mat p JOIN smat s USING (a, b) WHERE b = '{TARGET}' AND a <> '{TARGET}'""",
    _RANKS + ",\n" + _matrix_ctes("panel") + ",\n" + _matrix_ctes("ranks").replace("mat AS", "smat AS", 1)))
def q_target(spark, sf_dir):
    """Every column's Pearson and Spearman correlation with the next day's return."""
    p, s = (correlate.with_target(_matrix(spark, sf_dir, k), TARGET) for k in ("pearson", "spearman"))
    return round_doubles(p.select("column", "n", F.col("corr").alias("pearson")).join(s.select("column", F.col("corr").alias("spearman")), "column"))
