"""Registered queries: profile and statistics, row-wise features, imputation,
scalar functions (AGG1-AGG9, ROW1-ROW6, IMP1-IMP2, FN1-FN5, MOD5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.functions.rowwise import (GROUP_PREFIXES, add_group_features, feature_groups,
                                          interaction_names)
from marketflow.functions.scalar import fmt, ret_to_signal
from marketflow.operators import profile
from marketflow.operators.impute import fill_null, median_fill, medians_frame
from marketflow.plans.oracle import with_panel
from marketflow.plans.panel import PANEL_COLUMNS
from marketflow.plans.registry import panel, query

P = PANEL_COLUMNS
NUMERIC_P = P  # every panel column is numeric


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Presentation step for oracle comparison: round double columns."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), places).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, 6) AS {alias}"


# ---------------------------------------------------------------- statistics

@query("agg1_agg2_agg3_target_stats", with_panel(
    "SELECT " + ", ".join([_r("avg(forward_returns)", "mean"), _r("stddev_samp(forward_returns)", "std"),
                           _r("min(forward_returns)", "min"), _r("max(forward_returns)", "max")]) + " FROM panel"))
def q_target_stats(spark, sf_dir):
    """AGG1 mean, AGG2 sample std, AGG3 min/max of the target."""
    return round_doubles(profile.column_stats(panel(spark, sf_dir), "forward_returns"))


@query("agg4_prediction_stats", with_panel(
    "SELECT " + ", ".join([_r("avg(lagged_forward_returns)", "mean"), _r("stddev_pop(lagged_forward_returns)", "std"),
                           _r("min(lagged_forward_returns)", "min"), _r("max(lagged_forward_returns)", "max")])
    + " FROM panel"))
def q_pred_stats(spark, sf_dir):
    """AGG4: prediction statistics with POPULATION std (stand-in predictions:
    the lagged return)."""
    return round_doubles(profile.prediction_stats(panel(spark, sf_dir), "lagged_forward_returns"))


_NULLS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS col_idx, '{c}' AS \"column\", count(*) - count({c}) AS n_null FROM panel"
    for i, c in enumerate(P))


@query("agg5_flt7_null_counts", with_panel(f"SELECT * FROM ({_NULLS_SQL}) WHERE n_null > 0"))
def q_nulls(spark, sf_dir):
    """AGG5 null count per column (long table) + FLT7 keep columns with nulls."""
    return profile.columns_with_nulls(profile.null_counts(panel(spark, sf_dir)))


@query("agg6_agg7_agg8_missing_summary", with_panel(f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST({len(P)} AS BIGINT) AS n_cols,
       CAST(({" + ".join(f"CASE WHEN count(*) > count({c}) THEN 1 ELSE 0 END" for c in P)}) AS BIGINT) AS n_cols_with_nulls,
       CAST(({" + ".join(f"count(*) - count({c})" for c in P)}) AS BIGINT) AS n_null_cells,
       round(({" + ".join(f"count(*) - count({c})" for c in P)}) * 100.0 / (count(*) * {len(P)}), 6) AS missing_pct
FROM panel"""))
def q_missing(spark, sf_dir):
    """AGG6 columns with nulls, AGG7 missing ratio %, AGG8 shape."""
    return round_doubles(profile.missing_summary(panel(spark, sf_dir)))


@query("agg9_exact_medians", with_panel(
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(median(CAST({c} AS DOUBLE)), 6) AS median FROM panel"
                       for c in P)))
def q_medians(spark, sf_dir):
    """AGG9: exact median of every numeric column (bounded-memory selection)."""
    return round_doubles(medians_frame(panel(spark, sf_dir), list(NUMERIC_P)))


# ------------------------------------------------------- row-wise / imputation

def _groups():
    return feature_groups(P)


def _group_sql() -> list[tuple[str, str]]:
    """(alias, DuckDB expression) for ROW1-ROW6, same arithmetic as Spark."""
    out = []
    for g, cols in _groups().items():
        if not cols:
            continue
        lst = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in cols) + "]"
        nn = f"list_filter({lst}, lambda x: x IS NOT NULL)"
        n = f"len({nn})"
        s = f"list_reduce(list_prepend(0.0, {nn}), lambda a, x: a + x)"
        mu = f"({s}) / {n}"
        ss = f"list_reduce(list_prepend(0.0, list_transform({nn}, lambda x: (x - {mu}) * (x - {mu}))), lambda a, x: a + x)"
        out += [(f"{g}_mean", f"CASE WHEN {n} > 0 THEN {mu} END"),
                (f"{g}_std", f"CASE WHEN {n} >= 2 THEN sqrt(({ss}) / ({n} - 1)) END"),
                (f"{g}_min", f"list_min({lst})"), (f"{g}_max", f"list_max({lst})"),
                (f"{g}_range", f"list_max({lst}) - list_min({lst})")]
    return out


def _features_sql(fill: bool) -> str:
    feats = _group_sql()
    inter = [(f"{a}_{b}_interaction", f"{a}_mean * {b}_mean") for a, b in interaction_names(_groups())]
    base = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in feats) + " FROM panel"
    step2 = "SELECT *, " + ", ".join(f"{e} AS {a}" for a, e in inter) + " FROM feat1"
    cols = P + [a for a, _ in feats] + [a for a, _ in inter]
    ints = {"date_id", "D1", "D2"}
    # same arithmetic in the same order as the Spark expressions: values are
    # bit-identical, so nothing is rounded
    sel = [f"coalesce({c}, median({c}) OVER ()) AS {c}" if fill and c not in ints else c for c in cols]
    return with_panel("SELECT " + ", ".join(sel) + " FROM feat2",
                      f"feat1 AS ({base}),\nfeat2 AS ({step2})")


def group_features(spark, sf_dir):
    return add_group_features(panel(spark, sf_dir), _groups())


@query("row1_row6_group_features", _features_sql(fill=False))
def q_rowwise(spark, sf_dir):
    """ROW1-ROW5 per prefix group (mean, sample std, min, max, range; nulls
    skipped) + ROW6 15 pairwise products of group means."""
    return group_features(spark, sf_dir)


@query("row1_row6_imp2_create_features", _features_sql(fill=True))
def q_create_features(spark, sf_dir):
    """Flagship batch feature build: ROW1-ROW6 on unfilled data, then IMP2
    median fill of every numeric column that has nulls (own-table medians)."""
    return median_fill(group_features(spark, sf_dir))


@query("imp2_median_fill", with_panel("SELECT " + ", ".join(
    c if c in ("date_id", "D1", "D2") else f"coalesce({c}, median({c}) OVER ()) AS {c}" for c in P)
    + " FROM panel"))
def q_median_fill(spark, sf_dir):
    return median_fill(panel(spark, sf_dir))


@query("imp1_fill_from_expression", with_panel(
    "SELECT date_id, coalesce(E3, E2) AS E3, coalesce(P9, P12 / P13) AS P9, coalesce(S5, S1 + S2) AS S5 FROM panel"))
def q_imp1(spark, sf_dir):
    """IMP1: fill a null from another expression of the same row."""
    p = panel(spark, sf_dir)
    return p.select("date_id", fill_null(F.col("E3"), F.col("E2")).alias("E3"),
                    fill_null(F.col("P9"), F.col("P12") / F.col("P13")).alias("P9"),
                    fill_null(F.col("S5"), F.col("S1") + F.col("S2")).alias("S5"))


# ------------------------------------------------------------------ scalars

@query("fn2_mod5_signal", with_panel("""
SELECT date_id, lagged_forward_returns AS pred,
       CASE WHEN lagged_forward_returns IS NOT NULL
            THEN least(greatest(lagged_forward_returns * 400.0 + 1.0, 0.0), 2.0) END AS signal
FROM panel"""))
def q_signal(spark, sf_dir):
    """FN2 clip / MOD5 return -> position signal clip(400 p + 1, 0, 2), NULL kept."""
    p = panel(spark, sf_dir)
    return p.select("date_id", F.col("lagged_forward_returns").alias("pred"),
                    ret_to_signal("lagged_forward_returns").alias("signal"))


@query("fn1_fn3_fn5_formatted_metrics", with_panel("""
SELECT printf('%.6f', avg(forward_returns)) AS mean_txt,
       printf('%.6f', sqrt(avg((forward_returns - lagged_forward_returns) * (forward_returns - lagged_forward_returns)))) AS rmse_txt,
       printf('%.2f', (count(*) - count(E3)) * 100.0 / count(*)) AS e3_missing_pct_txt
FROM panel"""))
def q_fmt(spark, sf_dir):
    """FN1 arithmetic, FN3 square / sqrt, FN5 fixed-decimal text."""
    p = panel(spark, sf_dir)
    d = F.col("forward_returns") - F.col("lagged_forward_returns")
    a = p.agg(F.avg("forward_returns").alias("m"), F.sqrt(F.avg(F.pow(d, 2))).alias("r"),
              ((F.count(F.lit(1)) - F.count("E3")) * 100.0 / F.count(F.lit(1))).alias("e"))
    return a.select(fmt("m").alias("mean_txt"), fmt("r").alias("rmse_txt"), fmt("e", 2).alias("e3_missing_pct_txt"))
