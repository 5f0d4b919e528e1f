"""Registered queries: blend-weight search and stacking on the out-of-fold scores of the stand-in ensemble."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import evaluate, stack
from marketflow.plans.materialize import materialize
from marketflow.plans.oracle import with_panel
from marketflow.plans.queries_models import _STANDIN_SQL, N_SPLITS, _long_scores, _standin
from marketflow.plans.queries_stats import round_doubles
from marketflow.plans.registry import cached, query

MODELS = list(evaluate.BLEND_WEIGHTS)


def _stack_run(spark, sf_dir):
    """(wide scores, weights by fold), written once per session and input."""
    def build():
        val, _ = _standin(spark, sf_dir)
        wide = stack.wide_scores(_long_scores(val, ["date_id", "fold", "forward_returns"]), MODELS, ["date_id", "fold", "forward_returns"])
        wide = materialize(wide, "wide")
        grams = stack.gram_table(wide, "forward_returns", len(MODELS), ["fold"])
        return wide, materialize(stack.nested_weights(grams, MODELS), "weights")
    return cached("stack", spark, sf_dir, build)


def simplex_sql(points: str, group: str) -> str:
    """SQL of the best weights on the simplex for three models a, b, c and target y, by trying every set of models that can
    have a positive weight (the three vertices, edges, and the inside)."""
    return f"""
sums AS (SELECT {group}, count(*) AS n_fit, sum((a - c) * (a - c)) AS aa, sum((b - c) * (b - c)) AS bb, sum((a - c) * (b - c)) AS ab,
  sum((a - c) * (y - c)) AS ay, sum((b - c) * (y - c)) AS b_y, sum((y - c) * (y - c)) AS yy FROM ({points}) GROUP BY {group}),
tries AS (
  SELECT *, 1.0 AS wa, 0.0 AS wb FROM sums UNION ALL SELECT *, 0.0, 1.0 FROM sums UNION ALL SELECT *, 0.0, 0.0 FROM sums
  UNION ALL SELECT *, ay / aa, 0.0 FROM sums WHERE aa > 0 UNION ALL SELECT *, 0.0, b_y / bb FROM sums WHERE bb > 0
  UNION ALL SELECT * EXCLUDE (t), t, 1 - t FROM (SELECT *, (ay - ab - b_y + bb) / (aa - 2 * ab + bb) AS t FROM sums WHERE aa - 2 * ab + bb > 0)
  UNION ALL SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab), (b_y * aa - ay * ab) / (aa * bb - ab * ab) FROM sums WHERE aa * bb - ab * ab > 1e-12 * aa * bb),
best AS (SELECT {group}, n_fit, wa AS w_a, wb AS w_b, 1 - wa - wb AS w_c FROM tries WHERE wa >= 0 AND wb >= 0 AND wa + wb <= 1
  QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY yy - 2 * wa * ay - 2 * wb * b_y + wa * wa * aa + wb * wb * bb + 2 * wa * wb * ab) = 1)"""


_POINTS = ("SELECT f.fold, v.lagged_forward_returns AS a, v.train_mean AS b, 0.0 AS c, v.forward_returns AS y "
           "FROM (SELECT DISTINCT fold FROM val) f JOIN val v ON v.fold <> f.fold "
           "WHERE v.lagged_forward_returns IS NOT NULL AND v.train_mean IS NOT NULL AND v.forward_returns IS NOT NULL")
_STACK_SQL = _STANDIN_SQL + "," + simplex_sql(_POINTS, "fold")


@query("stack1_nested_simplex_weights", with_panel(
    "SELECT CAST(fold AS INTEGER) AS fold, n_fit, round(w_a, 6) AS gbt_a, round(w_b, 6) AS gbt_b, round(w_c, 6) AS gbt_c FROM best", _STACK_SQL))
def q_stack_weights(spark, sf_dir):
    """Blend weights of every fold, fitted on the other folds' out-of-fold predictions (least squares on the simplex)."""
    _, weights = _stack_run(spark, sf_dir)
    return round_doubles(weights.select("fold", "n_fit", *[F.col("weights")[i].alias(m) for i, m in enumerate(MODELS)]))


@query("stack2_stacked_fold_metrics", with_panel("""
SELECT CAST(fold AS INTEGER) AS fold, count(*) AS n, round(sqrt(avg((y - s) * (y - s))), 8) AS rmse_stacked,
  round(sqrt(avg((y - f) * (y - f))), 8) AS rmse_fixed
FROM (SELECT val.fold, forward_returns AS y, w_a * lagged_forward_returns + w_b * train_mean AS s,
        0.4 * lagged_forward_returns + 0.3 * train_mean AS f
      FROM val JOIN best USING (fold) WHERE lagged_forward_returns IS NOT NULL AND forward_returns IS NOT NULL AND train_mean IS NOT NULL)
GROUP BY fold""", _STACK_SQL))
def q_stack_metrics(spark, sf_dir):
    """RMSE per fold of the stacked blend, whose weights never saw the fold, and of the fixed .4/.3/.3 blend."""
    wide, weights = _stack_run(spark, sf_dir)
    fixed = sum(F.col("preds")[i] * w for i, w in enumerate(evaluate.BLEND_WEIGHTS.values()))
    e = stack.stacked(wide, F.broadcast(weights)).where("forward_returns IS NOT NULL").withColumn("fixed", fixed)
    rmse = lambda c: F.round(F.sqrt(F.avg(F.pow(F.col("forward_returns") - F.col(c), 2))), 8)
    return e.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), rmse("stacked").alias("rmse_stacked"), rmse("fixed").alias("rmse_fixed"))


@query("stack3_weights_are_optimal", with_panel("""
SELECT CAST(fold AS INTEGER) AS fold, round(wa + wb + wc, 6) AS sum_weights, least(wa, wb, wc) >= 0 AS in_simplex, TRUE AS stationary
FROM (SELECT fold, w_a AS wa, w_b AS wb, w_c AS wc FROM best)""", _STACK_SQL))
def q_stack_optimal(spark, sf_dir):
    """The optimality conditions of the written weights, recomputed from the rows of the score table: no shift of
    weight from one model to another lowers the squared error on the other folds."""
    wide, weights = _stack_run(spark, sf_dir)
    w = weights.select(F.col("fold").alias("of"), "weights")
    rows = wide.where("forward_returns IS NOT NULL").withColumn("of", F.explode(F.sequence(F.lit(1), F.lit(N_SPLITS))))
    rows = rows.where("fold <> of").join(F.broadcast(w), "of")  # one row for each fold
    blend = F.aggregate(F.zip_with("preds", "weights", lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    slope = [F.sum(F.col("preds")[i] * (F.col("blend") - F.col("forward_returns"))).alias(f"g{i}") for i in range(len(MODELS))]
    g = rows.withColumn("blend", blend).groupBy("of").agg(F.first("weights").alias("weights"), *slope, F.sum(F.pow("forward_returns", F.lit(2))).alias("yy"))
    cost = F.array(*[F.col(f"g{i}") for i in range(len(MODELS))])
    level = F.aggregate(F.zip_with(cost, "weights", lambda a, x: a * x), F.lit(0.0), lambda a, x: a + x)
    return g.withColumn("cost", cost).withColumn("level", level).select(
        F.col("of").alias("fold"), F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("sum_weights"),
        F.forall("weights", lambda x: x >= 0).alias("in_simplex"),
        F.forall("cost", lambda x: x - F.col("level") >= -1e-9 * F.col("yy")).alias("stationary"))
