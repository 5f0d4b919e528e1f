"""Blending and evaluation (MOD9-MOD11, AGG10-AGG13).

Scores are kept in LONG form -- one row per (row id, model, fold) -- so any
number of models and folds is a groupBy, never a driver loop over arrays:

* MOD11 blend = sum(weight * prediction) grouped by (row id, fold), weights
  joined from a small model->weight table (bounded by the number of models);
* MOD10 test prediction = average of the fold models' blends per row id;
* AGG11/AGG12/AGG13 fold metrics = one grouped aggregation over the
  validation rows; AGG10 = their unweighted mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Blend weights of the three learners.
BLEND_WEIGHTS = {"gbt_a": 0.4, "gbt_b": 0.3, "gbt_c": 0.3}


def weights_frame(spark, weights: dict[str, float] = BLEND_WEIGHTS) -> DataFrame:
    if abs(sum(weights.values()) - 1.0) > 1e-12:
        raise ValueError("blend weights must sum to 1")
    return spark.createDataFrame(list(weights.items()), "model string, weight double")


def blend(scores: DataFrame, weights: DataFrame, id_cols: list[str], pred: str = "pred",
          out: str = "blend") -> DataFrame:
    """MOD11: weighted sum of model predictions per (ids). ``scores`` is long:
    ids + ``model`` + ``pred``.

    The blend is NULL unless every model of ``weights`` has exactly one row with
    a prediction for the ids; rows of other models do not count (see
    ``blend_report``)."""
    w = F.broadcast(weights)  # one row per model: bounded
    n_models = weights.count()
    # one row per (ids, model) first, so that duplicates are seen
    per = scores.groupBy(*id_cols, "model").agg(F.first(pred).alias("_p"), F.count(F.lit(1)).alias("_c"))
    j = per.join(w, on="model", how="left")
    known = F.col("weight").isNotNull()
    good = known & (F.col("_c") == 1) & F.col("_p").isNotNull()
    g = j.groupBy(*id_cols).agg(F.sum(F.when(good, F.col("weight") * F.col("_p"))).alias("_s"),
                                F.count_if(good).alias("_n"))
    return g.select(*id_cols, F.when(F.col("_n") == n_models, F.col("_s")).alias(out))


def blend_report(scores: DataFrame, weights: DataFrame, id_cols: list[str], pred: str = "pred") -> DataFrame:
    """Per model name: rows, rows without prediction, ids with more than one row, whether it has a weight."""
    per = scores.groupBy(*id_cols, "model").agg(F.count(F.lit(1)).alias("_c"), F.count(pred).alias("_p"))
    g = per.groupBy("model").agg(F.sum("_c").alias("n_rows"), (F.sum("_c") - F.sum("_p")).alias("n_null"),
                                 F.count_if(F.col("_c") > 1).alias("n_duplicate"))
    return g.join(F.broadcast(weights), "model", "full").select(
        "model", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_rows", "n_null", "n_duplicate")],
        F.col("weight").isNotNull().alias("known"))


def fold_average(scores: DataFrame, id_cols: list[str], pred: str = "blend", out: str = "prediction") -> DataFrame:
    """MOD10: mean over fold models per row (``+= pred / k``)."""
    return scores.groupBy(*id_cols).agg(F.avg(pred).alias(out))


def fold_metrics(df: DataFrame, y: str, pred: str, fold_col: str = "fold", with_excluded: bool = False) -> DataFrame:
    """AGG11 RMSE and AGG12 R^2 (about the slice's own mean) per fold (AGG13).

    Only rows that have both a target and a prediction count; a fold without
    any has NULL metrics. ``with_excluded`` adds how many rows were left out."""
    both = F.col(y).isNotNull() & F.col(pred).isNotNull()
    e = F.col(y) - F.col(pred)
    g = df.groupBy(fold_col).agg(F.count_if(both).alias("n"), F.sum(e * e).alias("sse"),
                                 F.var_pop(F.when(both, F.col(y))).alias("vy"), F.count_if(~both).alias("n_excluded"))
    sst = F.col("vy") * F.col("n")
    out = [F.col(fold_col).alias("fold"), F.when(F.col("n") > 0, F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"),
           F.when(F.col("n") == 0, F.lit(None)).when(sst > 0, 1 - F.col("sse") / sst)
            .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2")]
    return g.select(*out, *([F.col("n_excluded")] if with_excluded else []))


def mean_metrics(metrics: DataFrame) -> DataFrame:
    """AGG10: unweighted mean of the fold metrics."""
    return metrics.agg(F.avg("rmse").alias("mean_rmse"), F.avg("r2").alias("mean_r2"),
                       F.count(F.lit(1)).alias("n_folds"))
