"""Boosted-tree learners on MLlib GBT (MOD6-MOD9) and their metric history (SRC7).

Three configurations stand in for the reference's three libraries. MLlib
trees are depth-wise with no L1/L2 leaf penalty, so values differ from those
libraries; the shape of the result (per-fold fits, out-of-fold scores, test
scores per fold model) is the same.

Early stopping with patience (no MLlib built-in): tree m of a fit depends only on
the data, the seed and the trees before it, so a shorter fit is a prefix of a
longer one. An ensemble is therefore grown in steps (FIRST_STEP rounds, then twice
as many, at most ``max_rounds``) until the validation losses of its prefixes
(``evaluateEachIteration``, one distributed pass) fire the patience of WIN7; the
fitted list of trees is then cut at the best iteration, or at the last one for a
configuration that uses every round. Nothing is refitted.

The target is scaled to unit variance before fitting: MLlib's stopping and
split thresholds are absolute, and daily returns have a std near 0.01.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.plans.materialize import materialize


@dataclass(frozen=True)
class TreeConfig:
    name: str
    max_depth: int
    step_size: float = 0.05
    subsampling_rate: float = 1.0
    feature_subset: str = "all"
    min_instances: int = 1
    seed: int = 42
    predict_at_best: bool = True   # False: use every fitted round


# The three learner configurations A (leaf-wise, 31 leaves ~ depth 5),
# B (depth 6, histogram, every fitted round used) and C (depth 6, seed 42).
LEARNERS = (
    TreeConfig("gbt_a", max_depth=5, subsampling_rate=0.8, feature_subset="0.8", min_instances=20),
    TreeConfig("gbt_b", max_depth=6, subsampling_rate=0.8, feature_subset="0.8", min_instances=3,
               predict_at_best=False),
    TreeConfig("gbt_c", max_depth=6, feature_subset="all", seed=42),
)
MAX_ROUNDS = 1000
PATIENCE = 50
# Rounds of the first growing step; the patience needs more than PATIENCE of them.
FIRST_STEP = 64


def _gbt(cfg: TreeConfig, rounds: int) -> GBTRegressor:
    return GBTRegressor(featuresCol="features", labelCol="_y", predictionCol="_p", maxIter=rounds,
                        maxDepth=cfg.max_depth, stepSize=cfg.step_size, subsamplingRate=cfg.subsampling_rate,
                        featureSubsetStrategy=cfg.feature_subset, minInstancesPerNode=cfg.min_instances,
                        seed=cfg.seed, lossType="squared", maxBins=32)


def stop_at(rmse: list[float], patience: int) -> tuple[int, int]:
    """WIN7 on one metric history: (best iteration, last iteration run)."""
    best, best_i = math.inf, 0
    for i, v in enumerate(rmse):
        if v < best:
            best, best_i = v, i
        if i - best_i >= patience:
            return best_i, i
    return best_i, len(rmse) - 1


def first_trees(model: GBTRegressionModel, n: int) -> GBTRegressionModel:
    """The ensemble of the first ``n`` fitted trees."""
    java = model._java_obj
    jvm, gateway = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for k in range(n):
        trees[k], weights[k] = java.trees()[k], java.treeWeights()[k]
    cut = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights)
    return GBTRegressionModel(java.copyValues(cut, java.extractParamMap()))


def grow(train: DataFrame, valid: DataFrame, cfg: TreeConfig, max_rounds: int, patience: int):
    """Fit in growing steps until the patience fires: (model, validation losses, best, last)."""
    rounds = min(max(FIRST_STEP, patience + 1), max_rounds)
    while True:
        model = _gbt(cfg, rounds).fit(train)
        losses = list(model.evaluateEachIteration(valid, "squared"))
        best, last = stop_at(losses, patience)
        if last < rounds - 1 or last - best >= patience or rounds >= max_rounds:
            return model, losses, best, last
        rounds = min(2 * rounds, max_rounds)


def fit_fold(train: DataFrame, valid: DataFrame, test: DataFrame | None, target: str, id_col: str,
             cfg: TreeConfig, fold: int, max_rounds: int = MAX_ROUNDS,
             patience: int = PATIENCE):
    """MOD6/7/8 + MOD9 for one fold: returns (scores, history rows).

    scores: long rows (id, model, fold, split, pred) for validation and test.
    history: (model, fold, iteration, split, rmse) -- the SRC7 table. ``train`` and
    ``valid`` hold a ``features`` vector column of the model inputs.
    """
    st = train.agg(F.avg(target).alias("m"), F.stddev_pop(target).alias("s")).first()
    mu, sd = st["m"] or 0.0, (st["s"] or 1.0) or 1.0
    scaled = lambda d: d.withColumn("_y", (F.col(target) - F.lit(mu)) / F.lit(sd))
    tr, vl = scaled(train), scaled(valid)
    model, losses, best_i, last_i = grow(tr, vl, cfg, max_rounds, patience)
    hist_v = [math.sqrt(x) * sd for x in losses]
    hist_t = [math.sqrt(x) * sd for x in model.evaluateEachIteration(tr, "squared")]
    model = first_trees(model, best_i + 1 if cfg.predict_at_best else last_i + 1)
    unscale = F.col("_p") * F.lit(sd) + F.lit(mu)
    parts = [model.transform(vl).select(F.col(id_col), F.lit("valid").alias("split"), unscale.alias("pred"))]
    if test is not None:
        parts.append(model.transform(test).select(F.col(id_col), F.lit("test").alias("split"),
                                                               unscale.alias("pred")))
    scores = parts[0]
    for p in parts[1:]:
        scores = scores.unionByName(p)
    scores = scores.select(id_col, F.lit(cfg.name).alias("model"), F.lit(fold).alias("fold"), "split", "pred")
    hist = [(cfg.name, fold, i, "valid", v) for i, v in enumerate(hist_v[: last_i + 1])] + \
           [(cfg.name, fold, i, "learn", v) for i, v in enumerate(hist_t[: last_i + 1])]
    return scores, hist


def fit_ensemble(df: DataFrame, test: DataFrame | None, features: list[str], target: str, id_col: str,
                 fold_col: str = "fold", n_folds: int = 5, learners=LEARNERS, max_rounds: int = MAX_ROUNDS,
                 patience: int = PATIENCE, parallel: int = 8):
    """MOD9: per fold j, fit every learner on rows with fold < j and score the
    rows with fold == j (and the test rows). Fits of one fold run concurrently
    from a small driver thread pool (each fit is itself a distributed job).

    Returns (long score DataFrame, history DataFrame).
    """
    # the vectors are written once; every fit reads its own rows of them
    va = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    keep = [id_col, target, fold_col, "features"]
    rows = materialize(va.transform(df).select(*keep), "tree-rows")
    if test is not None:
        test = materialize(va.transform(test).select(id_col, "features"), "tree-test")
    jobs = []
    for j in range(1, n_folds + 1):
        tr = rows.where(F.col(fold_col) < j)
        vl = rows.where(F.col(fold_col) == j)
        for cfg in learners:
            jobs.append((tr, vl, cfg, j))
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
        res = list(ex.map(lambda a: fit_fold(a[0], a[1], test, target, id_col, a[2], a[3],
                                             max_rounds, patience), jobs))
    scores = res[0][0]
    for s, _ in res[1:]:
        scores = scores.unionByName(s)
    spark = df.sparkSession
    hist = spark.createDataFrame([h for _, hs in res for h in hs],
                                 "model string, fold int, iteration int, split string, rmse double")
    return scores, hist
