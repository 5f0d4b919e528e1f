"""Blend-weight search and stacking: least squares over the simplex on the Gram matrix of out-of-fold predictions.

The weights ``w >= 0, sum(w) = 1`` that minimise the squared error of the blend need only the products of predictions
and target, so the scores are read once: one aggregation gives, for every (keys, fold), the Gram matrix of the
models, their products with the target, and the target's square. These tables have one row for each fold and series.

Stacking is nested: the weights that blend a fold come from the Gram matrices of other folds (all others, or only the
earlier ones), so no fold takes part in choosing its own weights. The quadratic programme is solved by an active set.

Defined cases: only rows with a target and exactly one prediction of each model count; a fold without any other rows to
learn from gets the fallback weights (equal, or those given); models whose predictions are equal share in any split, the
solver keeps the one named first; a NULL series key is a series.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def simplex_least_squares(gram: np.ndarray, cross: np.ndarray, tol: float = 1e-12) -> np.ndarray:
    """The w >= 0 with sum 1 that minimises w'Gw - 2 w'c, by a primal active set.

    Starts at the best single model; a model enters when its reduced cost is negative, and steps that would make a
    weight negative stop there and drop that model. Every solved step lowers the objective, so no set comes twice."""
    m = len(cross)
    scale = max(float(np.abs(np.diag(gram)).max(initial=0.0)), 1e-300)
    g, c = gram / scale, cross / scale
    w = np.zeros(m)
    w[int(np.argmin(np.diag(g) - 2 * c))] = 1.0
    free = w > 0
    for _ in range(50 * m):
        k = np.flatnonzero(free)
        # equality-constrained optimum on the free models
        lhs = np.zeros((len(k) + 1, len(k) + 1))
        lhs[:-1, :-1], lhs[:-1, -1], lhs[-1, :-1] = g[np.ix_(k, k)], 1.0, 1.0
        goal = np.linalg.lstsq(lhs, np.append(c[k], 1.0), rcond=None)[0][:-1]
        if (goal >= -tol).all():
            w[:] = 0.0
            w[k] = np.maximum(goal, 0.0)
            w /= w.sum()
            cost = g @ w - c
            cost -= cost @ w  # reduced costs: 0 on the free models, >= 0 elsewhere at the optimum
            worst = int(np.argmin(np.where(free, 0.0, cost)))
            if free[worst] or cost[worst] >= -tol:
                return w
            free[worst] = True
        else:
            step = goal - w[k]
            down = step < -tol
            ratio = np.where(down, -w[k] / np.where(down, step, -1.0), np.inf)
            at = int(np.argmin(ratio))
            w[k] += min(1.0, ratio[at]) * step
            w[k[at]] = 0.0
            free[k[at]] = False
    return w


def wide_scores(scores: DataFrame, models: list[str], id_cols: list[str], pred: str = "pred") -> DataFrame:
    """One row per ids with the array ``preds`` in the order of ``models``; ids that miss one, or have one twice, go."""
    per = [F.struct(F.count_if((F.col("model") == m) & F.col(pred).isNotNull()).alias("n"),
                    F.max(F.when(F.col("model") == m, F.col(pred).cast("double"))).alias("p")) for m in models]
    wide = scores.where(F.col("model").isin(models)).groupBy(*id_cols).agg(F.array(*per).alias("__m"), F.count(F.lit(1)).alias("__n"))
    full = (F.col("__n") == len(models)) & F.forall("__m", lambda x: x["n"] == 1)
    return wide.where(full).select(*id_cols, F.transform("__m", lambda x: x["p"]).alias("preds"))


def gram_table(wide: DataFrame, y: str, n_models: int, by: list[str]) -> DataFrame:
    """(by, n, gram, cross, yy) of rows with ``preds`` and a target: one aggregation with partial sums."""
    p = [F.col("preds")[i] for i in range(n_models)]
    t = F.col(y).cast("double")
    pairs = [F.sum(p[i] * p[j]) for i in range(n_models) for j in range(n_models)]
    return wide.where(t.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("gram"), F.array(*[F.sum(x * t) for x in p]).alias("cross"), F.sum(t * t).alias("yy"))


def nested_weights(grams: DataFrame, models: list[str], fold: str = "fold", keys: list[str] | None = None, past_only: bool = False,
                   fallback: list[float] | None = None) -> DataFrame:
    """(keys, fold, n_fit, weights): for every fold the weights fitted on the sums of the other (or only earlier) folds.

    ``grams`` is ``gram_table`` by keys and fold: one row for each, so the window over a series' folds is small."""
    keys = keys or []
    m = len(models)
    prior = Window.partitionBy(*keys).orderBy(fold).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(fold).rowsBetween(1, Window.unboundedFollowing)

    def others(x: Column) -> Column:
        before = F.coalesce(F.sum(x).over(prior), F.lit(0))
        return before if past_only else before + F.coalesce(F.sum(x).over(later), F.lit(0))

    fit = grams.select(*keys, fold, others(F.col("n")).cast("long").alias("n_fit"),
                       F.array(*[others(F.col("gram")[i]).cast("double") for i in range(m * m)]).alias("gram"),
                       F.array(*[others(F.col("cross")[i]).cast("double") for i in range(m)]).alias("cross"))
    equal = fallback or [1.0 / m] * m

    def solve(batches):
        for batch in batches:
            n, g, c = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("n_fit", "gram", "cross"))
            w = [simplex_least_squares(np.array(a).reshape(m, m), np.array(b)).tolist() if k else equal for k, a, b in zip(n, g, c)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(w, pa.list_(pa.float64()))],
                                             names=[*batch.schema.names[:-2], "weights"])

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fit.schema.fields[:-2])
    return fit.mapInArrow(solve, f"{named}, weights array<double>")


def stacked(wide: DataFrame, weights: DataFrame, fold: str = "fold", keys: list[str] | None = None, out: str = "stacked") -> DataFrame:
    """The blend of every row with the weights of its own fold (NULL-safe on the keys)."""
    on = [*(keys or []), fold]
    w = weights.select(*[F.col(c).alias(f"__{c}") for c in on], F.col("weights").alias("__w"))
    cond = [wide[c].eqNullSafe(w[f"__{c}"]) for c in on]
    blend = F.aggregate(F.zip_with("preds", "__w", lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return wide.join(w, cond, "left").withColumn(out, blend).drop("__w", *[f"__{c}" for c in on])
