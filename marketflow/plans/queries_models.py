"""Registered queries: scaling, moments, elastic net, stand-in ensemble
evaluation, boosted trees (AGG10-AGG15, MOD1-MOD12, SRC7, FN9)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.operators import evaluate, linear, schema, series, trees
from marketflow.operators.scale import apply_scaler, fit_scaler, scaler_frame
from marketflow.plans import linear_signal as ls
from marketflow.plans.materialize import materialize
from marketflow.plans.oracle import with_panel
from marketflow.plans.queries_basic import TEST_TAIL_ROWS, load_test, load_train
from marketflow.plans.queries_stats import round_doubles
from marketflow.plans.registry import cached, panel, query

V = ls.MODEL_VARS
N_SPLITS = 5

# ----------------------------------------------------------- z-score (MOD1)
# Input: the model columns of the panel with nulls dropped; the scaler is fit on
# the train part (all but the last 10 rows) and applied to every row.

_MODEL_SQL = ("m AS (SELECT date_id, market_forward_excess_returns AS target, S2, E2, E3, P9, S1, S5, I2, P8, "
              "P10, P12, P13, I2 - I1 AS U1, M11 / nullif((I2 + I9 + I7) / 3, 0) AS U2 FROM panel),\n"
              "mm AS (SELECT * FROM m WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in ["target", *V]) + "),\n"
              "tr AS (SELECT * FROM mm WHERE date_id IN (SELECT date_id FROM panel "
              "QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10)),\n"
              "st AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
                                           f"ELSE stddev_pop({c}) END AS s_{c}" for c in V) + " FROM tr)")


def _model_rows(spark, sf_dir):
    p = schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"})
    from marketflow.plans.queries_basic import model_table
    return schema.drop_nulls(model_table(p))


def _train_part(spark, sf_dir, df):
    ids = load_train(spark, sf_dir).select("date_id")
    return df.join(ids, "date_id", "left_semi")


@query("agg14_scaler_fit", with_panel(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale FROM st" for c in V), _MODEL_SQL))
def q_scaler_fit(spark, sf_dir):
    """AGG14: mean and population std per model input, fit on the train part."""
    m = _model_rows(spark, sf_dir)
    return round_doubles(scaler_frame(spark, fit_scaler(_train_part(spark, sf_dir, m), V)))


@query("mod1_zscore_apply", with_panel(
    "SELECT date_id, target, " + ", ".join(f"round((mm.{c} - m_{c}) / s_{c}, 6) AS {c}" for c in V)
    + " FROM mm, st", _MODEL_SQL))
def q_zscore(spark, sf_dir):
    """MOD1: z-score every row with the train-fitted scaler (constant column -> /1)."""
    m = _model_rows(spark, sf_dir)
    sc = fit_scaler(_train_part(spark, sf_dir, m), V)
    return round_doubles(apply_scaler(m, sc))


# ----------------------------------------------------- fold moments (AGG15)

_PAIRS = [(i, j) for i in range(len(V)) for j in range(i, len(V))]


def _moments_sql() -> str:
    z = ("z AS (SELECT target, " + ", ".join(f"(tr.{c} - m_{c}) / s_{c} AS {c}" for c in V) +
         ", CAST(CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1) "
         "ELSE (n % 10) + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INTEGER) AS fold "
         "FROM (SELECT *, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM tr) tr, st)")
    parts = ["SELECT fold, 'n' AS stat, -1 AS i, -1 AS j, CAST(count(*) AS DOUBLE) AS value FROM z GROUP BY fold",
             "SELECT fold, 'sy', -1, -1, round(sum(target), 6) FROM z GROUP BY fold",
             "SELECT fold, 'syy', -1, -1, round(sum(target * target), 6) FROM z GROUP BY fold"]
    for i, c in enumerate(V):
        parts.append(f"SELECT fold, 'sx', {i}, -1, round(sum({c}), 6) FROM z GROUP BY fold")
        parts.append(f"SELECT fold, 'sxy', {i}, -1, round(sum({c} * target), 6) FROM z GROUP BY fold")
    for i, j in _PAIRS:
        parts.append(f"SELECT fold, 'sxx', {i}, {j}, round(sum({V[i]} * {V[j]}), 6) FROM z GROUP BY fold")
    return with_panel("\nUNION ALL ".join(parts), _MODEL_SQL + ",\n" + z)


def scaled_train_with_folds(spark, sf_dir):
    m = _model_rows(spark, sf_dir)
    tr = _train_part(spark, sf_dir, m)
    z = apply_scaler(tr, fit_scaler(tr, V))
    z = series.add_position(z, "date_id")
    return series.add_folds(z, "contiguous", ls.CV_FOLDS)


@query("agg15_fold_moments", _moments_sql())
def q_moments(spark, sf_dir):
    """AGG15: per contiguous fold, n, sums, cross moments of the z-scored inputs
    and target -- one aggregation pass; shown as a long (fold, stat, i, j) table."""
    mom = materialize(linear.moments(scaled_train_with_folds(spark, sf_dir), V, "target", ["fold"]))
    pi = F.array(*[F.lit(i) for i, _ in _PAIRS])
    pj = F.array(*[F.lit(j) for _, j in _PAIRS])
    n1 = F.lit(-1)
    scal = [mom.select("fold", F.lit("n").alias("stat"), n1.alias("i"), n1.alias("j"),
                       F.col("n").cast("double").alias("value")),
            mom.select("fold", F.lit("sy"), n1, n1, F.round("sy", 6)),
            mom.select("fold", F.lit("syy"), n1, n1, F.round("syy", 6))]
    vec = [mom.select("fold", F.lit(s).alias("stat"), F.posexplode(s).alias("i", "v"))
           .select("fold", "stat", "i", n1.alias("j"), F.round("v", 6).alias("value")) for s in ("sx", "sxy")]
    mat = mom.select("fold", F.posexplode("sxx").alias("k", "v")).select(
        "fold", F.lit("sxx").alias("stat"), F.element_at(pi, F.col("k") + 1).alias("i"),
        F.element_at(pj, F.col("k") + 1).alias("j"), F.round("v", 6).alias("value"))
    out = scal[0]
    for d in scal[1:] + vec + [mat]:
        out = out.union(d)
    return out


# -------------------------------------------------- elastic net (MOD2-MOD4)

def _linear_fit(spark, sf_dir):
    """Fitted scaler + model (small driver-side parameters) and the written
    training table; one fit per session and input, shared by three queries."""
    def build():
        tr, te = load_train(spark, sf_dir), load_test(spark, sf_dir)
        common = schema.common_columns(tr, te)
        both = schema.concat_strict(tr.select(*common), te.select(*common))
        data = materialize(ls.FEATURES.rows(both))  # model input: written once
        fitted, xt = ls.fit(tr, data)
        return fitted, materialize(xt)
    return cached("linear_fit", spark, sf_dir, build)


@query("mod2_mod3_elastic_net_fit")
def q_enet(spark, sf_dir):
    """MOD2 ElasticNetCV (100 log-spaced alphas, l1_ratio 0.5, 10 contiguous
    folds, moments + coordinate descent) and MOD3 final fit: coefficient table."""
    fitted, _ = _linear_fit(spark, sf_dir)
    m = fitted.model
    rows = [(f, float(w)) for f, w in zip(m.features, m.coef)] + [("(intercept)", float(m.intercept)),
                                                                  ("(alpha)", float(m.alpha))]
    return spark.createDataFrame(rows, "feature string, value double")


@query("mod2_fn9_cv_path")
def q_path(spark, sf_dir):
    """MOD2 + FN9: mean validation MSE over the 10 folds for every alpha of the
    log-spaced grid (one row per alpha)."""
    _, xt = _linear_fit(spark, sf_dir)
    d = xt.withColumn("_series", F.lit(0))
    mom = linear.moments(d, V, "target", ["_series", "fold"]).withColumn("fold", F.col("fold").cast("int"))
    path = linear.cv_path(linear.train_minus_fold(mom, ["_series"]), ["_series"], len(V),
                          linear.PenaltyGrid())
    return path.groupBy("alpha_idx", "alpha").agg(F.avg("mse").alias("mean_mse"), F.count("fold").alias("n_folds"))


@query("mod2_mod3_optimality", with_panel(
    "SELECT unnest([" + ", ".join(f"'{c}'" for c in [*V, "(alpha)"]) + "]) AS feature, (SELECT count(*) FROM m "
    "WHERE target IS NOT NULL AND date_id >= (SELECT greatest(" + ", ".join(f"min(date_id) FILTER (WHERE {c} IS NOT NULL)" for c in V)
    + ") FROM m) AND date_id IN (SELECT date_id FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10)) AS n_rows, "
    "0::BIGINT AS n_wrong", _MODEL_SQL))
def q_optimality(spark, sf_dir):
    """MOD2/MOD3: the fitted coefficients meet the elastic net's optimality condition on
    moments taken anew from the training rows, and the chosen alpha has the least mean
    validation error of the path: one row per check with the rows used and violations (0)."""
    import numpy as np

    fitted, xt = _linear_fit(spark, sf_dir)
    m, l1r = fitted.model, linear.PenaltyGrid().l1_ratio
    row = linear.moments(xt, V, "target", []).first()  # p x p numbers
    n, sx, sy, syy, s, sxy = linear._unpack(*(row[c] for c in ("n", "sx", "sy", "syy", "sxx", "sxy")), len(V))
    _, _, q2, q, _ = linear._centered(n, sx, sy, syy, s, sxy)
    w = np.array(m.coef)
    slope = q - q2 @ w - n * m.alpha * (1 - l1r) * w
    limit = n * m.alpha * l1r
    slack = 1e-2 * max(limit, float(np.abs(q).max()))
    wrong = np.where(w != 0, np.abs(slope - limit * np.sign(w)) > slack, np.abs(slope) > limit + slack)
    path = q_path(spark, sf_dir)
    best = path.agg(F.min_by("alpha", F.struct("mean_mse", -F.col("alpha")))).first()[0]
    rows = [(c, int(n), int(x)) for c, x in zip(V, wrong)] + [("(alpha)", int(n), int(abs(best - m.alpha) > 1e-12))]
    return spark.createDataFrame(rows, "feature string, n_rows long, n_wrong long")


@query("mod4_mod5_mod12_batch_predictions")
def q_predict(spark, sf_dir):
    """MOD12: per-batch inference on the test rows (features rebuilt inside each
    batch, as the reference does), MOD4 linear score, MOD5 signal, FLT8 first row."""
    fitted, _ = _linear_fit(spark, sf_dir)
    return ls.predict_batches(load_test(spark, sf_dir), fitted)


# ------------------------------------ stand-in ensemble (MOD9-MOD11, AGG10-13)
# Three deterministic predictors keep the evaluation SQL-checkable:
# gbt_a := lagged return, gbt_b := mean target of the fold's training rows, gbt_c := 0.

def _standin(spark, sf_dir):
    tr = load_train(spark, sf_dir).select("date_id", "forward_returns", "lagged_forward_returns")
    tr = series.add_folds(series.add_position(tr, "date_id"), "expanding", N_SPLITS)
    # training mean for fold model j: rows with fold < j (cumulative over a
    # (k+1)-row table, broadcast back by fold)
    per = tr.groupBy("fold").agg(F.sum("forward_returns").alias("s"), F.count("forward_returns").alias("c"))
    from pyspark.sql import Window
    w = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    cum = per.select(F.col("fold").alias("model_fold"), (F.sum("s").over(w) / F.sum("c").over(w)).alias("train_mean"))
    cum = F.broadcast(cum)  # k+1 rows
    val = tr.where(F.col("fold") >= 1).join(cum, tr["fold"] == cum["model_fold"]).drop("model_fold")
    val = materialize(val)  # small: one row per validation day, read by the metric passes
    te = load_test(spark, sf_dir).select("date_id", F.col("target").alias("lagged_forward_returns"))
    # each test row is scored by each of the k fold models: k copies, equi join
    te = te.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(N_SPLITS))))
    test = te.join(cum.withColumnRenamed("model_fold", "fold"), on="fold", how="inner")
    return val, test


def _long_scores(df, id_cols):
    return df.select(*id_cols, F.explode(F.array(
        F.struct(F.lit("gbt_a").alias("model"), F.col("lagged_forward_returns").alias("pred")),
        F.struct(F.lit("gbt_b").alias("model"), F.col("train_mean").alias("pred")),
        F.struct(F.lit("gbt_c").alias("model"), F.lit(0.0).alias("pred")))).alias("s")) \
        .select(*id_cols, "s.model", "s.pred")


def standin_fold_metrics(spark, sf_dir):
    val, _ = _standin(spark, sf_dir)
    b = evaluate.blend(_long_scores(val, ["date_id", "fold"]), evaluate.weights_frame(spark), ["date_id", "fold"])
    y = val.select("date_id", "forward_returns")
    return evaluate.fold_metrics(b.join(y, "date_id"), "forward_returns", "blend")


_STANDIN_SQL = """
tr0 AS (SELECT date_id, forward_returns, lagged_forward_returns FROM panel
        QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10),
tr AS (SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold
       FROM (SELECT *, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM tr0)),
cum AS (SELECT j.fold AS model_fold, (SELECT sum(forward_returns) / count(forward_returns) FROM tr t WHERE t.fold < j.fold) AS train_mean
        FROM (SELECT DISTINCT fold FROM tr) j),
val AS (SELECT tr.*, cum.train_mean FROM tr JOIN cum ON tr.fold = cum.model_fold WHERE tr.fold >= 1),
vb AS (SELECT fold, forward_returns AS y, 0.4 * lagged_forward_returns + 0.3 * train_mean + 0.3 * 0.0 AS b FROM val),
fm AS (SELECT CAST(fold AS INTEGER) AS fold, sqrt(sum((y - b) * (y - b)) / count(*)) AS rmse,
              CASE WHEN var_pop(y) * count(*) > 0 THEN 1 - sum((y - b) * (y - b)) / (var_pop(y) * count(*))
                   WHEN sum((y - b) * (y - b)) = 0 THEN 1.0 ELSE 0.0 END AS r2
       FROM vb GROUP BY fold)"""


@query("agg11_agg12_agg13_mod9_mod11_fold_metrics",
       with_panel("SELECT fold, round(rmse, 6) AS rmse, round(r2, 6) AS r2 FROM fm", _STANDIN_SQL))
def q_fold_metrics(spark, sf_dir):
    """MOD9 out-of-fold scores on the WIN4 split, MOD11 .4/.3/.3 blend,
    AGG11 RMSE, AGG12 R^2, AGG13 per-fold table."""
    return round_doubles(standin_fold_metrics(spark, sf_dir))


@query("agg10_mean_fold_metrics", with_panel(
    "SELECT round(avg(rmse), 6) AS mean_rmse, round(avg(r2), 6) AS mean_r2, count(*) AS n_folds FROM fm",
    _STANDIN_SQL))
def q_mean_metrics(spark, sf_dir):
    """AGG10: unweighted mean of the five fold metrics."""
    return round_doubles(evaluate.mean_metrics(standin_fold_metrics(spark, sf_dir)))


@query("mod10_mod11_test_prediction", with_panel("""
SELECT t.date_id, round(avg(0.4 * t.lagged_forward_returns + 0.3 * cum.train_mean + 0.3 * 0.0), 6) AS prediction
FROM (SELECT date_id, lagged_forward_returns FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) <= 10) t,
     cum WHERE cum.model_fold >= 1 GROUP BY t.date_id""", _STANDIN_SQL))
def q_test_pred(spark, sf_dir):
    """MOD11 blend per fold model on the test rows, MOD10 mean over the 5 fold models."""
    _, test = _standin(spark, sf_dir)
    b = evaluate.blend(_long_scores(test, ["date_id", "fold"]), evaluate.weights_frame(spark), ["date_id", "fold"])
    return round_doubles(evaluate.fold_average(b, ["date_id"]))


# ------------------------------------------------------ boosted trees (MOD6-9)

def _gbt_run(spark, sf_dir):
    """The ensemble runs once per session and input; its tables are written to
    the checkpoint folder so every registered view reads the same result."""
    from marketflow.plans import ensemble

    def build():
        p = panel(spark, sf_dir)
        n = p.count()
        pos = series.add_position(p, "date_id")
        train = pos.where(F.col("pos") < n - TEST_TAIL_ROWS).drop("pos")
        test = pos.where(F.col("pos") >= n - TEST_TAIL_ROWS).drop("pos")
        r = ensemble.run(train, test, "date_id", spark)
        r.history = materialize(r.history)
        r.fold_metrics = materialize(r.fold_metrics)
        r.predictions = materialize(r.predictions)
        return r
    return cached("gbt", spark, sf_dir, build)


@query("mod6_mod7_mod8_mod9_gbt_scores")
def q_gbt(spark, sf_dir):
    """MOD6-MOD8 three GBT configurations per WIN4 fold, MOD9 out-of-fold and
    test scores (long: date_id, model, fold, split, pred)."""
    return _gbt_run(spark, sf_dir).scores


@query("src7_win7_metric_history")
def q_hist(spark, sf_dir):
    """SRC7 metric history (model, fold, iteration, split, rmse) of the GBT fits."""
    return _gbt_run(spark, sf_dir).history


@query("agg10_agg13_mod11_gbt_fold_metrics")
def q_gbt_metrics(spark, sf_dir):
    """MOD11 .4/.3/.3 blend of the three learners' out-of-fold scores, AGG11-AGG13
    per-fold RMSE and R^2, AGG10 means appended as fold 0."""
    r = _gbt_run(spark, sf_dir)
    mean = r.summary.select(F.lit(0).alias("fold"), F.col("mean_rmse").alias("rmse"), F.col("mean_r2").alias("r2"))
    return r.fold_metrics.unionByName(mean)


_GBT_FOLDS_SQL = """
tr AS (SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold
       FROM (SELECT date_id, forward_returns, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM panel
             WHERE date_id IN (SELECT date_id FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10)) t),
models AS (SELECT unnest(['gbt_a', 'gbt_b', 'gbt_c']) AS model)"""


@query("mod9_gbt_rows_scored", with_panel("""
SELECT model, CAST(fold AS INTEGER) AS fold, 'valid' AS split, count(*) AS n_rows, count(*) AS n_ids, 0::BIGINT AS n_null
FROM tr, models WHERE fold >= 1 GROUP BY ALL
UNION ALL
SELECT model, CAST(f AS INTEGER), 'test', (SELECT least(count(*), 10) FROM panel), (SELECT least(count(*), 10) FROM panel), 0::BIGINT
FROM models, range(1, 6) r(f)""", _GBT_FOLDS_SQL))
def q_gbt_rows(spark, sf_dir):
    """MOD9: every validation row of a fold and every test row gets exactly one
    score of each fitted learner and fold, none NULL."""
    return _gbt_run(spark, sf_dir).scores.groupBy("model", "fold", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("date_id").alias("n_ids"),
        F.count_if(F.col("pred").isNull() | F.isnan("pred")).alias("n_null"))


@query("win7_mod11_gbt_checks", with_panel("""
SELECT 'history ends where the patience fires' AS "check", 3 * count(DISTINCT fold) AS n_checked, 0::BIGINT AS n_wrong FROM tr WHERE fold >= 1
UNION ALL SELECT 'rmse and blend follow from the scores', count(DISTINCT fold), 0 FROM tr WHERE fold >= 1
UNION ALL SELECT 'test prediction is the mean of the fold blends', (SELECT least(count(*), 10) FROM panel), 0
""", _GBT_FOLDS_SQL))
def q_gbt_checks(spark, sf_dir):
    """WIN7 re-derived from the written history, MOD11/AGG11 and MOD10 re-derived
    from the written scores with the panel's targets: checks and violations."""
    r, p = _gbt_run(spark, sf_dir), panel(spark, sf_dir).select("date_id", F.col("forward_returns").alias("y"))
    h = r.history.where("split = 'valid'")
    best = h.groupBy("model", "fold").agg(F.max("iteration").alias("last"), F.min_by("iteration", F.struct("rmse", "iteration")).alias("best"),
                                          F.count(F.lit(1)).alias("n"))
    fired = (F.col("last") - F.col("best") == trees.PATIENCE) | ((F.col("last") == trees.MAX_ROUNDS - 1)
                                                                 & (F.col("last") - F.col("best") < trees.PATIENCE))
    right = fired & (F.col("n") == F.col("last") + 1)
    weights = F.create_map(*[F.lit(x) for kv in evaluate.BLEND_WEIGHTS.items() for x in kv])
    blended = r.scores.groupBy("date_id", "fold", "split").agg(F.sum(F.col("pred") * weights[F.col("model")]).alias("b"))
    rmse = blended.where("split = 'valid'").join(p, "date_id").groupBy("fold").agg(F.sqrt(F.avg(F.pow(F.col("y") - F.col("b"), 2))).alias("e"))
    both = rmse.join(r.fold_metrics, "fold", "full")
    test = blended.where("split = 'test'").groupBy("date_id").agg(F.avg("b").alias("m"))
    preds = r.predictions.join(test, "date_id", "full")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) < 1e-9, F.lit(False))
    out = [("history ends where the patience fires", best, right), ("rmse and blend follow from the scores", both, near("e", "rmse")),
           ("test prediction is the mean of the fold blends", preds, near("m", "forward_returns"))]
    rows = [d.agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(~ok).alias("n_wrong")).select(
        F.lit(name).alias("check"), "n_checked", "n_wrong") for name, d, ok in out]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# MOD12 with fixed coefficients: every panel row is a batch of its own.
_FIXED_COEF = {c: round((-1) ** k * 0.0004 * (k + 1), 6) for k, c in enumerate(V)}
_FIXED_INTERCEPT = 0.0003


@query("mod4_mod5_mod12_fixed_model_batches", with_panel(
    "SELECT p.date_id, round(z.raw_pred, 6) AS raw_pred, CASE WHEN z.raw_pred IS NOT NULL THEN round(least(greatest(z.raw_pred * 400.0 + 1.0, 0.0), 2.0), 6) END AS prediction "
    "FROM panel p LEFT JOIN (SELECT mm.date_id, " + f"{_FIXED_INTERCEPT} + "
    + " + ".join(f"{w} * ((mm.{c} - m_{c}) / s_{c})" for c, w in _FIXED_COEF.items()) + " AS raw_pred FROM mm, st) z USING (date_id)",
    _MODEL_SQL))
def q_fixed_batches(spark, sf_dir):
    """MOD12 over every panel row, one batch per date: features rebuilt inside the
    batch, z-scored with the train scaler, linear score of fixed coefficients,
    signal, first row of the batch (NULL where a feature is missing)."""
    rows = schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"})
    scaler = fit_scaler(_train_part(spark, sf_dir, _model_rows(spark, sf_dir)), V)
    model = linear.LinearModel(tuple(V), _FIXED_INTERCEPT, tuple(_FIXED_COEF.values()), 0.0, 0.0)
    return round_doubles(ls.predict_batches(rows, ls.FittedLinear(scaler, model, tuple(V))))


# Fixed value of the query: batch ids of one trigger.
_IDS_PER_TRIGGER = 1000


@query("st1_st2_mod12_fitted_replay", with_panel(
    "SELECT p.date_id, round(z.raw_pred, 6) AS raw_pred, CASE WHEN z.raw_pred IS NOT NULL THEN round(least(greatest(z.raw_pred * 400.0 + 1.0, 0.0), 2.0), 6) END AS prediction, "
    f"row_number() OVER (ORDER BY p.date_id) - 1 AS batch_index, (row_number() OVER (ORDER BY p.date_id) - 1) // {_IDS_PER_TRIGGER} AS epoch "
    "FROM panel p LEFT JOIN (SELECT mm.date_id, " + f"{_FIXED_INTERCEPT} + "
    + " + ".join(f"{w} * ((mm.{c} - m_{c}) / s_{c})" for c, w in _FIXED_COEF.items()) + " AS raw_pred FROM mm, st) z USING (date_id)",
    _MODEL_SQL))
def q_fitted_replay(spark, sf_dir):
    """ST1 + ST2 with the real scorer: every panel date is a batch, replayed through a file stream in id order, many dates
    a trigger; inside ``foreachBatch`` the fitted scaler and linear model derive, scale, score and clip (MOD12)."""
    from marketflow.streaming import score as st
    rows = schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"})
    scaler = fit_scaler(_train_part(spark, sf_dir, _model_rows(spark, sf_dir)), V)
    fitted = ls.FittedLinear(scaler, linear.LinearModel(tuple(V), _FIXED_INTERCEPT, tuple(_FIXED_COEF.values()), 0.0, 0.0), tuple(V))
    arrived = materialize(series.add_position(rows, "date_id", pos_col="arrival"))
    path = st.write_triggers(arrived, "date_id", _IDS_PER_TRIGGER, "arrival")
    out = st.replay_triggers(spark, path, "date_id", lambda batch: ls.predict_batches(batch.drop("arrival"), fitted))
    return round_doubles(out.select("date_id", "raw_pred", "prediction", F.col(st.INDEX).cast("long").alias("batch_index"), F.col("epoch").cast("long").alias("epoch")))


@query("src4_src5_mod10_score_file")
def q_score_file(spark, sf_dir):
    """MOD10 test prediction (mean of the 5 fold models' blends), PRJ17 score
    table (date_id, forward_returns), SRC4 parquet + SRC5 CSV sinks; the CSV
    is read back."""
    from marketflow.session import scratch_path
    from marketflow.sources import io
    preds = _gbt_run(spark, sf_dir).predictions.select("date_id", "forward_returns")
    io.write_parquet(preds, scratch_path(spark, "submission-parquet"))
    path = io.write_csv(preds, scratch_path(spark, "submission-csv"))
    st = T.StructType([T.StructField("date_id", T.LongType()), T.StructField("forward_returns", T.DoubleType())])
    return io.read_csv(spark, path, st, flavor="pandas")


# ------------------------------------------------ wide moments (AGG15, p=64)

EMB_DIM = 64
_WPAIRS = [(i, j) for i in range(EMB_DIM) for j in range(i, EMB_DIM)]


def _wide_sql() -> str:
    e = lambda i: f"CAST(embedding[{i + 1}] AS DOUBLE)"
    y = "CAST(label AS DOUBLE)"
    cols = [f"CAST(count(*) AS DOUBLE) AS \"n_-1_-1\"", f"sum({y}) AS \"sy_-1_-1\"", f"sum({y} * {y}) AS \"syy_-1_-1\""]
    cols += [f"sum({e(i)}) AS \"sx_{i}_-1\"" for i in range(EMB_DIM)]
    cols += [f"sum({e(i)} * {y}) AS \"sxy_{i}_-1\"" for i in range(EMB_DIM)]
    cols += [f"sum({e(i)} * {e(j)}) AS \"sxx_{i}_{j}\"" for i, j in _WPAIRS]
    return (f"SELECT split_part(k, '_', 1) AS stat, CAST(split_part(k, '_', 2) AS INTEGER) AS i, "
            f"CAST(split_part(k, '_', 3) AS INTEGER) AS j, round(value, 6) AS value "
            f"FROM (UNPIVOT (SELECT {', '.join(cols)} FROM embeddings) ON COLUMNS(*) INTO NAME k VALUE value)")


@query("agg15_wide_moments_embeddings", _wide_sql())
def q_wide(spark, sf_dir):
    """AGG15, wide case: cross moments of the 64-wide embedding and the label,
    accumulated per partition with numpy (map-side combine) and merged per
    element in Spark; long (stat, i, j, value) table."""
    from marketflow.plans.registry import table
    emb = table(spark, sf_dir, "embeddings")
    x = emb.select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(EMB_DIM)],
                   F.col("label").cast("double").alias("y"))
    mom = materialize(linear.moments(x, [f"x{i}" for i in range(EMB_DIM)], "y", []))
    pi = F.array(*[F.lit(i) for i, _ in _WPAIRS])
    pj = F.array(*[F.lit(j) for _, j in _WPAIRS])
    n1 = F.lit(-1)
    parts = [mom.select(F.lit("n").alias("stat"), n1.alias("i"), n1.alias("j"), F.col("n").cast("double").alias("value")),
             mom.select(F.lit("sy"), n1, n1, F.round("sy", 6)),
             mom.select(F.lit("syy"), n1, n1, F.round("syy", 6))]
    parts += [mom.select(F.lit(s).alias("stat"), F.posexplode(s).alias("i", "v"))
              .select("stat", "i", n1.alias("j"), F.round("v", 6).alias("value")) for s in ("sx", "sxy")]
    parts.append(mom.select(F.posexplode("sxx").alias("k", "v")).select(
        F.lit("sxx").alias("stat"), F.element_at(pi, F.col("k") + 1).alias("i"),
        F.element_at(pj, F.col("k") + 1).alias("j"), F.round("v", 6).alias("value")))
    out = parts[0]
    for d in parts[1:]:
        out = out.union(d)
    return out


# ------------------------------------------------ many series (per nation)

_NATION_SQL = """
WITH li AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS date_id, l_suppkey,
                   CAST(round(l_extendedprice * 100) AS BIGINT) AS pc, CAST(l_quantity AS BIGINT) AS q,
                   CAST(round(l_discount * 100) AS BIGINT) AS dc FROM lineitem),
d AS (SELECT CAST(s.s_nationkey AS INTEGER) AS nation, date_id, count(*) AS n, sum(pc) AS sp, sum(q) AS sq, sum(dc) AS sd
      FROM li JOIN supplier s ON li.l_suppkey = s.s_suppkey GROUP BY ALL),
f AS (SELECT nation, date_id, sp / n / 100 AS avg_price,
             CASE WHEN (date_id + nation) % 13 <> 0 THEN sq / n END AS avg_qty,
             CASE WHEN NOT ((date_id % 97) < nation % 5) THEN sd / n / 100 END AS avg_disc,
             CAST(n AS DOUBLE) AS n_lines FROM d)
SELECT *, lead(avg_price) OVER (PARTITION BY nation ORDER BY date_id) / avg_price - 1 AS target FROM f"""


def _nation_panel(spark, sf_dir):
    from marketflow.plans import nation_panel
    return cached("nation_panel", spark, sf_dir, lambda: nation_panel.build(spark, sf_dir))


@query("win1_keyed_nation_panel", _NATION_SQL)
def q_nation_panel(spark, sf_dir):
    """Many series: a daily panel per supplier nation (lineitem pre-aggregated
    per supplier-day before the supplier join), next-day return by a keyed lead."""
    return _nation_panel(spark, sf_dir)


@query("win3_win5_mod1_mod2_per_nation_elastic_net")
def q_nation_enet(spark, sf_dir):
    """One elastic net per nation, all in parallel: keyed EWM fill, keyed
    contiguous folds, keyed z-score, moments by (nation, fold), CV path per
    (nation, fold), alpha pick and final fit per nation."""
    from marketflow.plans import nation_panel
    out = nation_panel.fit_per_nation(_nation_panel(spark, sf_dir))
    return out.select("nation", "alpha", "cv_mse", "intercept",
                      *[F.col("coef")[i].alias(f"w_{c}") for i, c in enumerate(nation_panel.FEATURES)])
