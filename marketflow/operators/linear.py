"""Elastic net with cross-validated penalty (AGG15, MOD2, MOD3, MOD4).

One Spark pass builds sufficient statistics per (series, fold): n, sum x,
sum y, sum y^2, sum x x^T (upper triangle) and sum x y. Training moments of
fold f are total minus fold. Everything after that is O(p^2) per group, so the
fits run as ``applyInPandas`` over tiny groups -- the rows never leave Spark's
aggregation:

* path per (series, fold): warm-started coordinate descent on the Gram matrix
  along the alpha grid, validation MSE from the held-out fold's moments;
* Spark averages the MSE over folds and picks, per series, the alpha with the
  lowest mean MSE (largest alpha on ties);
* final fit per series on all training moments at that alpha.

Objective (per series): 1/(2n) ||y - b - Xw||^2 + a*r*||w||_1 + a*(1-r)/2*||w||^2.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.functions.scalar import log_grid_values
from marketflow.operators.series import _keyed_join
from marketflow.plans.materialize import materialize

# Default CV settings of the linear model.
L1_RATIO = 0.5
CV_FOLDS = 10
N_ALPHAS = 100
ALPHA_EXP_RANGE = (-4.0, 2.0)
CV_MAX_ITER = 1_000_000
FINAL_MAX_ITER = 1_000
TOL = 1e-4


@dataclass(frozen=True)
class PenaltyGrid:
    """Settings of the cross-validated fit; every field is checked."""

    l1_ratio: float = L1_RATIO
    cv: int = CV_FOLDS
    alphas: tuple[float, ...] = field(default_factory=lambda: tuple(log_grid_values(N_ALPHAS, *ALPHA_EXP_RANGE)))
    max_iter: int = CV_MAX_ITER

    def __post_init__(self):
        object.__setattr__(self, "alphas", tuple(self.alphas))
        checks = {"l1_ratio must lie in [0, 1]": 0 <= self.l1_ratio <= 1, "cv needs two folds or more": self.cv >= 2,
                  "alphas must be positive and not empty": bool(self.alphas) and min(self.alphas, default=0) > 0,
                  "max_iter must be 1 or more": self.max_iter >= 1}
        wrong = [text for text, ok in checks.items() if not ok]
        if wrong:
            raise ValueError("; ".join(wrong))


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


# Above this many features the cross moments are accumulated with numpy per
# partition (one BLAS product per chunk) instead of p(p+1)/2 SQL aggregates.
WIDE_FEATURES = 24
# Groups held at once by one partial-moment accumulator before it flushes.
MAX_OPEN_GROUPS = 2_000


def moments(df: DataFrame, features: list[str], target: str, group_cols: list[str],
            engine: str = "auto") -> DataFrame:
    """AGG15: sufficient statistics per group, one pass over the rows.

    Output: group columns, ``n`` (long), ``sx``/``sxy`` (array<double>, length p),
    ``sy``/``syy`` (double), ``sxx`` (array<double>, upper triangle row-major).
    Rows with a null feature or target are skipped, as a fit would.

    ``engine='sql'``: one aggregation with p(p+1)/2 sums (narrow inputs).
    ``engine='numpy'``: per-partition partial moments in ``mapInPandas``
    (map-side combine, bounded number of open groups), then an element-wise
    merge per group in Spark (wide inputs). ``'auto'`` picks by width.
    """
    x = [F.col(c).cast("double") for c in features]
    y = F.col(target).cast("double")
    ok = y.isNotNull()
    for c in x:
        ok = ok & c.isNotNull()
    d = df.where(ok)
    p = len(features)
    if engine == "numpy" or (engine == "auto" and p > WIDE_FEATURES):
        return _moments_numpy(d.select(*group_cols, *[xi.alias(f"_x{i}") for i, xi in enumerate(x)],
                                       y.alias("_y")), group_cols, p)
    return d.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x[i]) for i in range(p)]).alias("sx"),
        F.sum(y).alias("sy"),
        F.sum(y * y).alias("syy"),
        F.array(*[F.sum(x[i] * x[j]) for i, j in _pairs(p)]).alias("sxx"),
        F.array(*[F.sum(x[i] * y) for i in range(p)]).alias("sxy"),
    )


def _moments_numpy(d: DataFrame, keys: list[str], p: int) -> DataFrame:
    if not keys:  # one group: a constant key keeps the merge an equi join
        out = _moments_numpy(d.withColumn("_k", F.lit(0)), ["_k"], p)
        return out.drop("_k")
    iu = np.triu_indices(p)
    xcols = [f"_x{i}" for i in range(p)]
    key_fields = [d.schema[k] for k in keys]
    part_schema = T.StructType(key_fields + [
        T.StructField("n", T.LongType()), T.StructField("sy", T.DoubleType()), T.StructField("syy", T.DoubleType()),
        T.StructField("v", T.ArrayType(T.DoubleType()))])  # v = sx ++ sxx(upper) ++ sxy

    def partial(it):
        acc: dict = {}

        def flush():
            rows = []
            for k, (n, sy, syy, sx, S, sxy) in acc.items():
                rows.append(list(k) + [n, sy, syy, np.concatenate([sx, S[iu], sxy]).tolist()])
            acc.clear()
            # object columns: a key that is NULL in all rows keeps the declared type
            return pd.DataFrame(rows, columns=keys + ["n", "sy", "syy", "v"], dtype=object)

        for pdf in it:
            for k, g in pdf.groupby(keys, sort=False, dropna=False):
                k = tuple(None if pd.isna(x) else x for x in (k if isinstance(k, tuple) else (k,)))
                X = g[xcols].to_numpy(dtype="float64")
                yv = g["_y"].to_numpy(dtype="float64")
                a = acc.get(k)
                if a is None:
                    a = acc[k] = [0, 0.0, 0.0, np.zeros(p), np.zeros((p, p)), np.zeros(p)]
                a[0] += len(yv)
                a[1] += yv.sum()
                a[2] += yv @ yv
                a[3] += X.sum(axis=0)
                a[4] += X.T @ X
                a[5] += X.T @ yv
            if len(acc) >= MAX_OPEN_GROUPS:
                yield flush()
        if acc:
            yield flush()

    # one Python pass over the rows: both merges read the written partial moments
    parts = materialize(d.mapInPandas(partial, part_schema), "partial-moments")
    L = p + len(iu[0]) + p
    # element-wise merge of the partial vectors: (group, idx) sums, shuffled by
    # (group, idx) so a hot group is spread over many tasks
    ex = parts.select(*keys, "n", "sy", "syy", F.posexplode("v").alias("i", "val"))
    scal = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"))
    vec = ex.groupBy(*keys, "i").agg(F.sum("val").alias("val")) \
            .groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "val"))).alias("_v"))
    vals = F.transform(F.col("_v"), lambda e: e["val"])
    out = _keyed_join(scal, vec, keys, [], "inner")  # NULL-safe: a NULL group is a group
    return out.select(*keys, F.col("n").cast("long").alias("n"), F.slice(vals, 1, p).alias("sx"), "sy", "syy",
                      F.slice(vals, p + 1, L - 2 * p).alias("sxx"), F.slice(vals, L - p + 1, p).alias("sxy"))


def _unpack(n, sx, sy, syy, sxx, sxy, p):
    sx, sxy = np.asarray(sx, float), np.asarray(sxy, float)
    S = np.zeros((p, p))
    iu = np.triu_indices(p)
    S[iu] = np.asarray(sxx, float)
    S = S + S.T - np.diag(np.diag(S))
    return float(n), sx, float(sy), float(syy), S, sxy


def _centered(n, sx, sy, syy, S, sxy):
    mx, my = sx / n, sy / n
    Q = S - n * np.outer(mx, mx)
    q = sxy - n * mx * my
    yy = syy - n * my * my
    return mx, my, Q, q, yy


def cd_gram(Q, q, yy, n, alpha, l1_ratio, w0=None, max_iter=1000, tol=TOL):
    """Coordinate descent on the centred Gram matrix with a duality-gap stop.

    The sweeps work on plain floats: a coordinate step is a handful of scalar operations, and the
    products ``Q w`` are only touched when a coefficient changes."""
    p = Q.shape[0]
    w = [0.0] * p if w0 is None else [float(x) for x in w0]
    l1 = alpha * l1_ratio * n
    l2 = alpha * (1.0 - l1_ratio) * n
    columns = Q.T.tolist()
    target = [float(x) for x in q]
    used = [j for j in range(p) if columns[j][j] != 0.0]
    H = (Q @ np.array(w)).tolist() if p else []
    for _ in range(max_iter):
        w_max, d_max = 0.0, 0.0
        for j in used:
            wj, column = w[j], columns[j]
            tmp = target[j] - H[j] + column[j] * wj
            size = abs(tmp) - l1
            new = (size if tmp > 0 else -size) / (column[j] + l2) if size > 0.0 else 0.0
            change = new - wj
            if change:
                H = [h + c * change for h, c in zip(H, column)]
                w[j] = new
                d_max = max(d_max, abs(change))
            w_max = max(w_max, abs(new))
        if w_max == 0.0 or d_max / w_max < tol:
            v, h = np.array(w), np.array(H)
            qw = v @ q
            XtA = q - h - l2 * v
            dual = np.max(np.abs(XtA)) if p else 0.0
            R2 = yy + v @ h - 2.0 * qw
            const = l1 / dual if dual > l1 else 1.0
            gap = 0.5 * (R2 + R2 * const * const) if dual > l1 else R2
            gap += l1 * np.sum(np.abs(v)) - const * (yy - qw) + 0.5 * l2 * (1 + const * const) * (v @ v)
            if gap < tol * yy:
                break
    return np.array(w)


def _mse(w, b, n, sx, sy, syy, S, sxy):
    """Mean squared error of y ~ b + x.w from the moments of a row set."""
    if n == 0:
        return float("nan")
    sse = syy - 2 * b * sy - 2 * (w @ sxy) + n * b * b + 2 * b * (w @ sx) + w @ S @ w
    return max(sse, 0.0) / n


def cv_path(spark_df_moments: DataFrame, keys: list[str], p: int, params: PenaltyGrid) -> DataFrame:
    """MOD2 step 1: per (series, fold) path of validation MSE over the alphas."""
    alphas = sorted(params.alphas, reverse=True)
    l1r, mi = params.l1_ratio, params.max_iter

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        tr = _unpack(r["n_tr"], r["sx_tr"], r["sy_tr"], r["syy_tr"], r["sxx_tr"], r["sxy_tr"], p)
        va = _unpack(r["n"], r["sx"], r["sy"], r["syy"], r["sxx"], r["sxy"], p)
        n = tr[0]
        mx, my, Q, q, yy = _centered(*tr)
        w = np.zeros(p)
        out = []
        for k, a in enumerate(alphas):
            w = cd_gram(Q, q, yy, n, a, l1r, w, max_iter=mi)
            b = my - mx @ w
            out.append((k, a, _mse(w, b, *va)))
        res = pd.DataFrame(out, columns=["alpha_idx", "alpha", "mse"])
        for kk in keys + ["fold"]:
            res[kk] = r[kk]
        return res

    key_fields = [spark_df_moments.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("fold", T.IntegerType()),
                                        T.StructField("alpha_idx", T.IntegerType()),
                                        T.StructField("alpha", T.DoubleType()),
                                        T.StructField("mse", T.DoubleType())])
    return spark_df_moments.groupBy(*keys, "fold").applyInPandas(fit, schema)


def train_minus_fold(mom: DataFrame, keys: list[str]) -> DataFrame:
    """Training moments of each fold = series total - fold (a grouped sum and
    a join on the series keys; the tables have one row per (series, fold))."""
    tot = mom.groupBy(*keys).agg(
        F.sum("n").alias("n_t"), F.sum("sy").alias("sy_t"), F.sum("syy").alias("syy_t"),
        _sum_arrays("sx").alias("sx_t"), _sum_arrays("sxx").alias("sxx_t"), _sum_arrays("sxy").alias("sxy_t"))
    j = _keyed_join(mom, tot, keys, [], "inner")
    sub = lambda a, b: F.zip_with(F.col(a), F.col(b), lambda u, v: u - v)
    return j.select(*keys, "fold", "n", "sx", "sy", "syy", "sxx", "sxy",
                    (F.col("n_t") - F.col("n")).alias("n_tr"), sub("sx_t", "sx").alias("sx_tr"),
                    (F.col("sy_t") - F.col("sy")).alias("sy_tr"), (F.col("syy_t") - F.col("syy")).alias("syy_tr"),
                    sub("sxx_t", "sxx").alias("sxx_tr"), sub("sxy_t", "sxy").alias("sxy_tr"))


def _sum_arrays(c: str) -> Column:
    """Element-wise sum of equal-length arrays over a group (small groups)."""
    arrs = F.collect_list(F.col(c))
    return F.aggregate(F.slice(arrs, 2, 1 << 30), F.element_at(arrs, 1),
                       lambda acc, x: F.zip_with(acc, x, lambda u, v: u + v))


def select_alpha(path: DataFrame, keys: list[str]) -> DataFrame:
    """MOD2 step 2: mean fold MSE per alpha, best alpha per series (largest on ties)."""
    m = path.groupBy(*keys, "alpha_idx", "alpha").agg(F.avg("mse").alias("mean_mse"))
    return m.groupBy(*keys).agg(
        F.min_by(F.col("alpha"), F.struct(F.col("mean_mse"), -F.col("alpha"))).alias("alpha"),
        F.min("mean_mse").alias("cv_mse"))


def final_fit(total: DataFrame, best: DataFrame, keys: list[str], p: int, l1_ratio: float,
              max_iter: int = FINAL_MAX_ITER) -> DataFrame:
    """MOD3: fit per series on all training moments at the chosen alpha."""
    j = _keyed_join(total, best, keys, [], "inner")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        tr = _unpack(r["n"], r["sx"], r["sy"], r["syy"], r["sxx"], r["sxy"], p)
        mx, my, Q, q, yy = _centered(*tr)
        w = cd_gram(Q, q, yy, tr[0], float(r["alpha"]), l1_ratio, None, max_iter=max_iter)
        b = my - mx @ w
        res = pd.DataFrame({"alpha": [float(r["alpha"])], "cv_mse": [float(r["cv_mse"])],
                            "intercept": [float(b)], "coef": [w.tolist()]})
        for kk in keys:
            res[kk] = r[kk]
        return res

    key_fields = [j.schema[k] for k in keys]
    schema = T.StructType(key_fields + [T.StructField("alpha", T.DoubleType()),
                                        T.StructField("cv_mse", T.DoubleType()),
                                        T.StructField("intercept", T.DoubleType()),
                                        T.StructField("coef", T.ArrayType(T.DoubleType()))])
    return j.groupBy(*keys).applyInPandas(fit, schema)


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    intercept: float
    coef: tuple[float, ...]
    alpha: float
    cv_mse: float

    def predict(self) -> Column:
        """MOD4: the score as a generated Column expression (JVM side)."""
        e = F.lit(self.intercept)
        for c, w in zip(self.features, self.coef):
            if w != 0.0:
                e = e + F.col(c) * F.lit(w)
        return e


def elastic_net_cv(df: DataFrame, features: list[str], target: str, fold_col: str = "fold",
                   keys: list[str] | None = None, params: PenaltyGrid | None = None) -> DataFrame:
    """MOD2 + MOD3 for every series: returns one row per series with
    ``alpha``, ``cv_mse``, ``intercept``, ``coef``. ``fold_col`` holds the
    contiguous fold id (WIN5)."""
    keys = list(keys or [])
    unkeyed = not keys
    if unkeyed:  # one series: a constant key keeps every step an equi join
        df, keys = df.withColumn("_series", F.lit(0)), ["_series"]
    params = params or PenaltyGrid()
    p = len(features)
    mom = moments(df, features, target, keys + [fold_col]).withColumnRenamed(fold_col, "fold") \
        .withColumn("fold", F.col("fold").cast("int"))
    mom = materialize(mom, "moments")  # tiny; every later step reads it
    tm = train_minus_fold(mom, keys)
    path = cv_path(tm, keys, p, params)
    best = select_alpha(path, keys)
    total = mom.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("sy").alias("sy"), F.sum("syy").alias("syy"),
        _sum_arrays("sx").alias("sx"), _sum_arrays("sxx").alias("sxx"), _sum_arrays("sxy").alias("sxy"))
    return final_fit(total, best, keys, p, params.l1_ratio)


def fit_linear(df: DataFrame, features: list[str], target: str, fold_col: str = "fold",
               params: PenaltyGrid | None = None) -> LinearModel:
    """Unkeyed convenience: the one fitted row as a ``LinearModel``."""
    r = elastic_net_cv(df, features, target, fold_col, None, params).first()
    return LinearModel(tuple(features), r["intercept"], tuple(r["coef"]), r["alpha"], r["cv_mse"])


def predict_keyed(df: DataFrame, models: DataFrame, features: list[str], keys: list[str],
                  out: str = "prediction") -> DataFrame:
    """MOD4 for many series: coefficients joined on the series keys."""
    j = _keyed_join(df, models.select(*keys, "intercept", "coef"), keys, [], "inner")
    dot = F.col("intercept")
    for i, c in enumerate(features):  # plain arithmetic: stays in codegen
        dot = dot + F.col("coef")[i] * F.col(c).cast("double")
    return j.withColumn(out, dot).drop("intercept", "coef")
