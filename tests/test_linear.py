"""MOD2/MOD3: the moment-based coordinate descent against brute force on the
raw rows (numpy), KKT conditions, and the CV selection."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.operators import linear, series


def _data(n=600, p=5, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, p))
    w = np.array([0.5, -0.3, 0.0, 0.0, 0.2])[:p]
    y = X @ w + 0.1 + rng.normal(scale=0.5, size=n)
    return X, y


def _brute_cd(X, y, alpha, l1r, iters=5000):
    n, p = X.shape
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.zeros(p)
    for _ in range(iters):
        for j in range(p):
            r = yc - Xc @ w + Xc[:, j] * w[j]
            z = Xc[:, j] @ r / n
            w[j] = np.sign(z) * max(abs(z) - alpha * l1r, 0) / (Xc[:, j] @ Xc[:, j] / n + alpha * (1 - l1r))
    return w, y.mean() - X.mean(0) @ w


def test_moment_solver_matches_brute_force_and_kkt():
    X, y = _data()
    n, p = X.shape
    S = X.T @ X
    tr = (float(n), X.sum(0), float(y.sum()), float(y @ y), S, X.T @ y)
    mx, my, Q, q, yy = linear._centered(*tr)
    for a in [0.001, 0.01, 0.05]:
        w = linear.cd_gram(Q, q, yy, n, a, 0.5, max_iter=100000, tol=1e-12)
        wb, _ = _brute_cd(X, y, a, 0.5)
        assert np.allclose(w, wb, atol=1e-8)
        # KKT: |grad_j| <= a*l1r for zero coefs, equality for non-zero
        Xc, yc = X - X.mean(0), y - y.mean()
        g = Xc.T @ (yc - Xc @ w) / n - a * 0.5 * w
        for j in range(p):
            if w[j] == 0:
                assert abs(g[j]) <= a * 0.5 + 1e-9
            else:
                assert abs(g[j] - a * 0.5 * np.sign(w[j])) < 1e-7


def test_cv_selection_matches_brute_force(spark):
    X, y = _data(n=230, p=4, seed=2)
    pdf = pd.DataFrame(X, columns=["a", "b", "c", "d"]).assign(y=y, t=np.arange(230, dtype="int64"))
    df = series.add_folds(series.add_position(spark.createDataFrame(pdf), "t"), "contiguous", 10)
    alphas = [0.3, 0.1, 0.03, 0.01, 0.003]
    params = linear.PenaltyGrid(alphas=alphas)
    got = linear.elastic_net_cv(df, ["a", "b", "c", "d"], "y", params=params).first()
    # brute force: contiguous 10 folds, path per fold, mean mse
    folds = np.array_split(np.arange(230), 10)
    mse = np.zeros(len(alphas))
    for idx in folds:
        m = np.ones(230, bool)
        m[idx] = False
        for k, a in enumerate(sorted(alphas, reverse=True)):
            w, b = _brute_cd(X[m], y[m], a, 0.5, iters=3000)
            mse[k] += np.mean((y[idx] - b - X[idx] @ w) ** 2) / 10
    best = sorted(alphas, reverse=True)[int(np.argmin(mse))]
    assert got["alpha"] == pytest.approx(best)
    w, b = _brute_cd(X, y, best, 0.5)
    assert np.allclose(got["coef"], w, atol=1e-6) and got["intercept"] == pytest.approx(b, abs=1e-6)


def test_keyed_fits_many_series(spark):
    X, y = _data(n=300, p=3, seed=4)
    pdf = pd.DataFrame(X, columns=["a", "b", "c"]).assign(y=y, t=np.arange(300, dtype="int64"),
                                                         s=np.arange(300) % 3)
    df = spark.createDataFrame(pdf)
    df = series.add_folds(series.add_position(df, "t", "s"), "contiguous", 5, partition_by="s")
    out = linear.elastic_net_cv(df, ["a", "b", "c"], "y", keys=["s"],
                                params=linear.PenaltyGrid(alphas=[0.1, 0.01])).collect()
    assert sorted(r["s"] for r in out) == [0, 1, 2] and all(len(r["coef"]) == 3 for r in out)


def test_numpy_moments_equal_sql_moments(spark):
    rng = np.random.default_rng(9)
    n, p = 700, 6
    pdf = pd.DataFrame(rng.normal(size=(n, p)), columns=[f"x{i}" for i in range(p)])
    pdf["y"] = rng.normal(size=n)
    pdf["g"] = rng.integers(0, 3, n)
    pdf.loc[5, "x2"] = np.nan
    df = spark.createDataFrame(pdf.where(pd.notnull(pdf), None)).repartition(5)
    feats = [f"x{i}" for i in range(p)]
    for keys in (["g"], []):
        a = {tuple(r[k] for k in keys): r for r in linear.moments(df, feats, "y", keys, engine="sql").collect()}
        b = {tuple(r[k] for k in keys): r for r in linear.moments(df, feats, "y", keys, engine="numpy").collect()}
        assert a.keys() == b.keys()
        for k in a:
            assert a[k]["n"] == b[k]["n"]
            for c in ("sx", "sxx", "sxy"):
                assert np.allclose(a[k][c], b[k][c], atol=1e-9)
            assert abs(a[k]["sy"] - b[k]["sy"]) < 1e-9 and abs(a[k]["syy"] - b[k]["syy"]) < 1e-9


def test_per_nation_fit_equals_single_series_fit(spark):
    """Keyed elastic net (25 series at once) = the unkeyed fit of one series."""
    from marketflow.plans import nation_panel as npl
    from marketflow.operators import schema
    from marketflow.operators.scale import apply_scaler, fit_scaler
    panel = npl.build(spark, "/root/testdata/sf0.001")
    params = linear.PenaltyGrid(alphas=[0.1, 0.01, 0.001])
    keyed = {r["nation"]: r for r in npl.fit_per_nation(panel, params).collect()}
    nat = sorted(keyed)[0]
    one = panel.where(F.col("nation") == nat).drop("nation")
    filled = series.ewm(one, npl.FEATURES, "date_id", com=0.5, fill=True)
    data = schema.drop_nulls(filled, ["target", *npl.FEATURES])
    z = apply_scaler(data, fit_scaler(data, npl.FEATURES))
    z = series.add_folds(series.add_position(z, "date_id"), "contiguous", 10)
    single = linear.elastic_net_cv(z, npl.FEATURES, "target", "fold", None, params).first()
    assert len(keyed) > 1
    assert keyed[nat]["alpha"] == pytest.approx(single["alpha"])
    assert np.allclose(keyed[nat]["coef"], single["coef"], atol=1e-7)


def test_predict_keyed(spark):
    models = spark.createDataFrame([(0, 1.0, [2.0, 3.0]), (1, -1.0, [0.0, 1.0])], "s int, intercept double, coef array<double>")
    df = spark.createDataFrame([(0, 1.0, 1.0), (1, 2.0, 5.0)], "s int, a double, b double")
    got = {r["s"]: r["prediction"] for r in linear.predict_keyed(df, models, ["a", "b"], ["s"]).collect()}
    assert got == {0: 6.0, 1: 4.0}
