"""Blend weights on the simplex and nested stacking against brute force."""

import itertools

import numpy as np
import pytest

from marketflow.operators import stack


def brute(g, c):
    """Best weights by trying every set of models."""
    m, best = len(c), None
    scale = np.abs(np.diag(g)).max()
    g, c = g / scale, c / scale
    for size in range(1, m + 1):
        for k in itertools.combinations(range(m), size):
            lhs = np.zeros((size + 1, size + 1))
            lhs[:-1, :-1], lhs[:-1, -1], lhs[-1, :-1] = g[np.ix_(k, k)], 1, 1
            w = np.zeros(m)
            w[list(k)] = np.linalg.lstsq(lhs, np.append(c[list(k)], 1), rcond=None)[0][:-1]
            if (w >= -1e-9).all():
                cost = w @ g @ w - 2 * w @ c
                if best is None or cost < best:
                    best = cost
    return best * scale


@pytest.mark.parametrize("seed", range(40))
def test_simplex_weights_are_optimal(seed):
    rng = np.random.default_rng(seed)
    m, n = int(rng.integers(1, 7)), 60
    p = rng.normal(size=(n, m)) * 10.0 ** rng.integers(-4, 4)
    if seed % 4 == 0 and m > 1:
        p[:, -1] = p[:, 0]  # equal models
    y = p @ rng.dirichlet(np.ones(m)) + rng.normal(size=n) * p.std() * rng.choice([0, 0.5, 5])
    g, c = p.T @ p, p.T @ y
    w = stack.simplex_least_squares(g, c)
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9
    assert w @ g @ w - 2 * w @ c <= brute(g, c) + 1e-8 * max(1e-12, float(y @ y))


def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, n in (("hot", 300), ("a", 60), (None, 60)):
        for k in range(n):
            y = float(rng.normal())
            fold = 1 + k * 4 // n
            rows += [(key, k, fold, y, "m1", y + float(rng.normal())), (key, k, fold, y, "m2", float(rng.normal())), (key, k, fold, y, "m3", 0.1)]
    rows += [("a", 90, 1, 1.0, "m1", 0.5), ("a", 91, 1, None, "m1", 0.5), ("a", 91, 1, None, "m2", 0.5), ("a", 91, 1, None, "m3", 0.5),
             ("a", 92, 2, 1.0, "m1", None), ("a", 92, 2, 1.0, "m2", 0.5), ("a", 92, 2, 1.0, "m3", 0.5), ("a", 93, 2, 1.0, "other", 0.5)]
    rows += [("a", 94, 2, 1.0, m, 0.5) for m in ("m1", "m1", "m2", "m3")]
    return rows, spark.createDataFrame(rows, "key string, id int, fold int, y double, model string, pred double")


@pytest.mark.parametrize("past_only", [False, True])
def test_nested_stacking(spark, past_only):
    rows, df = table(spark)
    models = ["m1", "m2", "m3"]
    wide = stack.wide_scores(df, models, ["key", "id", "fold", "y"])
    weights = stack.nested_weights(stack.gram_table(wide, "y", 3, ["key", "fold"]), models, keys=["key"], past_only=past_only)
    got = {(r.key, r.fold): (r.n_fit, r.weights) for r in weights.collect()}
    assert len(got) == 12
    full = {}
    for key, k, fold, y, m, p in rows:
        full.setdefault((key, k, fold, y), {}).setdefault(m, []).append(p)
    full = [(k, [v[m][0] for m in models]) for k, v in full.items() if set(v) == set(models) and all(len(x) == 1 and x[0] is not None for x in v.values())]
    for (key, fold), (n_fit, w) in got.items():
        own = [(p, k[3]) for k, p in full if k[0] == key and k[3] is not None and (k[2] < fold if past_only else k[2] != fold)]
        assert n_fit == len(own)
        if not own:
            assert w == [1 / 3] * 3
            continue
        p, y = np.array([x for x, _ in own]), np.array([x for _, x in own])
        assert np.allclose(w, stack.simplex_least_squares(p.T @ p, p.T @ y), atol=1e-8)
    out = stack.stacked(wide, weights, keys=["key"]).collect()
    assert len(out) == len(full)
    for r in out:
        assert abs(r.stacked - sum(a * b for a, b in zip(r.preds, got[r.key, r.fold][1]))) < 1e-12


def test_nothing_to_stack(spark):
    _, df = table(spark)
    wide = stack.wide_scores(df.limit(0), ["m1"], ["key", "id", "fold", "y"])
    assert stack.nested_weights(stack.gram_table(wide, "y", 1, ["fold"]), ["m1"]).count() == 0
