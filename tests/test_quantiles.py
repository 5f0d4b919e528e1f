"""Exact quantiles, winsorising and fences against numpy: nulls, NaN, ties, hot and NULL series, missed brackets, no rows."""

import math
import random

import numpy as np
import pytest

from marketflow.operators import quantiles

PROBS = [0.0, 0.03, 0.25, 0.5, 0.77, 1.0]
SCHEMA = "s string, a double, b double, one int"


def frame():
    rng = random.Random(4)
    rows = [("hot", rng.gauss(0, 1), float(rng.randint(0, 3)), k) for k in range(3000)]
    rows += [(f"s{k % 40}" if k % 40 else None, None if k % 3 == 0 else rng.random(), float("nan") if k % 5 == 0 else 7.0, k) for k in range(1500)]
    rows += [("single", 1.5, None, 0), ("void", None, None, 0), ("far", float("inf"), -0.0, 0), ("far", float("-inf"), 0.0, 0), ("far", 2.0, 1e300, 0)]
    return rows


def known(rows, at, key=...):
    return [r[at] for r in rows if (key is ... or r[0] == key) and r[at] is not None and not math.isnan(r[at])]


def expected(values, p):
    v, h = sorted(values), (len(values) - 1) * p
    if not v:
        return None
    a, z = v[math.floor(h)], v[math.ceil(h)]
    return a if a == z else a + (z - a) * (h - math.floor(h))


def check(rows, got, keyed=True):
    got = {(r["s"] if keyed else ..., r["column"], r["p"]): (r["n"], r["value"]) for r in got.collect()}
    series = {r[0] for r in rows} if keyed else {...}
    assert len(got) == len(series) * 2 * len(PROBS)
    for s in series:
        for at, c in ((1, "a"), (2, "b")):
            values = known(rows, at, s)
            for p in PROBS:
                n, value = got[s, c, p]
                want = expected(values, p)
                assert n == len(values)
                assert value == want or math.isclose(value, want, rel_tol=1e-12, abs_tol=1e-12) or (math.isnan(value) and math.isnan(want)), (s, c, p)


def test_keyed_and_unkeyed(spark):
    rows = frame()
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    check(rows, quantiles.exact_quantiles(df, ["a", "b"], PROBS, ["s"]))
    check(rows, quantiles.exact_quantiles(df, ["a", "b"], PROBS), keyed=False)


@pytest.mark.parametrize("margin", [0.0, -0.1])
def test_ranks_that_the_sketch_missed(spark, monkeypatch, margin):
    """Brackets that are too narrow, or empty: the values are the same."""
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    monkeypatch.setattr(quantiles, "MARGIN", margin)
    rows = frame()
    check(rows, quantiles.exact_quantiles(spark.createDataFrame(rows, SCHEMA).repartition(6), ["a", "b"], PROBS, ["s"]))


def test_no_rows_and_wrong_arguments(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert quantiles.exact_quantiles(df, ["a"], [0.5], ["s"]).count() == 0
    assert quantiles.winsorise(df, ["a"], ["s"]).count() == 0 and quantiles.outlier_counts(df, ["a"]).count() == 0
    for probs, keys in (([1.5], ["s"]), ([], ["s"]), ([0.5], ["value"])):
        with pytest.raises(ValueError):
            quantiles.exact_quantiles(df.withColumnRenamed("b", "value"), ["a"], probs, keys)


def test_winsorise(spark):
    """Other columns stay, one named like a working column too; nulls stay; a series that the fit lacks stays."""
    rows = [r for r in frame() if r[0] != "far"]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("b", "l0").repartition(6)
    got = quantiles.winsorise(df, ["a"], ["s"], 0.1, 0.9, fit=df.where("s <> 'single' OR s IS NULL"))
    assert got.columns == ["s", "a", "l0", "one"]
    ends = {s: [expected(known(rows, 1, s), p) for p in (0.1, 0.9)] for s in {r[0] for r in rows}}
    want = [(s, a if a is None or s == "single" else min(max(a, ends[s][0]), ends[s][1]), one) for s, a, _, one in rows]
    order = lambda r: (r[0] or "", r[2])
    for x, y in zip(sorted(((r.s, r.a, r.one) for r in got.collect()), key=order), sorted(want, key=order), strict=True):
        assert x[0] == y[0] and x[2] == y[2] and (x[1] == y[1] if y[1] is None else math.isclose(x[1], y[1], rel_tol=1e-12)), (x, y)


def test_fences(spark):
    rows = [r for r in frame() if r[0] != "far"]
    got = {(r.s, r.column): r for r in quantiles.outlier_counts(spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["s"], 0.5).collect()}
    for s in {r[0] for r in rows}:
        v = np.array(known(rows, 1, s))
        r = got[s, "a"]
        assert r.n == len(v)
        if len(v):
            q, t = np.quantile(v, [0.25, 0.75])
            low, high = q - 0.5 * (t - q), t + 0.5 * (t - q)
            assert math.isclose(r.lower, low, abs_tol=1e-9) and math.isclose(r.upper, high, abs_tol=1e-9)
            assert (r.n_low, r.n_high) == ((v < low).sum(), (v > high).sum())
        else:
            assert r.lower is None and r.n_low == 0
