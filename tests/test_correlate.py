"""Correlation matrices against pandas and plain loops: nulls, NaN, ties, constants, hot values, level far from 0."""

import math
import random

import pandas as pd
import pytest

from marketflow.operators import correlate

COLS = ["a", "b", "c", "hot", "const", "empty", "far"]


def frame():
    rng = random.Random(8)
    rows = []
    for k in range(400):
        a = rng.gauss(0, 1)
        rows.append((a, None if k % 5 == 0 else a + rng.gauss(0, 1), float("nan") if k % 7 == 0 else float(rng.randint(0, 4)),
                     0.0 if k % 3 else rng.random(), 2.5, None, 1e9 + a * a))
    return rows + [(None, None, 1.0, -0.0, None, None, None)] * 2


def check(got, want):
    got = {(r.a, r.b): (r.n, r.corr) for r in got.collect()}
    assert len(got) == len(COLS) ** 2
    for a in COLS:
        for b in COLS:
            both = want[a].notna() & want[b].notna()
            n, corr = got[a, b]
            assert n == both.sum()
            x, y = want[a][both], want[b][both]
            if n < 2 or x.nunique() < 2 or y.nunique() < 2:
                assert corr is None, (a, b, corr)
            else:
                assert math.isclose(corr, x.corr(y), abs_tol=1e-6), (a, b)


def test_matrices(spark):
    rows = frame()
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS)).repartition(5)
    want = pd.DataFrame(rows, columns=COLS).astype(float)
    check(correlate.pearson(df, COLS), want)
    check(correlate.spearman(df, COLS), want.rank())


def test_ranks(spark):
    rows = frame()
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in COLS)).repartition(5)
    got = pd.DataFrame([r.asDict() for r in correlate.average_ranks(df, COLS).collect()])
    want = pd.DataFrame(rows, columns=COLS).astype(float).rank()
    for c in COLS:
        assert sorted(got[c].dropna()) == sorted(want[c].dropna())


def test_groups_and_nothing(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 4.0), (3.0, 7.0, 1.0)], "p1 double, p2 double, q1 double")
    m = correlate.pearson(df, ["p1", "p2", "q1"])
    got = {(r.group_a, r.group_b): r for r in correlate.between_groups(m, {"P": ["p1", "p2"], "Q": ["q1"]}).collect()}
    assert got["P", "Q"].n_pairs == 2 and got["P", "P"].n_pairs == 2 and ("Q", "Q") not in got
    assert {r.column for r in correlate.with_target(m, "q1").collect()} == {"p1", "p2"}
    none = correlate.spearman(df.limit(0), ["p1", "q1"]).collect()
    assert len(none) == 4 and all(r.n == 0 and r["corr"] is None for r in none)
