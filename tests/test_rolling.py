"""Rolling statistics against plain loops: long and short frames, blocks of any size, ranges with gaps and ties, nulls, hot series."""

import math
import random
import statistics

import pytest

from marketflow.operators import rolling


def rows():
    rng = random.Random(4)
    out = [("hot", k, None if rng.random() < 0.2 else 1e6 + rng.random()) for k in range(250)]
    out += [(key, k, rng.gauss(0, 3)) for key, n in (("a", 40), (None, 90), ("nulls", 9)) for k in range(n)]
    return [(k, t, None if k == "nulls" else v) for k, t, v in out] + [("one", 0, 5.0)]


def stats(values, least):
    v = [x for x in values if x is not None]
    if len(v) < max(1, least):
        return [len(v)] + [None] * 5
    return [len(v), math.fsum(v), math.fsum(v) / len(v), statistics.stdev(v) if len(v) > 1 else None, min(v), max(v)]


def near(got, want):
    return all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)) for a, b in zip(got, want))


@pytest.mark.parametrize("window,block", [(1, None), (5, None), (64, None), (70, None), (33, 4), (100, 3), (2, 1), (10_000, 7)])
def test_row_frames(spark, window, block):
    data = rows()
    df = spark.createDataFrame(data, "key string, t int, x double").repartition(5)
    got = rolling.rolling(df, ["x"], window, "t", "key", rolling.AGGS, 2, block_rows=block).collect()
    by = {}
    for key, t, v in sorted(data, key=lambda r: r[1]):
        by.setdefault(key, []).append(v)
    assert len(got) == len(data)
    for r in got:
        want = stats(by[r.key][max(0, r.t - window + 1):r.t + 1], 2)
        assert near([r[f"x_{a}"] for a in rolling.AGGS], want), (r, want)


def test_unkeyed_default_min_periods_and_names(spark):
    df = spark.createDataFrame([(k, float(k % 7), float(-k)) for k in range(200)], "t int, x double, y double").repartition(3)
    got = sorted(rolling.rolling(df, ["x", "y"], 80, "t", aggs=("mean", "max"), name=lambda c, a: f"{a}({c})").collect())
    assert got[0].asDict().keys() == {"t", "x", "y", "mean(x)", "max(x)", "mean(y)", "max(y)"}
    for r in got:
        assert (r["mean(x)"] is None) == (r.t < 79)
        if r.t >= 79:
            assert math.isclose(r["mean(x)"], sum(k % 7 for k in range(r.t - 79, r.t + 1)) / 80) and r["max(y)"] == -(r.t - 79)


@pytest.mark.parametrize("span,block", [(1, 256), (30, 256), (30, 4), (400, 5), (5, 1)])
def test_time_ranges(spark, span, block):
    rng = random.Random(9)
    data = [("hot", rng.choice([7, 7, 7, rng.randint(0, 300)]), rng.random()) for _ in range(400)]
    data += [(rng.choice(["a", None]), rng.choice([0, 1, 2, 200, 201, 1000]), rng.choice([None, rng.random()])) for _ in range(60)] + [("a", None, 1.0)]
    df = spark.createDataFrame(data, "key string, t bigint, x double").repartition(5)
    got = rolling.rolling_range(df, ["x"], span, "t", "key", rolling.AGGS, block_rows=block).collect()
    assert sorted(map(str, ((r.key, r.t) for r in got))) == sorted(map(str, {(k, t) for k, t, _ in data if t is not None}))
    for r in got:
        want = stats([x for k, t, x in data if k == r.key and t is not None and r.t - span < t <= r.t], 1)
        assert near([r[f"x_{a}"] for a in rolling.AGGS], want), (r, want)


def test_nothing(spark):
    df = spark.createDataFrame([], "key string, t bigint, x double")
    assert rolling.rolling(df, ["x"], 3, "t", "key").count() == 0
    assert rolling.rolling(df, ["x"], 300, "t").count() == 0
    assert rolling.rolling_range(df, ["x"], 3, "t", "key").count() == 0
    with pytest.raises(ValueError):
        rolling.rolling(df, ["x"], 0, "t")
