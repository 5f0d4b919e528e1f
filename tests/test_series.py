"""WIN1-WIN7: known answers and brute force (pandas) on small fixtures, with
tiny buckets/blocks so the cross-block paths run."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.operators import series

NAN = float("nan")


def _frame(spark, vals, key=None):
    pdf = pd.DataFrame({"t": np.arange(len(vals), dtype="int64") * 3 + 7, "x": vals})
    if key is not None:
        pdf["k"] = key
    return spark.createDataFrame(pdf.where(pd.notnull(pdf), None))


def test_ewm_known_answers(spark):
    df = _frame(spark, [None, 1.0, None, None, 4.0, 2.0])
    carry = series.ewm(df, ["x"], "t", com=0.5, null_mode="carry").orderBy("t")
    got = [r["x_ewm"] for r in carry.collect()]
    exp = [None, 1.0, 1.0, 1.0, 3.892857143, 2.486238532]
    for g, e in zip(got, exp):
        assert (g is None and e is None) or abs(g - e) < 1e-9
    prop = series.ewm(df, ["x"], "t", com=0.5, null_mode="propagate").orderBy("t")
    got = [r["x_ewm"] for r in prop.collect()]
    assert got[2] is None and got[3] is None and abs(got[4] - 3.892857143) < 1e-9
    fill = series.ewm(df, ["x"], "t", com=0.5, fill=True).orderBy("t")
    assert [r["x"] for r in fill.collect()] == [None, 1.0, 1.0, 1.0, 4.0, 2.0]


@pytest.mark.parametrize("block_rows", [41, 57, 10_000])
def test_ewm_matches_pandas_with_long_gaps(spark, block_rows):
    rng = np.random.default_rng(3)
    v = rng.normal(size=700)
    v[:5] = np.nan          # leading nulls
    v[100:330] = np.nan     # run much longer than K and than a block
    v[rng.choice(700, 80, replace=False)] = np.nan
    df = _frame(spark, [None if np.isnan(x) else float(x) for x in v])
    p = series.add_position(df, "t", n_buckets=7)
    out = series.ewm(p, ["x"], "t", com=0.5, pos_col="pos", block_rows=block_rows).orderBy("t").toPandas()
    ref = pd.Series(v).ewm(com=0.5).mean()
    got = out["x_ewm"].astype(float).to_numpy()
    assert np.allclose(got, ref.to_numpy(), atol=1e-12, equal_nan=True)


def test_ewm_keyed_matches_pandas(spark):
    rng = np.random.default_rng(5)
    n = 400
    keys = rng.integers(0, 4, n)
    keys[:150] = 0  # a hot series
    v = rng.normal(size=n)
    v[rng.choice(n, 60, replace=False)] = np.nan
    pdf = pd.DataFrame({"t": np.arange(n, dtype="int64"), "k": keys, "x": v})
    df = spark.createDataFrame(pdf.where(pd.notnull(pdf), None))
    out = series.ewm(df, ["x"], "t", "k", com=0.5, block_rows=45).toPandas().sort_values("t")
    ref = pdf.groupby("k")["x"].transform(lambda s: s.ewm(com=0.5).mean())
    assert np.allclose(out["x_ewm"].astype(float).to_numpy(), ref.to_numpy(), atol=1e-12, equal_nan=True)


def test_positions_and_shift(spark):
    rng = np.random.default_rng(1)
    n = 500
    pdf = pd.DataFrame({"t": rng.permutation(n * 2)[:n].astype("int64"), "k": rng.integers(0, 5, n),
                        "x": rng.normal(size=n)})
    df = spark.createDataFrame(pdf)
    pos = series.add_position(df, "t", "k", n_buckets=9).toPandas()
    exp = pdf.assign(pos=pdf.groupby("k")["t"].rank(method="first").astype(int) - 1)
    m = pos.merge(exp, on=["t", "k"])
    assert (m["pos_x"] == m["pos_y"]).all()
    s = series.shift(df, {"lag2": ("x", 2), "lead1": ("x", -1)}, "t", "k", block_rows=11).toPandas()
    ps = pdf.sort_values("t")
    ps["lag2"] = ps.groupby("k")["x"].shift(2)
    ps["lead1"] = ps.groupby("k")["x"].shift(-1)
    m = s.merge(ps, on=["t", "k"])
    assert np.allclose(m["lag2_x"].astype(float), m["lag2_y"], equal_nan=True)
    assert np.allclose(m["lead1_x"].astype(float), m["lead1_y"], equal_nan=True)


def test_expanding_split_sizes(spark):
    df = spark.range(8990).select(F.col("id").alias("pos"))
    f = series.add_folds(df, "expanding", 5).groupBy("fold").agg(F.min("pos").alias("start"), F.count("*").alias("n"))
    got = {r["fold"]: (r["start"], r["n"]) for r in f.collect()}
    assert got[0] == (0, 1500)
    assert [got[j][0] for j in range(1, 6)] == [1500, 2998, 4496, 5994, 7492]
    assert all(got[j][1] == 1498 for j in range(1, 6))
    df = spark.range(10000).select(F.col("id").alias("pos"))
    sizes = dict(series.add_folds(df, "expanding", 5).groupBy("fold").count().collect())
    assert sizes[0] == 1670 and all(sizes[j] == 1666 for j in range(1, 6))


def test_contiguous_folds(spark):
    df = spark.range(23).select(F.col("id").alias("pos"))
    sizes = dict(series.add_folds(df, "contiguous", 10).groupBy("fold").count().collect())
    assert [sizes[i] for i in range(10)] == [3, 3, 3, 2, 2, 2, 2, 2, 2, 2]


def test_early_stopping_patience(spark):
    # best at iteration 1, never beaten: stops at 51, keeps iteration 1
    vals = [0.011368, 0.0113677] + [0.01137 + i * 1e-7 for i in range(60)]
    pdf = pd.DataFrame({"it": np.arange(len(vals), dtype="int64"), "rmse": vals})
    r = series.early_stopping(spark.createDataFrame(pdf), "rmse", "it", patience=50).first()
    assert (r["stop_pos"], r["best_pos"], r["stopped"]) == (51, 1, True)


def test_sortedness(spark):
    pdf = pd.DataFrame({"i": np.arange(10, dtype="int64"), "v": [1, 2, 2, 3, 1, 5, 6, 7, 8, 9]})
    r = series.sortedness(spark.createDataFrame(pdf), "v", "i").first()
    assert r["n_unsorted"] == 1 and not r["is_sorted"]


def test_positions_ntz_independent_of_session_zone(spark):
    import datetime as dt
    base = dt.datetime(2024, 3, 10, 1, 0, 0)  # spans the US spring-forward hour
    rows = [(i, base + dt.timedelta(minutes=7 * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "i long, ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r["pos"] for r in series.add_position(df, "ts", n_buckets=6).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == list(range(40))


def test_halo_edges_and_block_bound(spark):
    df = spark.range(10).select(F.col("id").alias("pos"))
    h = series.with_halo(df, 4, before=1, after=2).collect()
    own = sorted((r["pos"], r["_blk"]) for r in h if not r["_halo"])
    halo = sorted((r["pos"], r["_blk"]) for r in h if r["_halo"])
    assert own == [(p, p // 4) for p in range(10)]
    # last row of a block -> next block; first two rows of blocks 1.. -> previous block
    assert halo == sorted([(3, 1), (7, 2), (4, 0), (5, 0), (8, 1), (9, 1)])
    with pytest.raises(ValueError):
        series.with_halo(df, 4, before=4)


def test_null_series_key_keeps_rows(spark):
    pdf = pd.DataFrame({"t": np.arange(12, dtype="int64"), "k": [None, 1.0] * 6, "x": np.arange(12.0)})
    df = spark.createDataFrame(pdf.astype({"k": "object"}).where(pd.notnull(pdf), None), "t long, k double, x double")
    pos = series.add_position(df, "t", "k", n_buckets=3)
    assert pos.count() == 12
    got = sorted((r["k"] is None, r["t"], r["pos"]) for r in pos.collect())
    assert [g[2] for g in got if g[0]] == list(range(6)) and [g[2] for g in got if not g[0]] == list(range(6))
    e = series.ewm(df, ["x"], "t", "k").collect()
    assert len(e) == 12 and all(r["x_ewm"] is not None for r in e)
    f = series.add_folds(pos, "contiguous", 2, partition_by="k")
    assert f.count() == 12


@pytest.mark.parametrize("nulls", ["first", "last"])
def test_positions_keep_null_tied_and_text_keys(spark, nulls):
    """Rows in = rows out with NULL order keys, one timestamp with most rows, and text keys."""
    rows = [(None if i % 7 == 0 else (5 if i % 3 else i), f"k{i:03d}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "t long, name string, i long").repartition(5)
    got = {r["i"]: r["pos"] for r in series.add_position(df, ["t", "name"], n_buckets=6, nulls=nulls).collect()}
    key = lambda r: ((r[0] is None) == (nulls == "last"), r[0] if r[0] is not None else 0, r[1])
    assert got == {r[2]: p for p, r in enumerate(sorted(rows, key=key))}
    named = {r["i"]: r["pos"] for r in series.add_position(df, "name", n_buckets=6).collect()}
    assert named == {i: i for i in range(300)}
    assert series.shift(df, {"before": ("i", 1)}, ["t", "name"]).count() == 300
    assert series.running_best(df, "i", ["t", "name"]).count() == 300


def test_ewm_leaves_other_columns_alone(spark):
    df = spark.createDataFrame([(i, 9007199254740993 if i % 2 else None, float(i)) for i in range(100)], "t long, big long, x double")
    out = series.ewm(df, ["x"], "t")
    assert {r["big"] for r in out.collect()} == {None, 9007199254740993}
