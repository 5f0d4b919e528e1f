"""Known answers (FIXTURES 4-5) and properties for the non-series operators."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.functions import rowwise, scalar
from marketflow.operators import evaluate, impute, joins, profile, schema
from marketflow.operators import scale
from marketflow.sources import io

# One sample row of the reference's test table (I and S groups, M11).
I_ROW = [0.306216931216931, 1.02575637127463, 0.0813492063492064, 0.478174603174603, 0.675626892422322,
         0.69973544973545, 0.256283068783069, 0.360449735449735, 0.676060977652112]
S_ROW = [0.294718644225946, 0.0857167792140139, -0.230132159589618, 0.272486772486772, -0.10689351649087,
         0.19973544973545, 0.409391534391534, 0.532717071849416, 0.744047619047619, 0.514550264550265,
         0.446428571428571, 0.466550931948929]
M11 = -0.236099720197407


def test_group_stats_known_row(spark):
    cols = {f"I{i + 1}": v for i, v in enumerate(I_ROW)} | {f"S{i + 1}": v for i, v in enumerate(S_ROW)}
    cols["M11"] = M11
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    g = rowwise.feature_groups(df.columns, ["I", "S"])
    r = rowwise.add_group_features(df, g, among=["I", "S"]).first()
    exp = {"I_mean": 0.506628137, "I_std": 0.289380767, "I_min": 0.081349206, "I_max": 1.025756371,
           "I_range": 0.944407165, "S_mean": 0.302443164, "S_std": 0.279902637, "S_min": -0.230132160,
           "S_max": 0.744047619, "S_range": 0.974179779}
    for k, v in exp.items():
        assert abs(r[k] - v) < 5e-9, k
    u = df.select(scalar.u1().alias("U1"), scalar.u2().alias("U2")).first()
    assert abs(u["U1"] - 0.719539440058) < 1e-11 and abs(u["U2"] + 0.361727700064) < 1e-11


def test_interaction_names():
    g = {k: [k + "1"] for k in rowwise.GROUP_PREFIXES}
    names = [f"{a}_{b}" for a, b in rowwise.interaction_names(g)]
    assert names == ["E_I", "E_M", "E_P", "E_S", "E_V", "I_M", "I_P", "I_S", "I_V", "M_P", "M_S", "M_V",
                     "P_S", "P_V", "S_V"]


def test_row_std_null_with_one_value(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    r = df.select(rowwise.row_std(["a", "b"]).alias("s"), rowwise.row_mean(["a", "b"]).alias("m")).collect()
    assert r[0]["s"] is None and r[0]["m"] == 1.0 and r[1]["m"] is None


def test_median_and_std_known(spark, monkeypatch):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x double")
    assert impute.exact_medians(df, ["x"])["x"] == 3.0
    st = profile.column_stats(df, "x").first()
    assert abs(st["std"] - 4.031128874) < 1e-9
    assert abs(profile.prediction_stats(df, "x").first()["std"] - 3.491060010) < 1e-9
    one = spark.createDataFrame([(5.0,)], "x double")
    assert profile.column_stats(one, "x").first()["std"] is None


def test_median_sketch_path_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=5001), np.full(300, 0.25)])
    pdf = pd.DataFrame({"x": v, "y": np.where(np.arange(len(v)) % 3 == 0, np.nan, v * 2)})
    df = spark.createDataFrame(pdf.where(pd.notnull(pdf), None)).repartition(7)
    monkeypatch.setattr(impute, "TARGET_VALUES", 200)  # force sketch bounds + selection
    m = impute.exact_medians(df, ["x", "y"])
    assert m["x"] == float(np.median(v))
    assert m["y"] == float(np.nanmedian(pdf["y"]))
    monkeypatch.setattr(impute, "SKETCH_ACCURACY", 40)  # wide first window: narrowing rounds
    m = impute.exact_medians(df, ["x", "y"])
    assert m["x"] == float(np.median(v))
    assert m["y"] == float(np.nanmedian(pdf["y"]))


def test_median_fill_all_null_column(spark):
    df = spark.createDataFrame([(0, 1, None, 1.0), (1, None, None, None), (2, 3, None, 5.0)],
                               "id long, a int, b double, c double")
    r = impute.median_fill(df, cols=["a", "b", "c"]).orderBy("id").collect()
    assert r[1]["a"] == 2.0 and r[1]["b"] is None and r[1]["c"] == 3.0 and r[0]["a"] == 1.0


def test_signal_known(spark):
    df = spark.createDataFrame([(-0.01,), (0.0,), (0.001,), (0.01,), (None,)], "p double")
    got = [r["s"] for r in df.select(scalar.ret_to_signal("p").alias("s")).collect()]
    assert got[:4] == pytest.approx([0.0, 1.0, 1.4, 2.0]) and got[4] is None


def test_blend_and_average(spark):
    w = evaluate.weights_frame(spark)
    sc = spark.createDataFrame([(1, "gbt_a", 1.0), (1, "gbt_b", 2.0), (1, "gbt_c", 3.0)], "id int, model string, pred double")
    assert evaluate.blend(sc, w, ["id"]).first()["blend"] == pytest.approx(1.9)
    f = spark.createDataFrame([(1, j, float(j)) for j in range(1, 6)], "id int, fold int, blend double")
    assert evaluate.fold_average(f, ["id"]).first()["prediction"] == 3.0
    with pytest.raises(ValueError):
        evaluate.weights_frame(spark, {"a": 0.5, "b": 0.4})


def test_mean_of_reference_fold_rmse(spark):
    m = spark.createDataFrame([(i, r, 0.0) for i, r in enumerate([0.012062, 0.009795, 0.013270, 0.008187, 0.011373])],
                              "fold int, rmse double, r2 double")
    assert evaluate.mean_metrics(m).first()["mean_rmse"] == pytest.approx(0.0109374)


def test_scaler_properties(spark):
    pdf = pd.DataFrame({"a": np.arange(10.0), "b": np.full(10, 3.0)})
    df = spark.createDataFrame(pdf)
    p = scale.fit_scaler(df, ["a", "b"])
    z = scale.apply_scaler(df, p).toPandas()
    assert abs(z["a"].mean()) < 1e-12 and abs(z["a"].std(ddof=0) - 1) < 1e-12
    assert (z["b"] == 0).all() and p.scale[1] == 1.0


def test_alignment_detects_problems(spark):
    exp = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "b int, id int")
    rcv = spark.createDataFrame([(1, 10), (1, 10), (2, 21), (3, 30)], "b int, id int")
    a = {r["b"]: r for r in joins.alignment(exp, rcv, "b", "id").collect()}
    assert a[1]["n_dup"] == 1 and a[1]["n_missing"] == 1 and a[1]["status"] != "ok"
    assert a[2]["n_extra"] == 1 and a[2]["n_missing"] == 1 and a[2]["error_type"] == 6
    assert a[3]["status"] == "ok" and a[3]["error_type"] is None
    rep = io.run_report(joins.alignment(exp, rcv, "b", "id")).first()
    assert rep["Succeeded"] is False and rep["ErrorName"] == "INVALID_SUBMISSION"


def test_csv_reader_nan_and_bad_values(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b,c\n1,NaN,true\nx,2.5,false\n,NA,\n")
    from pyspark.sql import types as T
    st = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()),
                       T.StructField("c", T.BooleanType())])
    pd_rows = io.read_csv(spark, str(p), st, "pandas").collect()
    assert [tuple(r) for r in pd_rows] == [(1, None, True), (None, 2.5, False), (None, None, None)]
    pl_rows = io.read_csv(spark, str(p), st, "polars").collect()
    assert pl_rows[2]["b"] is None and pl_rows[0]["b"] is None  # "NA" does not parse -> null, NaN -> null


def test_concat_relaxed_errors(spark):
    a = spark.createDataFrame([(1, 1)], "id long, p int")
    b = spark.createDataFrame([(2, 2.5)], "id long, p double")
    assert schema.concat_relaxed(a, b).schema["p"].dataType.simpleString() == "double"
    c = spark.createDataFrame([(3, "x")], "id long, p string")
    with pytest.raises(schema.ConcatError, match="types"):
        schema.concat_relaxed(a, c)
    d = spark.createDataFrame([(3, 1, 1)], "id long, p int, q int")
    with pytest.raises(schema.ConcatError, match="column counts"):
        schema.concat_relaxed(a, d)
    with pytest.raises(ValueError):
        schema.concat_strict(a, b)


def test_classify_error(spark):
    msgs = ['x "Exception calling application: boom" y', "No listener for predict was registered",
            "Failed to connect to server after waiting 5", "other"]
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    et, det = scalar.classify_error(F.col("m"))
    r = df.select(et.alias("t"), det.alias("d")).collect()
    assert [x["t"] for x in r] == [3, 4, 1, None]
    assert r[0]["d"] == "boom"


def test_elastic_net_param_check():
    from marketflow.operators.linear import PenaltyGrid
    with pytest.raises(ValueError):
        PenaltyGrid(l1_ratio=1.5)
    g = scalar.log_grid_values()
    assert len(g) == 100 and g[0] == pytest.approx(1e-4) and g[-1] == pytest.approx(1e2)


def test_one_row_batch_with_null_feature_gives_null(spark):
    """MOD12: per-batch featurisation without history drops a row whose
    feature is null (no EWM history), so that batch's prediction is NULL."""
    from marketflow.operators.linear import LinearModel
    from marketflow.operators.scale import ScalerParams
    from marketflow.plans import linear_signal as ls
    V = ls.MODEL_VARS
    fitted = ls.FittedLinear(ScalerParams(tuple(V), tuple(0.0 for _ in V), tuple(1.0 for _ in V)),
                             LinearModel(tuple(V), 0.001, tuple(0.0 for _ in V), 0.1, 0.0), tuple(V))
    cols = ["date_id", "target"] + ls.FEATURES.raw[2:]
    base = {c: 1.0 for c in ls.FEATURES.raw[2:]}
    r1 = [1, 0.0] + [base[c] for c in ls.FEATURES.raw[2:]]
    r2 = [2, 0.0] + [None if c == "E3" else base[c] for c in ls.FEATURES.raw[2:]]
    schema_ = ", ".join(["date_id long", "target double"] + [f"{c} double" for c in ls.FEATURES.raw[2:]])
    test = spark.createDataFrame([r1, r2], schema_)
    out = {r["date_id"]: r for r in ls.predict_batches(test, fitted).collect()}
    assert out[1]["prediction"] == pytest.approx(1.4) and out[2]["prediction"] is None
    # with history the null is filled from the past and the batch is scored
    hist = spark.createDataFrame([[0, 0.0] + [base[c] for c in ls.FEATURES.raw[2:]]], schema_)
    out = {r["date_id"]: r for r in ls.predict_batches(test, fitted, history=hist).collect()}
    assert out[2]["prediction"] == pytest.approx(1.4)


def test_keyed_scaler(spark):
    pdf = pd.DataFrame({"s": [0, 0, 0, 1, 1], "a": [1.0, 2.0, 3.0, 5.0, 5.0]})
    df = spark.createDataFrame(pdf)
    params = scale.fit_scaler_keyed(df, ["a"], ["s"])
    z = scale.apply_scaler_keyed(df, params, ["a"], ["s"]).orderBy("s", "a").toPandas()
    assert np.allclose(z["a"][:3], [-1.224744871, 0.0, 1.224744871]) and (z["a"][3:] == 0).all()


def test_zero_denominator_and_nan_at_load(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 0.0, 0.0)], "M11 double, I2 double, I9 double, I7 double, I1 double")
    r = df.select(scalar.u2(i2="I1").alias("u2"), scalar.u2().alias("u2b")).first()
    assert r["u2"] is None and r["u2b"] == pytest.approx(1.0 / (2.0 / 3))
    p = str(tmp_path / "n.parquet")
    spark.createDataFrame(pd.DataFrame({"a": [1.0, float("nan"), None]})).write.parquet(p)
    vals = sorted((r["a"] is None, r["a"]) for r in io.read_parquet(spark, p).collect())
    assert [v for _, v in vals] == [1.0, None, None]


def test_alignment_no_prediction(spark):
    exp = spark.createDataFrame([(1, 10), (2, 20)], "b int, id int")
    rcv = spark.createDataFrame([(1, 10, None), (2, 20, 0.5)], "b int, id int, p double")
    a = {r["b"]: r for r in joins.alignment(exp, rcv, "b", "id", pred_col="p").collect()}
    assert a[1]["status"] == "No prediction received" and a[1]["error_type"] == 6
    assert a[2]["status"] == "ok"


def test_semi_anti_join_and_report_success(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (3, "d")], "k int, v string")
    keys = spark.createDataFrame([(2,), (2,), (3,)], "k int")
    assert sorted(r["v"] for r in joins.semi_join(df, keys, "k").collect()) == ["b", "c", "d"]
    assert sorted(r["v"] for r in joins.semi_join(df, keys, "k", key_rows_bound=3).collect()) == ["b", "c", "d"]
    assert [r["v"] for r in joins.anti_join(df, keys, "k").collect()] == ["a"]
    exp = spark.createDataFrame([(1, 10), (2, 20)], "b int, id int")
    rep = io.run_report(joins.alignment(exp, exp, "b", "id")).first()
    assert rep["Succeeded"] is True and rep["ErrorType"] is None and rep["ErrorName"] is None


def test_median_of_many_ties(spark):
    """A 0/1 column, an all-equal column and a half-tied one, of 5 million rows: ties never raise."""
    from pyspark.sql import functions as F

    from marketflow.operators import impute
    i = F.col("id")
    df = spark.range(5_000_000).select((i % 2).cast("double").alias("half"), (i % 5 > 0).cast("double").alias("flag"),
                                       F.lit(7.0).alias("same"), F.when(i % 2 == 0, i.cast("double")).otherwise(-1.0).alias("mixed"))
    assert impute.exact_medians(df, ["half", "flag", "same", "mixed"]) == {"half": 0.5, "flag": 1.0, "same": 7.0, "mixed": -0.5}


def test_fold_metrics_and_blend_on_incomplete_scores(spark):
    """Rows without target or prediction do not count; duplicate, missing and unknown models give no blend."""
    from marketflow.operators import evaluate
    df = spark.createDataFrame([(1, 1.0, None), (1, 2.0, 1.0), (2, None, 1.0)], "fold int, y double, p double")
    got = {r["fold"]: (r["rmse"], r["r2"], r["n_excluded"]) for r in evaluate.fold_metrics(df, "y", "p", with_excluded=True).collect()}
    assert got == {1: (1.0, 0.0, 1), 2: (None, None, 1)}
    scores = spark.createDataFrame(
        [(1, "gbt_a", 1.0), (1, "gbt_b", 2.0), (1, "gbt_c", 3.0), (2, "gbt_a", 1.0), (2, "gbt_a", 2.0), (2, "gbt_b", 1.0),
         (3, "gbt_a", 1.0), (3, "gbt_b", None), (3, "gbt_c", 1.0), (4, "gbt_a", 1.0), (4, "gbt_b", 1.0), (4, "gbt_c", 1.0), (4, "x", 9.0)],
        "id int, model string, pred double")
    w = evaluate.weights_frame(spark)
    blended = {r["id"]: r["blend"] for r in evaluate.blend(scores, w, ["id"]).collect()}
    assert blended[2] is None and blended[3] is None and abs(blended[1] - 1.9) < 1e-12 and abs(blended[4] - 1.0) < 1e-12
    report = {r["model"]: tuple(r)[1:] for r in evaluate.blend_report(scores, w, ["id"]).collect()}
    assert report == {"gbt_a": (5, 0, 1, True), "gbt_b": (4, 1, 0, True), "gbt_c": (3, 0, 0, True), "x": (1, 0, 0, False)}


def test_alignment_null_ids_and_types(spark):
    from marketflow.operators import joins
    e = spark.createDataFrame([("a", 1), ("a", None), ("b", 2)], "b string, i long")
    same = {r["b"]: (r["n_missing"], r["n_extra"], r["status"]) for r in joins.alignment(e, e, "b", "i").collect()}
    assert same == {"a": (0, 0, "ok"), "b": (0, 0, "ok")}
    odd = e.selectExpr("b", "cast(i AS string) AS i", "array(1) AS p")
    assert {r["status"] for r in joins.alignment(e, odd, "b", "i").collect()} == {"Invalid row id type"}
    assert {r["status"] for r in joins.alignment(e, odd, "b", "i", "p").collect()} == {"Invalid prediction data type"}


def test_penalty_grid_checks_every_field():
    import pytest

    from marketflow.operators.linear import PenaltyGrid
    for wrong in ({"l1_ratio": 1.5}, {"cv": 1}, {"alphas": ()}, {"alphas": (0.0,)}, {"max_iter": 0}):
        with pytest.raises(ValueError):
            PenaltyGrid(**wrong)


def test_wide_moments_null_group(spark):
    from marketflow.operators import linear
    df = spark.createDataFrame([(None, 1.0, 2.0), (None, 2.0, 1.0), ("a", 3.0, 1.0)], "k string, x double, y double")
    for rows in (df, df.where("k IS NULL")):
        a, b = ({r["k"]: (r["n"], r["sx"], r["sxx"], r["sxy"]) for r in linear.moments(rows, ["x"], "y", ["k"], engine=e).collect()}
                for e in ("sql", "numpy"))
        assert a == b and None in a


def test_csv_inference(spark, tmp_path):
    from marketflow.sources import io
    (tmp_path / "a.csv").write_text("i,f,s,b,m,e\n1,1.5,x,true,3,\n-2,2,NA,False,NA,\n3,1e3,7,true,5,\n")
    kinds = lambda flavor: [f.dataType.simpleString() for f in io.read_csv(spark, str(tmp_path / "a.csv"), flavor=flavor).schema]
    assert kinds("pandas") == ["bigint", "double", "string", "boolean", "double", "double"]
    assert kinds("polars") == ["bigint", "double", "string", "boolean", "string", "string"]
    assert [r["m"] for r in io.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [3.0, None, 5.0]
