"""ST1/ST2: the stream replay gives the batch result; UDF1 conversions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketflow.streaming import score as st

SF = "/root/testdata/sf0.001"


def test_replay_equals_batch(spark):
    from marketflow.plans.queries_stream import _batch_score
    ev = spark.read.parquet(f"{SF}/events.parquet")
    path = st.write_batches(ev, "event_type")
    streamed = st.replay(spark, path, _batch_score)
    assert streamed.select("epoch").distinct().count() == ev.select("event_type").distinct().count()
    a = sorted(tuple(r) for r in streamed.select("batch_id", "n_rows", "prediction").collect())
    b = sorted(tuple(r) for r in _batch_score(ev).collect())
    assert a == b


def test_predict_conversions_and_size_guard(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 5.0)], "b long, v double")
    scal = st.predict_batches(df, "b", lambda p: float(p["v"].sum()), "batch_id long, prediction double")
    assert sorted(tuple(r) for r in scal.collect()) == [(1, 3.0), (2, 5.0)]
    ser = st.predict_batches(df, "b", lambda p: pd.Series(p["v"].to_numpy() * 2),
                             "batch_id long, prediction double")
    assert sorted(r["prediction"] for r in ser.collect()) == [2.0, 4.0, 10.0]
    with pytest.raises(st.BatchTooLarge):
        st.check_batch_sizes(df, "b", 1)
    rows = st.predict_rows(df, lambda p: p.assign(prediction=p["v"] + 1)[["b", "prediction"]],
                           "b long, prediction double")
    assert sorted(r["prediction"] for r in rows.collect()) == [2.0, 3.0, 6.0]


def test_batch_index_first_appearance(spark):
    df = spark.createDataFrame([(0, "c"), (1, "a"), (2, "c"), (3, "b")], "pos long, k string")
    idx = {r["k"]: r["batch_index"] for r in st.batch_index(df, "k", "pos").collect()}
    assert idx == {"c": 0, "a": 1, "b": 2}


def test_batches_spanning_arrow_chunks(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    b = rng.integers(0, 7, 200)
    pdf = pd.DataFrame({"b": b.astype("int64"), "t": np.arange(200, dtype="int64"), "v": rng.normal(size=200)})
    df = spark.createDataFrame(pdf).repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = st.predict_batches(df, "b", lambda p: float(p["v"].iloc[0] * 1000 + len(p)),
                                 "batch_id long, prediction double", order_by="t").toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    exp = pdf.sort_values("t").groupby("b").apply(lambda g: g["v"].iloc[0] * 1000 + len(g))
    got = got.set_index("batch_id")["prediction"].sort_index()
    assert len(got) == 7 and np.allclose(got.to_numpy(), exp.sort_index().to_numpy())


def test_null_batch_is_a_batch(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (2, 5.0)], "b long, v double")
    got = st.predict_batches(df, "b", lambda p: float(p["v"].sum()), "batch_id long, prediction double")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == [(2, 5.0), (None, 3.0)]


def test_replay_in_id_order_with_a_spread_batch(spark):
    """Eight ids, one with most of the rows, partition coalescing off: epochs follow the ids."""
    df = spark.range(4000).select(F.when(F.col("id") % 4 > 0, F.lit(3)).otherwise((F.col("id") / 4 % 8).cast("int")).alias("b"), "id")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = st.write_batches(df, "b")
        out = st.replay(spark, path, lambda d: d.groupBy("b").agg(F.count("*").alias("n")))
        got = [tuple(r) for r in out.select("epoch", "batch_index", "b", "n").orderBy("epoch").collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert [(e, i, b) for e, i, b, _ in got] == [(k, k, k) for k in range(8)] and sum(r[3] for r in got) == 4000


def test_failed_check_ends_the_replay(spark):
    from marketflow.operators import joins
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "b long, i long")
    path = st.write_batches(df, "b")
    with pytest.raises(Exception, match="Invalid predictions"):
        st.replay(spark, path, lambda d: d.where("i <> 11").select("b", "i"),
                  check_fn=lambda rows, scores: joins.alignment(rows, scores, "b", "i"))


def test_many_ids_per_trigger(spark):
    from marketflow.streaming import score as st

    data = [(k // 3 if k < 60 else None, k) for k in range(63)]
    df = spark.createDataFrame(data, "id bigint, arrival int").repartition(3)
    seen = []

    def score(batch):
        seen.append(sorted(r[0] is None or r[0] for r in batch.select("id").distinct().collect()))
        return batch.groupBy("id").agg(F.count("*").alias("n"))

    path = st.write_triggers(df, "id", 8, "arrival")
    got = sorted(((r.batch_index, r.epoch, r.id, r.n) for r in st.replay_triggers(spark, path, "id", score).collect()))
    assert got == [(k, k // 8, k if k < 20 else None, 3) for k in range(21)]
    assert len(seen) == 3  # triggers, not ids


def test_triggers_want_rising_ids_and_one_score_each(spark):
    from marketflow.streaming import score as st

    df = spark.createDataFrame([(5, 0), (4, 1)], "id bigint, arrival int")
    with pytest.raises(ValueError):
        st.write_triggers(df, "id", 2, "arrival")
    path = st.write_triggers(df, "id", 2)
    with pytest.raises(Exception, match="without exactly one score"):
        st.replay_triggers(spark, path, "id", lambda b: b.where("id = 5").select("id"))
