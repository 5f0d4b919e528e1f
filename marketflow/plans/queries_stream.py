"""Registered queries: batch scoring, stream replay and checks (ST1-ST5,
UDF1-UDF4, JOIN2, SET4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from marketflow.functions.scalar import SignalParams, clip
from marketflow.operators import joins
from marketflow.plans.oracle import with_panel
from marketflow.plans.registry import panel, query, table
from marketflow.streaming import score as st

SIGNAL = SignalParams()


def _signal_predict(pdf: pd.DataFrame) -> float:
    """A user predict as in the reference protocol: one batch (one date) in,
    one scalar out -- the clipped position signal of the batch's first row."""
    x = pdf["lagged_forward_returns"].iloc[0]
    if pd.isna(x):
        return float("nan")
    return float(min(max(x * SIGNAL.signal_multiplier + 1.0, SIGNAL.min_signal), SIGNAL.max_signal))


@query("udf1_udf2_st5_predict_batches", with_panel("""
SELECT date_id AS batch_id, CAST(row_number() OVER (ORDER BY date_id) - 1 AS INTEGER) AS batch_index,
       count(*) OVER (PARTITION BY date_id) AS n_rows,
       CASE WHEN lagged_forward_returns IS NOT NULL
            THEN least(greatest(lagged_forward_returns * 400.0 + 1.0, 0.0), 2.0) END AS prediction
FROM panel"""))
def q_batches(spark, sf_dir):
    """UDF1 pandas predict per batch (one date per batch, scalar -> named
    column, PRJ18/SET4), UDF2 batches from a DataFrame, ST5 batch counter."""
    p = panel(spark, sf_dir).select("date_id", "lagged_forward_returns")
    preds = st.predict_batches(p, "date_id", _signal_predict, "batch_id long, prediction double",
                               order_by="date_id")
    preds = preds.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))
    counts = p.groupBy(F.col("date_id").alias("batch_id")).agg(F.count(F.lit(1)).alias("n_rows"))
    idx = st.batch_index(p.withColumnRenamed("date_id", "batch_id"), "batch_id", "batch_id")
    return idx.join(counts, "batch_id").join(preds, "batch_id").select("batch_id", "batch_index", "n_rows", "prediction")


def _batch_score(bdf):
    """Scorer of one micro-batch, Spark-native (any batch size): rows and the
    first value in time order per batch id."""
    return bdf.groupBy(F.col("event_type").alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min_by("value", "ts").alias("prediction"))


@query("st1_st2_stream_replay", """
SELECT event_type AS batch_id, count(*) AS n_rows, arg_min(value, ts) AS prediction,
       row_number() OVER (ORDER BY event_type) - 1 AS epoch, row_number() OVER (ORDER BY event_type) - 1 AS batch_index
FROM events GROUP BY event_type""")
def q_replay(spark, sf_dir):
    """ST1 replay one batch per epoch in id order through a file stream
    (availableNow), ST2 score each micro-batch in foreachBatch and append to a
    Parquet sink, ST3 check each epoch's batch ids."""
    ev = table(spark, sf_dir, "events")
    path = st.write_batches(ev, "event_type")  # UDF3: the path is a plain argument

    def check(rows, scores):
        batch = rows.select(F.col("event_type").alias("batch_id")).distinct()
        return joins.alignment(batch.select("batch_id", F.col("batch_id").alias("id")),
                               scores.select("batch_id", F.col("batch_id").alias("id"), "prediction"), "batch_id", "id", "prediction")

    out = st.replay(spark, path, _batch_score, check_fn=check)
    return out.select("batch_id", "n_rows", "prediction", F.col("epoch").cast("long").alias("epoch"),
                      F.col("batch_index").cast("long").alias("batch_index"))


@query("st3_st4_join2_row_checks", """
WITH p AS (SELECT *, CASE WHEN value IS NOT NULL THEN least(greatest(value / 100.0, 0.0), 2.0) END AS prediction FROM events),
k AS (SELECT event_type, event_id, count(*) AS n FROM p GROUP BY ALL),
c AS (SELECT coalesce(e.event_type, r.event_type) AS batch_id, coalesce(e.n, 0) AS x, coalesce(r.n, 0) AS r
      FROM k e FULL JOIN k r ON e.event_type = r.event_type AND e.event_id = r.event_id),
a AS (SELECT batch_id, CAST(sum(x) AS BIGINT) AS n_expected, CAST(sum(r) AS BIGINT) AS n_received,
      count(*) FILTER (WHERE x > 0 AND r = 0) AS n_missing, count(*) FILTER (WHERE x = 0 AND r > 0) AS n_extra,
      count(*) FILTER (WHERE r > 1) AS n_dup FROM c GROUP BY batch_id),
f AS (SELECT event_type AS batch_id, count(*) FILTER (WHERE NOT coalesce(value >= 0, false)) AS n_fail_non_negative,
      count(*) FILTER (WHERE NOT coalesce(prediction >= 0 AND prediction <= 2, false)) AS n_fail_signal_range
      FROM p GROUP BY event_type)
SELECT a.*, CASE WHEN n_missing + n_extra + n_dup > 0 THEN 'Invalid predictions: row ids do not match' ELSE 'ok' END AS status,
       CASE WHEN n_missing + n_extra + n_dup > 0 THEN 6 END AS error_type, n_fail_non_negative, n_fail_signal_range
FROM a JOIN f USING (batch_id)""")
def q_checks(spark, sf_dir):
    """Row-level predictions (UDF1 row form, mapInPandas), JOIN2 ids zipped by
    key, ST3 alignment of expected vs received ids per batch, ST4 custom checks."""
    ev = table(spark, sf_dir, "events")

    def predict(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"batch_id": pdf["event_type"].values, "event_id": pdf["event_id"].values,
                             "prediction": (pdf["value"] / 100.0).clip(0, 2)})

    preds = st.predict_rows(ev.select("event_type", "event_id", "value"), predict,
                            "batch_id string, event_id long, prediction double")
    expected = ev.select(F.col("event_type").alias("batch_id"), "event_id")
    align = joins.alignment(expected, preds.select("batch_id", "event_id"), "batch_id", "event_id")
    rows = joins.zip_by_key(ev.select("event_id", "value"), preds, "event_id")
    checks = st.custom_checks(rows, "batch_id", {
        "non_negative": F.col("value") >= 0,
        "signal_range": clip(F.col("prediction"), 0, 2) == F.col("prediction"),
    })
    return align.join(checks, "batch_id")
