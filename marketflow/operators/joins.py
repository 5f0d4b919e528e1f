"""Joins (JOIN1-JOIN3).

No positional zips: ids travel with the rows and every join is an equi join,
so the scores of a 1000-executor run line up whatever the partitioning.
The broadcast side of a semi join is only forced when its size is bounded;
otherwise AQE decides at runtime from the shuffle statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes below which a key set may be broadcast explicitly.
BROADCAST_MAX_BYTES = 64 << 20


def semi_join(df: DataFrame, keys: DataFrame, on, key_rows_bound: int | None = None) -> DataFrame:
    """JOIN1 / FLT2: rows of ``df`` whose key is in ``keys`` (``is_in``).

    Pass ``key_rows_bound`` when the key side has a proven bound on its rows: where
    that many keys of the columns' types take at most BROADCAST_MAX_BYTES (keys of
    unbounded types never do), it is broadcast; otherwise the planner/AQE picks.
    """
    # no distinct: a semi join ignores duplicate keys, and a distinct would add
    # a shuffle of the key side
    k = keys.select(*([on] if isinstance(on, str) else on))
    bounded = all(isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DatetimeType)) for f in k.schema.fields)
    if key_rows_bound is not None and bounded and key_rows_bound * 16 * len(k.columns) <= BROADCAST_MAX_BYTES:
        k = F.broadcast(k)
    return df.join(k, on=on, how="left_semi")


def anti_join(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on=on, how="left_anti")


def zip_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JOIN2: the positional zip of ids and predictions, as an inner equi join
    on the row id that travelled with every row."""
    return left.join(right, on=key, how="inner")


def alignment(expected: DataFrame, received: DataFrame, batch_col: str, id_col: str,
              pred_col: str | None = None) -> DataFrame:
    """JOIN3 / ST3: per batch, expected / received / missing / extra /
    duplicated ids and a status. With ``pred_col``, a batch whose received
    predictions are all NULL fails with "No prediction received".

    ``expected`` and ``received`` hold (batch, id) rows. Both are counted per
    (batch, id) in one grouping (NULL ids are equal to each other), so a
    duplicated id shows as one row with ``n_rcv > 1``. Predictions that are
    not numbers or booleans, and ids of another type than expected, fail every
    batch they are received for.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    val = F.col(pred_col).isNotNull().cast("long") if pred_col else one
    e = expected.select(batch_col, id_col, one.alias("x"), none.alias("r"), none.alias("v"))
    r = received.select(batch_col, F.col(id_col).cast(expected.schema[id_col].dataType).alias(id_col),
                        none.alias("x"), one.alias("r"), val.alias("v"))
    j = e.unionByName(r).groupBy(batch_col, id_col).agg(
        F.sum("x").alias("n_exp"), F.sum("r").alias("n_rcv"), F.sum("v").alias("n_val"))
    wrong_id = received.schema[id_col].dataType != expected.schema[id_col].dataType
    wrong_pred = bool(pred_col) and not isinstance(received.schema[pred_col].dataType, (T.NumericType, T.BooleanType))
    n_exp, n_rcv = F.coalesce("n_exp", F.lit(0)), F.coalesce("n_rcv", F.lit(0))
    per = j.groupBy(batch_col).agg(
        F.sum(n_exp).cast("long").alias("n_expected"),
        F.sum(n_rcv).cast("long").alias("n_received"),
        F.count_if((n_exp > 0) & (n_rcv == 0)).cast("long").alias("n_missing"),
        F.count_if((n_exp == 0) & (n_rcv > 0)).cast("long").alias("n_extra"),
        F.count_if(n_rcv > 1).cast("long").alias("n_dup"),
        F.sum(F.coalesce("n_val", F.lit(0))).cast("long").alias("_n_val"),
    )
    got = F.col("n_received") > 0
    status = (F.when(got & (F.col("_n_val") == 0), F.lit("No prediction received"))
              .when(got & F.lit(wrong_pred), F.lit("Invalid prediction data type"))
              .when(got & F.lit(wrong_id), F.lit("Invalid row id type"))
              .when(F.col("n_expected") == 0, F.lit("Missing row IDs for batch"))
              .when(F.col("n_received") != F.col("n_expected"),
                    F.format_string("Invalid predictions: expected %d rows but received %d",
                                    F.col("n_expected"), F.col("n_received")))
              .when((F.col("n_missing") > 0) | (F.col("n_extra") > 0) | (F.col("n_dup") > 0),
                    F.lit("Invalid predictions: row ids do not match"))
              .otherwise(F.lit("ok")))
    etype = (F.when(status == "No prediction received", F.lit(6))
             .when(F.col("n_expected") == 0, F.lit(5))
             .when(status != "ok", F.lit(6)))
    return per.withColumn("status", status).withColumn("error_type", etype.cast("int")).drop("_n_val")
