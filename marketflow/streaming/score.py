"""Ordered micro-batch scoring (ST1-ST5) and the user predict surface (UDF1-UDF3).

Batch form (the scalable default): the user's pandas ``predict`` runs once per
batch with a declared output schema, all batches in parallel, ids travelling
with the rows; row-wise predictors run on plain Arrow chunks (no grouping).

Stream form (fidelity to the one-batch-at-a-time protocol): batches are numbered in
id order and staged by number; a file source over one small control file per
batch gives one epoch per batch (``availableNow``), and epoch k scores the staged
rows of batch k, whatever order the control files arrive in and over however
many files a large batch is spread. Scores go to a Parquet folder per epoch.
Writes are idempotent (overwrite of ``epoch=N``), and the checkpoint lives in the
shared checkpoint folder, so a restarted query neither loses nor duplicates a batch.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.operators.series import add_position, sortedness
from marketflow.plans.materialize import materialize
from marketflow.session import scratch_path

DEFAULT_ID = "batch_id"
DEFAULT_TARGET = "prediction"


# --------------------------------------------------------- UDF1: predict hook

def _to_frame(result, batch_id, id_col: str, target: str) -> pd.DataFrame:
    """PRJ18 conversions: scalar / Series / DataFrame -> named frame with the id."""
    if isinstance(result, pd.DataFrame):
        out = result.copy()
    elif isinstance(result, pd.Series):
        out = result.to_frame(result.name or target)
    else:
        out = pd.DataFrame({target: [result]})
    if id_col not in out.columns:
        out.insert(0, id_col, batch_id)
    return out


class BatchTooLarge(ValueError):
    pass


def check_batch_sizes(df: DataFrame, batch_col: str, limit: int) -> int:
    """Largest batch size (one aggregation, one number to the driver); raises
    when it exceeds ``limit``."""
    m = df.groupBy(batch_col).count().agg(F.max("count")).first()[0] or 0
    if m > limit:
        raise BatchTooLarge(f"largest batch has {m} rows > {limit}; score it with predict_rows "
                            "or a DataFrame-level scorer")
    return m


def predict_batches(df: DataFrame, batch_col: str, predict: Callable[[pd.DataFrame], object],
                    out_schema: str | T.StructType, order_by: str | None = None,
                    id_col: str = DEFAULT_ID, target: str = DEFAULT_TARGET) -> DataFrame:
    """UDF1 in batch form: ``predict(batch_pdf)`` per batch, all batches in
    parallel (``mapInPandas`` over batch-sorted partitions: one Python call
    per Arrow chunk, not per batch).

    The protocol gives ``predict`` a whole batch (one time step) in one frame, so
    a batch must fit one task; ``check_batch_sizes`` tells before a run, and
    ``predict_rows`` has no such unit. Rows whose batch id is NULL are a batch
    of their own. ``out_schema`` must contain ``id_col``.
    """
    order = [batch_col] + ([order_by] if order_by else [])
    # rows of a batch become contiguous inside one partition; the Python side
    # walks the sorted Arrow chunks and calls predict once per batch, holding
    # the pieces of the batch that is still open
    d = df.repartition(batch_col).sortWithinPartitions(*order)

    def score(batch: pd.DataFrame) -> pd.DataFrame:
        bid = batch[batch_col].iloc[0]
        return _to_frame(predict(batch.reset_index(drop=True)), None if pd.isna(bid) else bid, id_col, target)

    def run(it):
        held: list[pd.DataFrame] = []
        for pdf in it:
            if pdf.empty:
                continue
            key = pdf[batch_col]
            new = (key != key.shift()) & ~(key.isna() & key.shift().isna())
            new.iloc[0] = False
            if held:
                a, b = held[-1][batch_col].iloc[-1], key.iloc[0]
                new.iloc[0] = not (a == b or (pd.isna(a) and pd.isna(b)))
            cuts = [0, *[i for i, flag in enumerate(new) if flag and i], len(pdf)]
            outs = []
            if held and new.iloc[0]:
                outs.append(score(pd.concat(held, ignore_index=True)))
                held = []
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if k:
                    outs.append(score(pd.concat(held, ignore_index=True)))
                    held = []
                held.append(pdf.iloc[a:b])
            if outs:
                yield pd.concat(outs, ignore_index=True)
        if held:
            yield score(pd.concat(held, ignore_index=True))

    return d.mapInPandas(run, out_schema)


def predict_rows(df: DataFrame, predict: Callable[[pd.DataFrame], pd.DataFrame],
                 out_schema: str | T.StructType) -> DataFrame:
    """UDF1 for row-wise predictors: ``predict`` maps any chunk of rows to one
    output row per input row (ids included). Runs with ``mapInPandas`` on Arrow
    batches -- no grouping, so no batch size limit and no shuffle."""
    def run(it):
        for pdf in it:
            yield predict(pdf)
    return df.mapInPandas(run, out_schema)


# ------------------------------------------------- ST1: batches in id order

INDEX = "batch_index"


def batch_index(df: DataFrame, batch_col: str, order_col: str) -> DataFrame:
    """ST5/SET5: batch counter = rank of the batch's first appearance (positions
    on the one-row-per-batch table, without a one-task window)."""
    first = df.groupBy(batch_col).agg(F.min(order_col).alias("_first"))
    pos = add_position(first, ["_first", batch_col], pos_col=INDEX)
    return pos.select(batch_col, F.col(INDEX).cast("int").alias(INDEX))


def write_batches(df: DataFrame, batch_col: str, path: str | None = None) -> str:
    """ST1 source side: the rows by batch number (``rows``; a large batch is spread
    over several files) and one control file per batch (``control``)."""
    spark = df.sparkSession
    path = path or scratch_path(spark, "batches")
    ids = materialize(add_position(df.select(batch_col).distinct(), batch_col, pos_col=INDEX), "batch-ids")
    left, right = df.alias("l"), ids.select(F.col(batch_col).alias("_id"), INDEX).alias("r")
    rows = left.join(right, F.col(f"l.{batch_col}").eqNullSafe(F.col("_id"))).drop("_id")
    rows.hint("rebalance", INDEX).write.mode("overwrite").partitionBy(INDEX).parquet(f"{path}/rows")
    ids.select(F.col(INDEX).alias("n"), INDEX).repartition(INDEX).write.mode("overwrite").partitionBy(INDEX).parquet(f"{path}/control")
    return path


def replay(spark: SparkSession, path: str, score_fn: Callable[[DataFrame], DataFrame], sink: str | None = None,
           checkpoint: str | None = None, check_fn: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """ST1 + ST2 + ST5: one epoch per batch, in id order; each epoch's rows are
    scored with ``score_fn`` (a DataFrame -> DataFrame function, e.g. a
    ``predict_batches`` call) and written with ``epoch`` and ``batch_index``.
    ``check_fn(rows, scores)``, if given, returns the ST3 rows of the batch; a row whose
    ``status`` is not "ok" ends the run. Returns the sink as a DataFrame."""
    sink = sink or scratch_path(spark, "scores")
    checkpoint = checkpoint or scratch_path(spark, "stream-ckpt")
    source = (spark.readStream.schema(f"n long, {INDEX} long").option("maxFilesPerTrigger", 1)
              .option("basePath", f"{path}/control").parquet(f"{path}/control"))
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")

    def each(_: DataFrame, epoch_id: int):
        batch = rows.where(F.col(INDEX) == int(epoch_id))  # one folder: pruned
        out = score_fn(batch.drop(INDEX))
        to = f"{sink}/epoch={int(epoch_id)}"
        out.withColumn(INDEX, F.lit(int(epoch_id))).write.mode("overwrite").parquet(to)
        if check_fn:
            bad = check_fn(batch.drop(INDEX), spark.read.parquet(to)).where("status <> 'ok'").first()
            if bad:
                raise ValueError(f"batch {int(epoch_id)}: {bad['status']}")

    q = (source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", sink).parquet(sink)


TRIGGER = "trigger"


def write_triggers(df: DataFrame, batch_col: str, ids_per_trigger: int, arrival_col: str | None = None, path: str | None = None) -> str:
    """ST1 source side for many ids: consecutive batch ids share a trigger, so a million ids are not a million folders
    and micro-batches. Writes the rows by trigger, one control file per trigger, and the ids with their numbers.

    ``arrival_col``: the order in which the rows came; ids that do not rise along it are an error."""
    spark = df.sparkSession
    if arrival_col:
        wrong = sortedness(df, batch_col, arrival_col).first()
        if wrong and not wrong["is_sorted"]:
            raise ValueError(f"{batch_col} falls in {wrong['n_unsorted']} rows along {arrival_col}")
    path = path or scratch_path(spark, "triggers")
    ids = add_position(df.select(batch_col).distinct(), batch_col, pos_col=INDEX).withColumn(TRIGGER, F.floor(F.col(INDEX) / ids_per_trigger))
    ids.write.mode("overwrite").parquet(f"{path}/ids")
    ids = spark.read.schema(ids.schema).parquet(f"{path}/ids")
    named = ids.select(F.col(batch_col).alias("_id"), TRIGGER)
    rows = df.join(named, F.col(batch_col).eqNullSafe(F.col("_id"))).drop("_id")
    rows.hint("rebalance", TRIGGER).write.mode("overwrite").partitionBy(TRIGGER).parquet(f"{path}/rows")
    per = ids.groupBy(TRIGGER).agg(F.count(F.lit(1)).alias("n"))
    per.repartition(TRIGGER).write.mode("overwrite").partitionBy(TRIGGER).parquet(f"{path}/control")
    return path


def replay_triggers(spark: SparkSession, path: str, batch_col: str, score_fn: Callable[[DataFrame], DataFrame], sink: str | None = None,
                    checkpoint: str | None = None) -> DataFrame:
    """ST1 + ST2 + ST5 over ``write_triggers``: one epoch per trigger, in id order; ``score_fn`` gets the rows of all ids of
    the trigger and returns one row for each id (such as a fitted model's ``predict_batches``). Every epoch is checked
    (ST3): an id without a score, twice, or unknown ends the run. Returns the scores with ``epoch`` and ``batch_index``."""
    sink = sink or scratch_path(spark, "scores")
    source = (spark.readStream.schema(f"n long, {TRIGGER} long").option("maxFilesPerTrigger", 1)
              .option("basePath", f"{path}/control").parquet(f"{path}/control"))
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    ids = spark.read.parquet(f"{path}/ids")

    def each(_: DataFrame, epoch_id: int):
        k = int(epoch_id)
        scores = materialize(score_fn(rows.where(F.col(TRIGGER) == k).drop(TRIGGER)), "epoch")  # one folder: pruned
        own = ids.where(F.col(TRIGGER) == k).select(F.col(batch_col).alias("_id"), INDEX)
        got = scores.groupBy(F.col(batch_col).alias("_got")).agg(F.count(F.lit(1)).alias("n"))
        bad = own.join(got, F.col("_id").eqNullSafe(F.col("_got")), "full").where(f"n IS NULL OR n > 1 OR {INDEX} IS NULL").count()
        if bad:
            raise ValueError(f"epoch {k}: {bad} ids without exactly one score")
        scores.join(own, F.col(batch_col).eqNullSafe(F.col("_id"))).drop("_id").write.mode("overwrite").parquet(f"{sink}/epoch={k}")

    q = (source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.option("basePath", sink).parquet(sink)


# -------------------------------------------------------------- ST3 / ST4

def custom_checks(df: DataFrame, batch_col: str, checks: dict[str, Column]) -> DataFrame:
    """ST4: user boolean Columns evaluated per row; failures counted per batch."""
    return df.groupBy(batch_col).agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(f"n_fail_{n}")
                                       for n, c in checks.items()])
