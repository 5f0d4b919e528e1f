"""Many series at once: one daily series per supplier nation.

``lineitem`` is first reduced to (supplier, day) partial sums -- a map-side
combined aggregation, so a supplier holding a third of all rows leaves at most
one row per day -- then joined to ``supplier`` and summed per (nation, day).
The next-day return comes from a keyed lead (halo blocks per nation).

The keyed flow then runs every series in parallel: EWM fill per nation, a
contiguous 10-fold split per nation, a z-score per nation and one elastic net
per nation (moments grouped by (nation, fold)).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.operators import linear, schema, series
from marketflow.operators.scale import apply_scaler_keyed, fit_scaler_keyed
from marketflow.plans.materialize import materialize
from marketflow.plans.panel import ORIGIN
from marketflow.sources.io import read_table

KEY = "nation"
FEATURES = ["avg_price", "avg_qty", "avg_disc", "n_lines"]
EWM_COM = 0.5
CV_FOLDS = 10


def nation_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    li = read_table(spark, sf_dir, "lineitem").select(
        F.datediff(c("l_shipdate").cast("date"), F.lit(ORIGIN).cast("date")).cast("long").alias("date_id"),
        "l_suppkey", F.round(c("l_extendedprice") * 100).cast("long").alias("pc"),
        c("l_quantity").cast("long").alias("q"), F.round(c("l_discount") * 100).cast("long").alias("dc"))
    per_sup = li.groupBy("l_suppkey", "date_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pc").alias("sp"),
                                                      F.sum("q").alias("sq"), F.sum("dc").alias("sd"))
    sup = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"),
                                                        F.col("s_nationkey").cast("int").alias(KEY))
    d = per_sup.join(sup, "l_suppkey").groupBy(KEY, "date_id").agg(
        F.sum("n").alias("n"), F.sum("sp").alias("sp"), F.sum("sq").alias("sq"), F.sum("sd").alias("sd"))
    did, nat = c("date_id"), c(KEY)
    f = d.select(KEY, "date_id",
                 (c("sp") / c("n") / 100).alias("avg_price"),
                 F.when((did + nat) % 13 != 0, c("sq") / c("n")).alias("avg_qty"),
                 F.when(~((did % 97) < nat % 5), c("sd") / c("n") / 100).alias("avg_disc"),
                 c("n").cast("double").alias("n_lines"))
    f = series.shift(f, {"_next": ("avg_price", -1)}, "date_id", KEY)
    return f.withColumn("target", c("_next") / c("avg_price") - 1).drop("_next")


def build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(nation_daily(spark, sf_dir))


def fit_per_nation(panel: DataFrame, params: linear.PenaltyGrid | None = None) -> DataFrame:
    """EWM fill (WIN3), drop nulls (FLT3), positions + contiguous folds (WIN1,
    WIN5), z-score (AGG14/MOD1) and elastic net CV (MOD2/MOD3), all per nation."""
    filled = series.ewm(panel, FEATURES, "date_id", KEY, com=EWM_COM, null_mode="carry", fill=True)
    data = materialize(schema.drop_nulls(filled, ["target", *FEATURES]))
    sc = fit_scaler_keyed(data, FEATURES, [KEY])
    z = apply_scaler_keyed(data, sc, FEATURES, [KEY])
    z = series.add_folds(series.add_position(z, "date_id", KEY), "contiguous", CV_FOLDS, partition_by=KEY)
    return linear.elastic_net_cv(materialize(z), FEATURES, "target", "fold", [KEY], params)
