"""Z-score scaling (AGG14 fit, MOD1 apply).

Fit = one aggregation (mean and POPULATION std of every column, per series
when keyed). Unkeyed parameters are one row (bounded by the column count) and
become literals in the apply expression; keyed parameters are joined on the
series keys. A zero std scales by 1, as the reference's scaler does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.operators.series import _keyed_join


@dataclass(frozen=True)
class ScalerParams:
    columns: tuple[str, ...]
    mean: tuple[float | None, ...]
    scale: tuple[float, ...]

    def as_rows(self):
        return [(c, m, s) for c, m, s in zip(self.columns, self.mean, self.scale)]


def fit_scaler(df: DataFrame, cols: list[str]) -> ScalerParams:
    """AGG14: mean and population std per column in one pass."""
    row = df.agg(*[F.avg(F.col(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    means = tuple(row[f"m{i}"] for i in range(len(cols)))
    scales = tuple((row[f"s{i}"] if row[f"s{i}"] not in (None, 0.0) else 1.0) for i in range(len(cols)))
    return ScalerParams(tuple(cols), means, scales)


def scaler_frame(spark, params: ScalerParams) -> DataFrame:
    return spark.createDataFrame(params.as_rows(), "column string, mean double, scale double")


def apply_scaler(df: DataFrame, params: ScalerParams) -> DataFrame:
    """MOD1: (x - mean) / scale for every fitted column; other columns untouched."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s)
                           for c, m, s in zip(params.columns, params.mean, params.scale)})


def fit_scaler_keyed(df: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """AGG14 per series: one row per series with ``{c}__mean`` / ``{c}__scale``."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__sd")]
    g = df.groupBy(*keys).agg(*aggs)
    return g.select(*keys, *[x for c in cols for x in (
        F.col(f"{c}__mean"),
        F.when((F.col(f"{c}__sd").isNull()) | (F.col(f"{c}__sd") == 0), F.lit(1.0))
         .otherwise(F.col(f"{c}__sd")).alias(f"{c}__scale"))])


def apply_scaler_keyed(df: DataFrame, params: DataFrame, cols: list[str], keys: list[str]) -> DataFrame:
    """MOD1 per series (params joined on the series keys)."""
    j = _keyed_join(df, params, keys, [], "left")
    out = j.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in cols})
    return out.drop(*[f"{c}__{s}" for c in cols for s in ("mean", "scale")])
