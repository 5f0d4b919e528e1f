"""Purged and embargoed splits, walk-forward splits, and an interval semi join without pairs.

A row's label is known only at the end of its horizon, [start, end]. A row may not train a model that is tested on rows
whose horizon overlaps its own (it is purged), nor start within ``embargo`` after the last test horizon (embargoed).

``purged_folds`` tests on contiguous folds of positions. There a row that starts before the fold overlaps one of
its rows exactly when its end reaches the fold's first start, and a row that starts after it exactly when the fold's last
end reaches its start. So the two bounds of each (series, fold) decide every row: one aggregation, and one join with a
table of a row for each series; no pair of rows is made, however long a series is.

``overlaps_any`` is the same test for any set of test rows: some interval of the set overlaps [s, e] exactly when the
largest end among those that start at e or before is at least s. Both sides are sorted together and the largest
end runs along in blocks (``series.running_best``), so a series that holds a third of all rows is many blocks.

Defined cases: an end that is NULL or before the start counts as the start; rows without a start are in no fold
and never overlap; ends and starts that are equal overlap; a NULL series key is a series; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.operators import series

# One-row-per-series tables of at most this many rows are broadcast; longer ones are joined.
BROADCAST_SERIES = 100_000


def _end(start: str, end: str) -> Column:
    return F.greatest(F.col(start), F.coalesce(F.col(end), F.col(start)))


def fold_bounds(df: DataFrame, start: str, end: str, fold: str, keys: list[str]) -> DataFrame:
    """(keys, folds): per series the list of (fold, first start, last end), one for each fold."""
    per = df.where(F.col(start).isNotNull()).groupBy(*keys, fold).agg(F.min(start).alias("first"), F.max(_end(start, end)).alias("last"))
    return per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(fold).alias("fold"), "first", "last"))).alias("__folds"))


def _joined(df: DataFrame, per_series: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        folds = [F.struct(*[F.lit(x).alias(n) for n, x in f.asDict().items()]) for r in per_series.collect() for f in r["__folds"]]  # k bounds
        return df.withColumn("__folds", F.array(*folds)) if folds else df.limit(0).withColumn("__folds", F.lit(None).cast(per_series.schema["__folds"].dataType))
    small = per_series.limit(BROADCAST_SERIES + 1).count() <= BROADCAST_SERIES
    right = per_series.select(*[F.col(c).alias(f"__{c}") for c in keys], "__folds")
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return df.join(F.broadcast(right) if small else right, cond, "left").drop(*[f"__{c}" for c in keys])


def purged_folds(df: DataFrame, start: str, end: str, k: int = 5, partition_by=None, embargo=0, walk_forward: bool = False,
                 train_span=None, fold_col: str = "fold", role_col: str = "role") -> DataFrame:
    """Every row once for each fold, with its role there: test, train, purged or embargoed.

    Folds are contiguous in order of ``start``: ``k`` equal ones (WIN5), or with ``walk_forward`` the ``k`` validation
    blocks of the expanding split (WIN4); there only rows before the block have a role, and with ``train_span`` only
    those that start at most so much before it."""
    keys = series._as_list(partition_by)
    rows = series.add_position(df.where(F.col(start).isNotNull()), start, keys)
    rows = series.add_folds(rows, "expanding" if walk_forward else "contiguous", k, keys or None, fold_col="__own")
    rows = series.materialize(rows.drop("pos"), "folds")
    tested = rows.where("__own >= 1") if walk_forward else rows
    out = _joined(rows, fold_bounds(tested, start, end, "__own", keys), keys).withColumn("__f", F.explode("__folds")).drop("__folds")
    s, e = F.col(start), _end(start, end)
    own, f = F.col("__own"), F.col("__f")
    role = F.when(own == f["fold"], "test") \
            .when((own < f["fold"]) & (e >= f["first"]), "purged") \
            .when((own > f["fold"]) & (s <= f["last"]), "purged") \
            .when((own > f["fold"]) & (s <= f["last"] + F.lit(embargo)), "embargoed").otherwise("train")
    if walk_forward:
        out = out.where(own <= f["fold"])
        if train_span is not None:
            out = out.where((own == f["fold"]) | (s >= f["first"] - F.lit(train_span)))
    return out.withColumn(role_col, role).withColumn(fold_col, f["fold"]).drop("__f", "__own")


def overlaps_any(df: DataFrame, others: DataFrame, start: str, end: str, partition_by=None, out: str = "overlaps") -> DataFrame:
    """``df`` plus ``out``: whether some row of ``others`` (same columns) of the series overlaps the row's interval."""
    keys = series._as_list(partition_by)
    bare = F.lit(None).cast(df.schema[start].dataType)
    probes = df.where(F.col(start).isNotNull()).select(*keys, F.struct(*df.columns).alias("__row"), F.col(start).alias("__s"),
                                                       _end(start, end).alias("__at"), F.lit(1).alias("__kind"), bare.alias("__end"))
    spans = others.where(F.col(start).isNotNull()).select(*keys, F.lit(None).cast(probes.schema["__row"].dataType).alias("__row"), bare.alias("__s"),
                                                          F.col(start).alias("__at"), F.lit(0).alias("__kind"), _end(start, end).alias("__end"))
    both = spans.unionByName(probes).withColumn("__down", -F.col("__end"))
    ran = series.running_best(both, "__down", ["__at", "__kind"], keys, out="__best")
    found = ran.where("__kind = 1").select("__row.*", F.coalesce(-F.col("__best.v") >= F.col("__s"), F.lit(False)).alias(out))
    return found.unionByName(df.where(F.col(start).isNull()).withColumn(out, F.lit(False)))
