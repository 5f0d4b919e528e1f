"""Pearson and Spearman correlation of all pairs of columns, with the target and between groups of columns.

Nulls are left out pair by pair: a pair counts the rows where both columns have a value. One pass gives the moments of
all pairs: every task adds up matrix products of its rows (values about the column mean, 0 where null) with their null
masks, and Spark adds the tasks' matrices element by element. The passes read the columns once, whatever number of pairs.

Spearman is Pearson on average ranks. The ranks of all columns are found at once: cells (column, value) are counted before
the shuffle, so any number of ties is one row; the distinct values are put in order by range partitions of (column,
value), which are written, and sums by range give the ranks below each range. No column, and no value, meets in one
task. A column's ranks are among all its values; pairs are then completed as above.

Defined cases: NaN counts as null; a pair with fewer than two common rows, or a column without variance on them, gives
NULL; an empty table gives NULL for all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketflow.plans.materialize import materialize
from marketflow.session import shuffle_partitions

#: Share of a sum of squares below which what is left after centring counts as rounding.
_NOTHING = 1e-12
_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _values(df: DataFrame, cols: list[str]) -> list:
    return [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double")) for c in cols]


def pair_moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy): sums over the rows that have both columns, about the columns' means."""
    x = _values(df, cols)
    means = df.agg(*[F.coalesce(F.avg(v), F.lit(0.0)) for v in x]).first()
    centred = df.select(*[(v - F.lit(m)).alias(f"c{k}") for k, (v, m) in enumerate(zip(x, means))])

    def add(batches):
        p = len(cols)
        total = np.zeros((6, p, p))
        for batch in batches:
            raw = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], dtype=np.float64)
            mask = ~np.isnan(raw)
            value, there = np.where(mask, raw, 0.0), mask.astype(np.float64)
            square = value * value
            total += np.stack([there @ there.T, value @ there.T, there @ value.T, square @ there.T, there @ square.T, value @ value.T])
        i, j = (k.ravel().astype(np.int32) for k in np.indices((p, p)))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), *(pa.array(t.ravel()) for t in total)], names=["i", "j", *_SUMS])

    parts = centred.mapInArrow(add, "i int, j int, " + ", ".join(f"{s} double" for s in _SUMS))
    return parts.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, corr) for all ordered pairs of columns, each column with itself included."""
    m = pair_moments(df, cols)
    dx, dy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    known = (F.col("n") >= 2) & (dx > _NOTHING * F.col("sxx")) & (dy > _NOTHING * F.col("syy"))
    corr = F.when(known, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(dx * dy))
    names = F.array(*[F.lit(c) for c in cols])
    got = m.select("i", "j", F.col("n").cast("long").alias("n"), F.when(corr > 1, 1.0).when(corr < -1, -1.0).otherwise(corr).alias("corr"))
    every = df.sparkSession.range(len(cols)).select(F.col("id").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(len(cols) - 1))).alias("j"))
    return every.join(F.broadcast(got), ["i", "j"], "left").select(  # one row for each pair
        F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"), "corr")


def average_ranks(df: DataFrame, cols: list[str], row: str = "__row") -> DataFrame:
    """(row, one column of ranks for each column): ranks from 1 among the column's values, ties share their mean rank."""
    numbered = materialize(df.select(F.monotonically_increasing_id().alias(row), *[v.alias(f"c{k}") for k, v in enumerate(_values(df, cols))]), "rows")
    cell = F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("i"), (F.col(f"c{k}") + 0.0).alias("v")) for k in range(len(cols))]),
                              lambda e: e["v"].isNotNull())).alias("e")
    cells = numbered.select(row, cell).select(row, "e.i", "e.v")
    counts = cells.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    n_ranges = shuffle_partitions(df.sparkSession)
    ranged = materialize(counts.repartitionByRange(n_ranges, "i", "v").withColumn("range", F.spark_partition_id()), "values")
    sums = ranged.groupBy("i", "range").agg(F.sum("n").alias("m"))  # at most a row for each column and range
    before = Window.partitionBy("i").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("i", "range", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("i", "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranged.withColumn("upto", F.sum("n").over(inside)).join(offsets, ["i", "range"]).select(
        "i", "v", (F.col("below") + F.col("upto") - (F.col("n") - 1) / 2).alias("rank"))
    placed = cells.join(ranked, ["i", "v"]).groupBy(row).agg(*[F.max(F.when(F.col("i") == k, F.col("rank"))).alias(f"r{k}") for k in range(len(cols))])
    return numbered.select(row).join(placed, row, "left").select(row, *[F.col(f"r{k}").alias(c) for k, c in enumerate(cols)])


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, n, corr) of the average ranks."""
    return pearson(materialize(average_ranks(df, cols), "ranks"), cols)


def with_target(matrix: DataFrame, target: str) -> DataFrame:
    """(column, n, corr): every other column's correlation with the target."""
    return matrix.where((F.col("b") == target) & (F.col("a") != target)).select(F.col("a").alias("column"), "n", "corr")


def between_groups(matrix: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """(group_a, group_b, n_pairs, mean_abs, max_abs) over the pairs of different columns of two groups that have a correlation."""
    member = F.create_map(*[F.lit(x) for g, cs in groups.items() for c in cs for x in (c, g)])
    named = matrix.where("a <> b").select(member[F.col("a")].alias("group_a"), member[F.col("b")].alias("group_b"), F.abs("corr").alias("x"))
    return named.where("group_a IS NOT NULL AND group_b IS NOT NULL AND group_a <= group_b").groupBy("group_a", "group_b").agg(
        F.count("x").alias("n_pairs"), F.avg("x").alias("mean_abs"), F.max("x").alias("max_abs"))
