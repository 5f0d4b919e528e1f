"""Exact medians with bounded memory (AGG9) and imputation (IMP1, IMP2).

Spark's exact ``median`` keeps a value->count map per group and merges all of
them in one task for a global median: memory grows with the distinct values
of the whole column. ``exact_medians`` selects the middle ranks instead:

1. small tables go to step 3 at once; otherwise ``percentile_approx`` gives
   bounds around the middle ranks, ``0.5 +- 3/accuracy`` (the sketch's rank
   error is <= n/accuracy), and the rows below / inside are counted exactly;
2. while a column's window still holds more than TARGET_VALUES distinct
   values, a sketch of the window's rows narrows it (every round leaves
   about 6/accuracy of the rows, besides ties of the two bounds, so this ends);
3. the window's rows become (column, value, count) rows, combined before
   the shuffle -- any number of ties is one row -- and running counts per
   column give the values at the middle ranks.

Result equals numpy/pandas/DuckDB ``median`` (average of the two middle values
for even counts). All-null columns give NULL.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Distinct values of a column's window that are ranked in one window task.
TARGET_VALUES = 1_000_000
# Sketch accuracy: the rank error of percentile_approx is <= n / accuracy and its
# summary holds O(accuracy) entries per column per task.
SKETCH_ACCURACY = 10_000
ALL = (-math.inf, math.inf)


def exact_medians(df: DataFrame, cols: list[str], with_counts: bool = False):
    """AGG9: exact median of each column (nulls skipped).

    ``with_counts=True`` also returns (n_rows, {col: n_non_null}).
    """
    if not cols:
        return ({}, (0, {})) if with_counts else {}
    x = {c: F.col(f"`{c}`").cast("double") for c in cols}
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    bounds = {c: ALL for c in cols if counts[c]}
    below = dict.fromkeys(bounds, 0)
    if row["_n"] > TARGET_VALUES:
        bounds, below = _narrowed(df, x, bounds, counts)
    med = dict.fromkeys(cols) | _pick(df, x, bounds, below, counts)
    return (med, (row["_n"], counts)) if with_counts else med


def _inside(x: Column, b: tuple) -> Column:
    if b == ALL:
        return x.isNotNull()
    return (x >= F.lit(b[0])) & (x <= F.lit(b[1]))


def _narrowed(df, x, bounds, counts):
    """Windows around the middle ranks with few distinct values, and the rows below each."""
    bounds, done, below = dict(bounds), {}, {}
    ranks = {c: (0, counts[c]) for c in bounds}  # rows below the window, rows inside it
    d = 3.0 / SKETCH_ACCURACY
    while bounds:
        cs = list(bounds)
        q = df.agg(*[F.percentile_approx(
            F.when(_inside(x[c], bounds[c]), x[c]),
            [min(max(0.0, ((counts[c] - 1) // 2 - ranks[c][0]) / ranks[c][1] - d), 1.0),
             min(max(0.0, (counts[c] // 2 - ranks[c][0]) / ranks[c][1] + d), 1.0)], SKETCH_ACCURACY).alias(f"q{i}")
            for i, c in enumerate(cs)]).first()
        new = {c: tuple(q[f"q{i}"]) for i, c in enumerate(cs)}
        r = df.agg(*[e for i, c in enumerate(cs) for e in (
            F.count_if(x[c] < F.lit(new[c][0])).alias(f"b{i}"), F.count_if(_inside(x[c], new[c])).alias(f"k{i}"),
            F.approx_count_distinct(F.when(_inside(x[c], new[c]), x[c])).alias(f"v{i}"))]).first()
        for i, c in enumerate(cs):
            b, k = r[f"b{i}"], r[f"k{i}"]
            missed = not (b <= (counts[c] - 1) // 2 and counts[c] // 2 < b + k)
            if missed or (b, k) == ranks[c]:  # the sketch missed or cannot narrow: rank the window as it is
                done[c], below[c] = bounds.pop(c), ranks[c][0]
            elif r[f"v{i}"] <= TARGET_VALUES:
                done[c], below[c] = new[c], b
                del bounds[c]
            else:
                bounds[c], ranks[c] = new[c], (b, k)
    return done, below


def _pick(df, x, bounds, below, counts):
    """Medians from value counts inside the bounds; at most two rows a column reach the driver."""
    cols = list(bounds)
    if not cols:
        return {}
    items = F.array(*[F.struct(F.lit(i).alias("i"), F.when(_inside(x[c], bounds[c]), x[c]).alias("v"))
                      for i, c in enumerate(cols)])
    values = df.select(F.explode(F.filter(items, lambda e: e["v"].isNotNull())).alias("e")) \
               .groupBy(F.col("e.i").alias("i"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rank = lambda of: F.element_at(F.array(*[F.lit(of(counts[c]) - below[c]) for c in cols]), F.col("i") + 1)
    lo, hi = rank(lambda n: (n - 1) // 2), rank(lambda n: n // 2)
    upto = F.sum("n").over(Window.partitionBy("i").orderBy("v"))
    at = lambda k: (F.col("upto") - F.col("n") <= k) & (k < F.col("upto"))
    rows = values.withColumn("upto", upto).groupBy("i").agg(
        F.max(F.when(at(lo), F.col("v"))).alias("a"), F.max(F.when(at(hi), F.col("v"))).alias("z")).collect()
    return {cols[r["i"]]: r["a"] + (r["z"] - r["a"]) * 0.5 for r in rows}


def medians_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """AGG9 as a long DataFrame (column, median) -- one row per column."""
    m = exact_medians(df, cols)
    spark = df.sparkSession
    schema = T.StructType([T.StructField("column", T.StringType()), T.StructField("median", T.DoubleType())])
    return spark.createDataFrame([(c, m[c]) for c in cols], schema)


def fill_null(col: Column, value: Column) -> Column:
    """IMP1: fill a null from another expression."""
    return F.coalesce(col, value)


def median_fill(df: DataFrame, fit: DataFrame | None = None, cols: list[str] | None = None) -> DataFrame:
    """IMP2: fill every numeric column that has nulls with a median.

    ``fit`` is the table the medians come from: the table itself by default
    (each table uses its own medians, as the reference does); pass the train
    table to avoid leakage. Integral columns with nulls become double (a
    fractional median must fit). All-null columns stay null.
    """
    from marketflow.operators.profile import numeric_columns
    cols = cols if cols is not None else numeric_columns(df)
    if not cols:
        return df
    if fit is None:
        # own medians: the null counts come out of the same passes
        med, (n, counts) = exact_medians(df, cols, with_counts=True)
        need = [c for c in cols if counts[c] < n]
    else:
        nn = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
        need = [c for i, c in enumerate(cols) if nn[f"n{i}"] > 0]
        med = exact_medians(fit, need)
    repl = {}
    for c in need:
        t = df.schema[c].dataType
        base = F.col(f"`{c}`").cast("double") if isinstance(t, T.IntegralType) else F.col(f"`{c}`")
        repl[c] = F.coalesce(base, F.lit(med[c]).cast("double")) if med[c] is not None else base
    return df.withColumns(repl)
