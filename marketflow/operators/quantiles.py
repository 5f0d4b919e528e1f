"""Exact quantiles of many columns for many series, winsorising and outlier fences.

All (series, column, quantile) triples are selected together, in shared passes:

1. a sketch for each series brackets every wanted rank (``MARGIN`` of the rows on both sides);
2. one aggregation counts the rows below each bracket, and the values inside the brackets become (series, column,
   quantile, value) cells, counted before the shuffle: any number of ties is one row;
3. the cells are put in order by range partitions, which are written, and sums by range give the rank of each value. A
   series that holds most of the rows, or one value that does, is spread over many ranges;
4. a rank that the sketch missed is looked up among all values of its series and column, in the same way.

A quantile interpolates linearly between its two neighbouring ranks, as ``quantile_cont`` does. The values of every series
are ranked whole; only the sketch is approximate, and it decides nothing but how many cells are ranked.

Defined cases: NaN counts as null; nulls are skipped; a column without values in a series has NULL quantiles and n = 0;
a series with a NULL key is a series; an empty table gives no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.operators.series import _keyed_join
from marketflow.plans.materialize import materialize
from marketflow.session import shuffle_partitions

#: Accuracy of the sketch, whose rank error is at most 1/ACCURACY of a series' rows.
ACCURACY = 1_000
#: Share of a series' rows by which a bracket reaches beyond its rank on both sides.
MARGIN = 2.0 / ACCURACY
_OUT = ("column", "p", "n", "value")


def _value(c: str) -> Column:
    return F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))


def _ranked(cells: DataFrame, stats: DataFrame, ks: list[str]) -> DataFrame:
    """``stats`` with ``a`` and ``z``, the values at the two ranks of each triple, among the counted ``cells`` (ks, i, j, v)
    above ``below`` rows; NULL where the cells do not hold the rank."""
    triple = [*ks, "i", "j"]
    counted = cells.groupBy(*triple, "v").agg(F.count(F.lit(1)).alias("m"))
    ranges = shuffle_partitions(cells.sparkSession)
    ranged = materialize(counted.repartitionByRange(ranges, *triple, "v").withColumn("range", F.spark_partition_id()), "cells")
    sums = ranged.groupBy(*triple, "range").agg(F.sum("m").alias("t"))  # a row for each triple and range it lies in
    before = Window.partitionBy(*triple).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*triple, "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("earlier"))
    ranks = _keyed_join(offsets, stats.select(*triple, "below", "lo", "hi"), ks, ["i", "j"], "inner")
    inside = Window.partitionBy(*triple, "range").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    upto = ranged.withColumn("upto", F.sum("m").over(inside))
    placed = _keyed_join(upto, ranks, ks, ["i", "j", "range"], "inner")
    last = F.col("below") + F.col("earlier") + F.col("upto")
    at = lambda rank: F.max(F.when((last - F.col("m") <= rank) & (rank < last), F.col("v")))
    found = placed.groupBy(*triple).agg(at(F.col("lo")).alias("a"), at(F.col("hi")).alias("z"))
    return _keyed_join(stats, found, ks, ["i", "j"], "left")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, column, p, n, value): the exact quantiles ``probs`` of each column in each series; n counts its values."""
    keys = list(keys or [])
    if set(keys) & set(_OUT) or not all(0 <= p <= 1 for p in probs) or not cols or not probs:
        raise ValueError("needs columns, probabilities in [0, 1], and keys that are not named like a result column")
    ks, spots = [f"k{c}" for c in range(len(keys))], [(i, j) for i in range(len(cols)) for j in range(len(probs))]
    # "one" lets a table without keys take the same equi joins
    data = df.select(*[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)], F.lit(0).alias("one"),
                     *[(_value(c) + F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(cols)])
    edges = [min(max(p + side * MARGIN, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = materialize(data.groupBy(*ks, "one").agg(*[e for i in range(len(cols)) for e in (
        F.count(f"c{i}").alias(f"n{i}"), F.percentile_approx(f"c{i}", edges, ACCURACY).alias(f"q{i}"))]), "sketch")
    rows = _keyed_join(data, sketch, ks, ["one"], "inner")
    lower, upper = (lambda i, j: F.col(f"q{i}")[2 * j]), (lambda i, j: F.col(f"q{i}")[2 * j + 1])
    below = rows.groupBy(*ks, "one").agg(*[F.max(f"n{i}").alias(f"n{i}") for i in range(len(cols))],
                                         *[F.count_if(F.col(f"c{i}") < lower(i, j)).alias(f"b{i}_{j}") for i, j in spots])
    spot = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"n{i}").alias("n"), F.col(f"b{i}_{j}").alias("below"),
                                        (F.greatest(F.col(f"n{i}") - 1, F.lit(0)) * F.lit(float(probs[j]))).alias("rank")) for i, j in spots])).alias("e")
    stats = materialize(below.select(*ks, spot).select(*ks, "e.*").withColumns({"lo": F.floor("rank"), "hi": F.ceil("rank")}), "ranks")
    within = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.when(
        (F.col(f"c{i}") >= lower(i, j)) & (F.col(f"c{i}") <= upper(i, j)), F.col(f"c{i}")).alias("v")) for i, j in spots])
    cells = rows.select(*ks, F.explode(F.filter(within, lambda e: e["v"].isNotNull())).alias("e")).select(*ks, "e.*")
    got = materialize(_ranked(cells, stats, ks), "quantiles")
    missed = got.where("n > 0 AND (a IS NULL OR z IS NULL)").drop("a", "z").withColumn("below", F.lit(0).cast("long"))
    if not missed.isEmpty():
        values = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v")) for i in range(len(cols))])
        every = data.select(*ks, F.explode(F.filter(values, lambda e: e["v"].isNotNull())).alias("e")).select(*ks, "e.*")
        again = _keyed_join(every, missed.select(*ks, "i", "j"), ks, ["i"], "inner")
        got = got.where("n = 0 OR (a IS NOT NULL AND z IS NOT NULL)").unionByName(materialize(_ranked(again, missed, ks), "missed"))
    a, z = F.col("a"), F.col("z")
    name = lambda of, at: F.element_at(F.array(*[F.lit(x) for x in of]), F.col(at) + 1)
    return got.select(*[F.col(k).alias(n) for k, n in zip(ks, keys)], name(cols, "i").alias("column"), name([float(p) for p in probs], "j").alias("p"), "n",
                      F.when(a == z, a).otherwise(a + (z - a) * (F.col("rank") - F.col("lo"))).alias("value"))


def _limits(df: DataFrame, cols: list[str], probs: tuple[float, float], keys: list[str], ks: list[str], names: tuple[str, str]) -> DataFrame:
    """One written row for each series: its keys as ``ks``, and both quantiles of each column."""
    q = exact_quantiles(df, cols, list(probs), keys).select(*[F.col(k).alias(a) for k, a in zip(keys, ks)], "column", "p", "value")
    pick = [F.max(F.when((F.col("column") == c) & (F.col("p") == float(p)), F.col("value"))).alias(f"{s}{i}")
            for i, c in enumerate(cols) for s, p in zip(names, probs)]
    return materialize(q.withColumn("one", F.lit(0)).groupBy(*ks, "one").agg(*pick), "limits")


def _with_limits(df: DataFrame, limits: DataFrame, keys: list[str], ks: list[str]) -> DataFrame:
    """One struct column ``row`` of the input's columns, next to its series' limits."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[F.col(f"`{k}`").alias(a) for k, a in zip(keys, ks)], F.lit(0).alias("one"))
    return _keyed_join(rows, limits, ks, ["one"], "left")


def winsorise(df: DataFrame, cols: list[str], keys: list[str] | None = None, lower: float = 0.01, upper: float = 0.99,
              fit: DataFrame | None = None) -> DataFrame:
    """``df`` with ``cols`` (as doubles) pulled to their series' exact quantiles. ``fit``: the table the quantiles come from
    (the table itself by default); values of a series that it does not hold stay as they are, and so do nulls."""
    if lower > upper:
        raise ValueError("lower must not be above upper")
    keys = list(keys or [])
    ks = [f"k{c}" for c in range(len(keys))]
    limits = _limits(df if fit is None else fit, cols, (lower, upper), keys, ks, ("l", "u"))

    def pulled(c: str) -> Column:
        i, v = cols.index(c), F.nanvl(F.col("row")[c].cast("double"), F.lit(None).cast("double"))
        return F.when(v < F.col(f"l{i}"), F.col(f"l{i}")).when(v > F.col(f"u{i}"), F.col(f"u{i}")).otherwise(v)

    return _with_limits(df, limits, keys, ks).select(*[(pulled(c) if c in cols else F.col("row")[c]).alias(c) for c in df.columns])


def outlier_counts(df: DataFrame, cols: list[str], keys: list[str] | None = None, reach: float = 1.5) -> DataFrame:
    """(keys, column, n, lower, upper, n_low, n_high): values below and above the fences, which lie ``reach`` interquartile
    ranges outside the exact quartiles of each series."""
    keys = list(keys or [])
    ks = [f"k{c}" for c in range(len(keys))]
    limits = _limits(df, cols, (0.25, 0.75), keys, ks, ("q", "t"))
    fence = {f"f{i}": F.col(f"q{i}") - F.lit(reach) * (F.col(f"t{i}") - F.col(f"q{i}")) for i in range(len(cols))}
    fence |= {f"g{i}": F.col(f"t{i}") + F.lit(reach) * (F.col(f"t{i}") - F.col(f"q{i}")) for i in range(len(cols))}
    rows = _with_limits(df.select(*dict.fromkeys([*keys, *cols])), limits.withColumns(fence), keys, ks)
    v = [F.nanvl(F.col("row")[c].cast("double"), F.lit(None).cast("double")) for c in cols]
    counts = rows.groupBy(*ks, "one").agg(*[e for i, x in enumerate(v) for e in (
        F.count(x).alias(f"n{i}"), F.max(f"f{i}").alias(f"f{i}"), F.max(f"g{i}").alias(f"g{i}"),
        F.count_if(x < F.col(f"f{i}")).alias(f"a{i}"), F.count_if(x > F.col(f"g{i}")).alias(f"z{i}"))])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n"), F.col(f"f{i}").alias("lower"), F.col(f"g{i}").alias("upper"),
                                        F.col(f"a{i}").alias("n_low"), F.col(f"z{i}").alias("n_high")) for i, c in enumerate(cols)])).alias("e")
    return counts.select(*ks, each).select(*[F.col(a).alias(k) for a, k in zip(ks, keys)], "e.*")
