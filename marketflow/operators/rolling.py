"""Rolling count, sum, mean, sample standard deviation, minimum and maximum over row frames of any length and over time ranges.

A sliding frame costs Spark its length for every row, and a frame longer than a halo block would copy whole blocks. Here
a frame [s, p] of positions is put together from three parts: the end of the block that holds s, whole blocks, and
the part of p's own block. The parts are states (n, mean, sum of squared deviations, least, largest) that merge exactly
as the rows would; deviations are taken about the block's mean, so a series' level costs no digits.

* Inside blocks, two running windows (one from the left, one from the right) give every row both partial states.
* Whole blocks come from a sparse table over one row for each (series, block): level k holds the state of 2**k blocks in a
  row, made by joining level k-1 to itself, and a run of m blocks is merged along the bits of m. Each level is
  written, and only as many levels are made as the longest run of blocks needs.
* Short row frames (at most ``SHORT_ROWS``) are plain windows over halo blocks.

Time ranges cover the rows of (t - span, t], with gaps in time and ties: rows of one time become one state first (combined
before the shuffle, so a time that a third of the rows share is one row); the start of each frame is found by sorting the
rows together with markers at t - span and counting, not by joining pairs.

Defined cases: NULL values do not count; a frame with fewer than ``min_periods`` values gives NULL (the count is always
given); a standard deviation needs two values; rows without a time (or series order, for row frames: they come last) get
NULL over time ranges; a NULL series key is a series; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.operators import series
from marketflow.plans.materialize import materialize

AGGS = ("count", "sum", "mean", "std", "min", "max")
#: Row frames up to this length are plain windows over halo blocks.
SHORT_ROWS = 64
#: Rows of a block for time ranges: what a frame may cost inside its own block.
RANGE_BLOCK_ROWS = 256
_B, _S, _L, _M = "__b", "__s", "__l", "__m"


def _state(n: Column, mean: Column, dev: Column, lo: Column, hi: Column) -> Column:
    return F.when(n > 0, F.struct(n.cast("double").alias("n"), mean.alias("m"), F.greatest(dev, F.lit(0.0)).alias("q"), lo.alias("lo"), hi.alias("hi")))


def _merge(a: Column, b: Column) -> Column:
    """State of both parts (NULL: nothing in it)."""
    n, gap = a["n"] + b["n"], b["m"] - a["m"]
    both = F.struct(n.alias("n"), (a["m"] + gap * b["n"] / n).alias("m"), (a["q"] + b["q"] + gap * gap * a["n"] * b["n"] / n).alias("q"),
                    F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def _over(e: Column, centre: Column, w) -> Column:
    """State of the element states ``e`` in the frame ``w``."""
    n = F.sum(e["n"]).over(w)
    s = F.sum(e["n"] * (e["m"] - centre)).over(w)
    q = F.sum(e["q"] + e["n"] * (e["m"] - centre) * (e["m"] - centre)).over(w)
    return _state(n, centre + s / n, q - s * s / n, F.min(e["lo"]).over(w), F.max(e["hi"]).over(w))


def _outputs(state: dict[str, Column], aggs, min_periods: int, name) -> dict[str, Column]:
    out = {}
    for c, s in state.items():
        n = F.coalesce(s["n"], F.lit(0.0))
        value = {"count": n.cast("long"), "sum": s["n"] * s["m"], "mean": s["m"], "min": s["lo"], "max": s["hi"],
                 "std": F.when(n > 1, F.sqrt(s["q"] / (s["n"] - 1)))}
        for a in aggs:
            out[name(c, a)] = value[a] if a == "count" else F.when(n >= max(1, min_periods), value[a])
    return out


def _block_runs(table: DataFrame, need: DataFrame, keys: list[str], cols: list[str], longest: int) -> DataFrame:
    """``need`` (keys, __l, __m) with the states of the ``__m`` blocks from ``__l`` on. ``table``: (keys, __b, __t_c)."""
    acc = need.withColumns({"__at": F.col(_L), **{f"__a_{c}": F.lit(None).cast(table.schema[f"__t_{c}"].dataType) for c in cols}})
    level, k = table, 0
    while True:
        bit = F.col(_M).bitwiseAND(F.lit(1 << k)) != 0
        asked = acc.withColumn(_B, F.when(bit, F.col("__at")).otherwise(-1 - F.col("__at")))
        acc = series._keyed_join(asked, level, keys, [_B], "left").withColumns({
            **{f"__a_{c}": _merge(F.col(f"__a_{c}"), F.col(f"__t_{c}")) for c in cols},
            "__at": F.col("__at") + F.when(bit, F.lit(1 << k)).otherwise(0)}).drop(_B, *[f"__t_{c}" for c in cols])
        if 2 << k > longest:
            return acc.drop("__at")
        right = level.select(*keys, (F.col(_B) - (1 << k)).alias(_B), *[F.col(f"__t_{c}").alias(f"__u_{c}") for c in cols])
        joined = series._keyed_join(level, right, keys, [_B], "inner")
        level = materialize(joined.withColumns({f"__t_{c}": _merge(F.col(f"__t_{c}"), F.col(f"__u_{c}")) for c in cols})
                            .drop(*[f"__u_{c}" for c in cols]), "sparse")
        k += 1


def _framed(rows: DataFrame, keys: list[str], cols: list[str], block_rows: int, own) -> DataFrame:
    """``rows`` (keys, pos, __s, element states __e_c) plus the states __f_c of the frames [__s, pos].

    ``own(blocks, element, centre)`` is the state of the part of a frame that lies in the row's own block."""
    b = F.floor(F.col(series.POS) / block_rows)
    first = F.floor(F.col(_S) / block_rows)
    rows = rows.withColumn(_B, b)
    blocks = [*keys, _B]
    whole = Window.partitionBy(*blocks)
    back = Window.partitionBy(*blocks).orderBy(F.desc(series.POS)).rowsBetween(Window.unboundedPreceding, 0)

    def centre(c):
        e = F.col(f"__e_{c}")
        return F.sum(e["n"] * e["m"]).over(whole) / F.sum(e["n"]).over(whole)

    rows = rows.withColumns({f"__c_{c}": centre(c) for c in cols})
    rows = rows.withColumns({f"__f_{c}": own(blocks, F.col(f"__e_{c}"), F.col(f"__c_{c}")) for c in cols})
    ends = rows.select(*keys, series.POS, _B, *[_over(F.col(f"__e_{c}"), F.col(f"__c_{c}"), back).alias(f"__t_{c}") for c in cols])
    ends = materialize(ends, "ends")
    # a frame that starts inside an earlier block takes that block's end; others get a number that no row has
    inside = (first < F.col(_B)) & (F.col(_S) % block_rows != 0)
    begin = first + F.when(F.col(_S) % block_rows == 0, 0).otherwise(1)
    rows = rows.drop(*[f"__e_{c}" for c in cols], *[f"__c_{c}" for c in cols]).withColumns({
        "__from": F.when(inside, F.col(_S)).otherwise(-1 - F.col(series.POS)),
        _M: F.greatest(F.col(_B) - begin, F.lit(0)), _L: begin})
    rows = rows.withColumn(_L, F.when(F.col(_M) > 0, F.col(_L)).otherwise(-1 - F.col(series.POS)))
    rows = materialize(rows, "frames")
    out = series._keyed_join(rows, ends.drop(_B).withColumnRenamed(series.POS, "__from"), keys, ["__from"], "left")
    out = out.withColumns({f"__f_{c}": _merge(F.col(f"__t_{c}"), F.col(f"__f_{c}")) for c in cols}).drop("__from", *[f"__t_{c}" for c in cols])
    need = materialize(rows.where(F.col(_M) > 0).select(*keys, _L, _M).distinct(), "need")
    longest = need.agg(F.max(_M)).first()[0]
    if longest:
        table = ends.where(F.col(series.POS) % block_rows == 0).drop(series.POS)
        runs = materialize(_block_runs(table, need, keys, cols, longest), "runs")
        if not keys and runs.count() <= series.BROADCAST_RANGES:
            runs = F.broadcast(runs)
        out = series._keyed_join(out, runs, keys, [_L, _M], "left").withColumns(
            {f"__f_{c}": _merge(F.col(f"__a_{c}"), F.col(f"__f_{c}")) for c in cols}).drop(*[f"__a_{c}" for c in cols])
    return out.drop(_B, _S, _L, _M)


def rolling(df: DataFrame, cols: list[str], rows: int, order_by, partition_by=None, aggs=("mean", "std", "min", "max"),
            min_periods: int | None = None, block_rows: int | None = None, name=lambda c, a: f"{c}_{a}", placed: bool = False) -> DataFrame:
    """``df`` plus the aggregates of each column over the last ``rows`` rows of its series, the row itself included.

    ``min_periods`` defaults to ``rows``. ``placed``: ``df`` holds its positions in ``pos`` already (written, so that they
    do not change between passes), and keeps them."""
    if rows < 1 or set(aggs) - set(AGGS):
        raise ValueError(f"rows must be positive and aggs among {AGGS}")
    keys = series._as_list(partition_by)
    least = rows if min_periods is None else min_periods
    at = df if placed else materialize(series.add_position(df, order_by, keys), "placed")
    element = {f"__e_{c}": _state(F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)), F.col(c).cast("double"), F.lit(0.0),
                                  F.col(c).cast("double"), F.col(c).cast("double")) for c in cols}
    if rows <= SHORT_ROWS and block_rows is None:
        halo = series.with_halo(at.withColumns(element), max(series.default_block_rows(at, at.count()), rows), before=rows - 1)
        w = Window.partitionBy(*keys, series._BLK).orderBy(series.POS)
        frame = w.rowsBetween(-(rows - 1), 0)
        whole = Window.partitionBy(*keys, series._BLK)
        centre = {c: F.sum(F.col(f"__e_{c}.m")).over(whole) / F.sum(F.col(f"__e_{c}.n")).over(whole) for c in cols}
        halo = halo.withColumns({f"__c_{c}": x for c, x in centre.items()})
        out = halo.withColumns({f"__f_{c}": _over(F.col(f"__e_{c}"), F.col(f"__c_{c}"), frame) for c in cols}).where(~F.col(series._HALO))
        out = out.drop(series._BLK, series._HALO)
    else:
        size = min(block_rows or max(SHORT_ROWS, rows // 2), max(1, rows - 1), series.TARGET_BLOCK_ROWS)
        at = at.withColumns({_S: F.greatest(F.col(series.POS) - (rows - 1), F.lit(0).cast("long")), **element})
        # a frame is longer than a block, so its part of the row's own block always begins with the block
        run = lambda blocks: Window.partitionBy(*blocks).orderBy(series.POS).rowsBetween(Window.unboundedPreceding, 0)
        out = _framed(at, keys, cols, size, lambda blocks, e, centre: _over(e, centre, run(blocks)))
    out = out.withColumns(_outputs({c: F.col(f"__f_{c}") for c in cols}, aggs, least, name))
    return out.drop(*([] if placed else [series.POS]), *[f"__{x}_{c}" for x in "ecf" for c in cols])


def rolling_range(df: DataFrame, cols: list[str], span: int, time: str, partition_by=None, aggs=("mean", "std", "min", "max"),
                  min_periods: int = 1, block_rows: int = RANGE_BLOCK_ROWS, name=lambda c, a: f"{c}_{a}") -> DataFrame:
    """(keys, time, aggregates): one row for each time of a series, over its rows in (time - span, time].

    ``time`` is a whole-number column (days, seconds, ...)."""
    if span < 1 or set(aggs) - set(AGGS):
        raise ValueError(f"span must be positive and aggs among {AGGS}")
    keys = series._as_list(partition_by)
    x = {c: F.col(c).cast("double") for c in cols}
    states = [_state(F.count(v), F.avg(v), F.var_pop(v) * F.count(v), F.min(v), F.max(v)).alias(f"__e_{c}") for c, v in x.items()]
    times = df.where(F.col(time).isNotNull()).groupBy(*keys, F.col(time).cast("long").alias("__t")).agg(*states)
    rows = materialize(series.add_position(times, "__t", keys), "times")
    # markers stand after the rows of their time; the k-th marker of a series is its k-th row's
    own = rows.select(*keys, F.col("__t").alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__p"))
    marks = rows.select(*keys, (F.col("__t") - span).alias("__at"), F.lit(1).alias("__kind"), F.col(series.POS).alias("__p"))
    placed = series.add_position(own.unionByName(marks), ["__at", "__kind", "__p"], keys).where("__kind = 1")
    starts = placed.select(*keys, F.col("__p").alias(series.POS), (F.col(series.POS) - F.col("__p")).alias(_S))
    rows = series._keyed_join(rows, starts, keys, [series.POS], "inner")
    frame = lambda blocks: Window.partitionBy(*blocks).orderBy("__t").rangeBetween(-(span - 1), 0)
    out = _framed(rows, keys, cols, block_rows, lambda blocks, e, centre: _over(e, centre, frame(blocks)))
    return out.select(*keys, F.col("__t").alias(time), *[v.alias(n) for n, v in _outputs(
        {c: F.col(f"__f_{c}") for c in cols}, aggs, min_periods, name).items()])
