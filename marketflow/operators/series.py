"""Ordered-series operators (WIN1-WIN6) without a single-partition window.

A window with no ``partitionBy`` moves the whole table into one task. Every
operator here instead works on *blocks*:

1. ``add_position`` (WIN1) gives each row its 0-based position inside its series
   (``partition_by`` keys, possibly none). Rows are range-partitioned on the
   series keys and the WHOLE order tuple (any orderable types; NULL has a place
   of its own) and written with their range number, so later passes see the same
   ranges. Rows per (series, range) are counted, the small count table gives
   offsets by a running sum, and ``row_number`` inside each (series, range) is
   added. A hot series, and ties of the first order column, are split over
   ranges like anything else, so no task holds a whole series.
2. ``with_halo`` cuts positions into blocks of ``B`` rows and copies the last
   ``before`` rows of every block into the next one (and the first ``after``
   rows into the previous one), flagged ``_halo``. A window partitioned by
   (series, block) then sees enough history; halo rows are dropped afterwards.
3. Values that must travel further than one halo (the EWM carry over a null
   run longer than the halo) go through a per-block summary table: one row per
   (series, block), carried with a running ``last`` and joined back.

Rows that tie on the whole order tuple get distinct positions in no set order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketflow.plans.materialize import materialize
from marketflow.session import shuffle_partitions

POS = "pos"
_BKT = "_bkt"
_BLK = "_blk"
_HALO = "_halo"

# Offsets of at most this many ranges are broadcast (a few MB); more are joined.
BROADCAST_RANGES = 100_000
# Rows of one range, and of one halo block, at large scale.
TARGET_BLOCK_ROWS = 4_000_000
MIN_BLOCK_ROWS = 64


def _as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


@dataclass(frozen=True)
class SeriesLayout:
    """Bounded driver-side facts about a positioned series table."""
    n_rows: int
    n_buckets: int
    block_rows: int
    n_series: int = 1


def _target_ranges(df: DataFrame, n_rows: int) -> int:
    """Ranges for ``n_rows``: as many as tasks run at once if that leaves MIN_BLOCK_ROWS rows each, and
    never more than TARGET_BLOCK_ROWS rows each."""
    wide = min(2 * shuffle_partitions(df.sparkSession), math.ceil(n_rows / MIN_BLOCK_ROWS))
    return max(1, wide, math.ceil(n_rows / TARGET_BLOCK_ROWS))


def _keyed_join(left: DataFrame, right: DataFrame, keys: list[str], extra: list[str], how: str) -> DataFrame:
    """Equi join on ``extra`` columns and NULL-safe on the series ``keys`` (a
    series whose key is NULL is still a series: its rows must not be dropped)."""
    if not keys:
        return left.join(right, on=extra, how=how)
    on = keys + extra
    r = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    lcols = left.columns
    la, ra = left.alias("__l"), r.alias("__r")
    cond = [F.col(f"__l.{k}").eqNullSafe(F.col(f"__r.__r_{k}")) for k in keys] + \
           [F.col(f"__l.{c}") == F.col(f"__r.__r_{c}") for c in extra]
    j = la.join(ra, on=cond, how=how)
    return j.select(*[F.col(f"__l.{c}").alias(c) for c in lcols],
                    *[F.col(f"__r.{c}").alias(c) for c in r.columns if not c.startswith("__r_")])


def add_position(df: DataFrame, order_by, partition_by=None, pos_col: str = POS,
                 n_buckets: int | None = None, with_layout: bool = False, nulls: str = "last"):
    """WIN1: 0-based row position in ``order_by`` order within each series.

    Ranges of the order tuple, written once; per-range counts, running-sum
    offsets over the small count table, then ``row_number`` inside
    (series, range). ``nulls``: NULL order values come "last" or "first".
    """
    if nulls not in ("first", "last"):
        raise ValueError("nulls must be 'first' or 'last'")
    order = _as_list(order_by)
    keys = _as_list(partition_by)
    asc = [F.asc_nulls_last(c) if nulls == "last" else F.asc_nulls_first(c) for c in order]
    n = df.count()
    nb = n_buckets or _target_ranges(df, n)
    dealt = df.repartitionByRange(nb, *[F.asc_nulls_first(k) for k in keys], *asc).withColumn(_BKT, F.spark_partition_id())
    ranged = materialize(dealt, "positions")
    counts = ranged.groupBy(*keys, _BKT).agg(F.count(F.lit(1)).alias("_cnt"))
    w_off = Window.partitionBy(*keys).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, _BKT, F.coalesce(F.sum("_cnt").over(w_off), F.lit(0)).alias("_off"))
    if not keys and nb <= BROADCAST_RANGES:
        offsets = F.broadcast(offsets)  # one row per range
    joined = _keyed_join(ranged, offsets, keys, [_BKT], "inner")
    w_rn = Window.partitionBy(*keys, _BKT).orderBy(*asc)
    out = joined.withColumn(pos_col, (F.col("_off") + F.row_number().over(w_rn) - 1).cast("long")) \
                .drop("_off", _BKT)
    if with_layout:
        n_series = ranged.agg(F.approx_count_distinct(F.struct(*keys))).first()[0] if keys else 1
        return out, SeriesLayout(n, nb, default_block_rows(df, n), int(n_series or 1))
    return out


def default_block_rows(df: DataFrame, n_rows: int, min_rows: int = MIN_BLOCK_ROWS) -> int:
    """Rows per halo block: about ``2 x shuffle partitions`` blocks, never more
    than ``TARGET_BLOCK_ROWS`` rows."""
    return int(min(max(min_rows, math.ceil(n_rows / (2 * shuffle_partitions(df.sparkSession)))), TARGET_BLOCK_ROWS))


def _small(blocks: DataFrame, n_rows: int, block_rows: int) -> DataFrame:
    """A one-row-per-block table of an unkeyed series: broadcast while it has few rows."""
    return F.broadcast(blocks) if n_rows <= BROADCAST_RANGES * block_rows else blocks


def with_halo(df: DataFrame, block_rows: int, before: int = 0, after: int = 0,
              pos_col: str = POS) -> DataFrame:
    """Add ``_blk`` and ``_halo``; duplicate edge rows into neighbour blocks.

    One pass: every row explodes into its own block plus, when it sits in the
    last ``before`` (first ``after``) rows of its block, a halo copy for the
    next (previous) block -- no union, so the input is scanned once.
    """
    if before >= block_rows or after >= block_rows:
        raise ValueError("halo must be shorter than a block")
    p = F.col(pos_col)
    blk = F.floor(p / F.lit(block_rows)).cast("long")
    off = p - blk * F.lit(block_rows)
    own = F.struct(blk.alias("b"), F.lit(False).alias("h"))
    copies = [own]
    if before:
        copies.append(F.when(off >= block_rows - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))))
    if after:
        copies.append(F.when((off < after) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))))
    arr = F.filter(F.array(*copies), lambda e: e.isNotNull()) if len(copies) > 1 else F.array(own)
    return df.withColumn("_bh", F.explode(arr)) \
             .withColumn(_BLK, F.col("_bh.b")).withColumn(_HALO, F.col("_bh.h")).drop("_bh")


def shift(df: DataFrame, cols: dict[str, tuple[str, int]], order_by, partition_by=None,
          pos_col: str | None = None, block_rows: int | None = None) -> DataFrame:
    """lag/lead without a one-partition window.

    ``cols`` maps output name -> (input column, offset); offset > 0 looks back
    (lag), offset < 0 looks ahead (lead). Rows outside the series get NULL.
    """
    keys = _as_list(partition_by)
    drop_pos = pos_col is None
    if pos_col is None:
        df, lay = add_position(df, order_by, keys, with_layout=True)
        pos_col, n_rows = POS, lay.n_rows
        br = block_rows or lay.block_rows
    else:
        n_rows = df.count()
        br = block_rows or default_block_rows(df, n_rows)
    back = max([o for _, o in cols.values() if o > 0], default=0)
    ahead = max([-o for _, o in cols.values() if o < 0], default=0)
    br = max(br, back + 1, ahead + 1)
    h = with_halo(df, br, before=back, after=ahead, pos_col=pos_col)
    w = Window.partitionBy(*keys, _BLK).orderBy(pos_col)
    exprs = {}
    for out, (src, o) in cols.items():
        exprs[out] = F.lag(src, o).over(w) if o > 0 else F.lead(src, -o).over(w)
    res = h.withColumns(exprs).where(~F.col(_HALO)).drop(_BLK, _HALO)
    return res.drop(POS) if drop_pos else res


# ---------------------------------------------------------------- EWM (WIN2/3)

def ewm_alpha(com: float | None = None, span: float | None = None,
              halflife: float | None = None, alpha: float | None = None) -> float:
    """Smoothing factor from exactly one of com / span / halflife / alpha."""
    given = [x is not None for x in (com, span, halflife, alpha)]
    if sum(given) != 1:
        raise ValueError("give exactly one of com, span, halflife, alpha")
    if com is not None:
        if com < 0:
            raise ValueError("com must be >= 0")
        return 1.0 / (1.0 + com)
    if span is not None:
        if span < 1:
            raise ValueError("span must be >= 1")
        return 2.0 / (span + 1.0)
    if halflife is not None:
        if halflife <= 0:
            raise ValueError("halflife must be > 0")
        return 1.0 - math.exp(-math.log(2.0) / halflife)
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    return float(alpha)


def ewm_weights(r: float, K: int) -> list[float]:
    """Decay weights r**d for d = 0..K (Python floats, shared with the oracle)."""
    return [r ** d for d in range(K + 1)]


def ewm_window_rows(alpha: float, rel_tol: float = 2.0 ** -53) -> int:
    """Rows of history after which older weights fall below ``rel_tol``.

    K = ceil(ln(rel_tol) / ln(1 - alpha)); for com=0.5 this is 34. We keep a
    margin of 6 (40 for com=0.5).
    """
    if alpha >= 1.0:
        return 1
    return int(math.ceil(math.log(rel_tol) / math.log(1.0 - alpha))) + 6


def ewm(df: DataFrame, cols: list[str], order_by, partition_by=None, com: float = 0.5,
        null_mode: str = "carry", fill: bool = False, suffix: str = "_ewm",
        pos_col: str | None = None, block_rows: int | None = None,
        alpha: float | None = None) -> DataFrame:
    """WIN2 (EWM mean, adjusted weights, nulls hold a position) and WIN3 (fill).

    Per (series, block) the mean is computed over the block plus a halo of K
    earlier rows, by built-in expressions (a K-row window, literal weights):
    the same engine, and the same bits, at every size; only the input columns
    are touched.

    ``null_mode='carry'``: at a null input the mean of the last non-null
    position is carried (the value the adjusted recursion keeps).
    ``'propagate'``: NULL at null positions. Leading nulls stay NULL.
    ``fill=True`` replaces each input column by ``coalesce(x, ewm)`` (WIN3);
    otherwise new ``{c}{suffix}`` columns are added.
    """
    if null_mode not in ("carry", "propagate"):
        raise ValueError("null_mode must be 'carry' or 'propagate'")
    keys = _as_list(partition_by)
    a = alpha if alpha is not None else ewm_alpha(com=com)
    r = 1.0 - a
    K = ewm_window_rows(a)
    drop_pos = pos_col is None
    if pos_col is None:
        df, lay = add_position(df, order_by, keys, with_layout=True)
        pos_col, br = POS, block_rows or lay.block_rows
        n_rows = lay.n_rows
    else:
        n_rows = df.count()
        br = block_rows or default_block_rows(df, n_rows)
    br = max(br, K + 1)
    p = F.col(pos_col)
    h = _ewm_block(with_halo(df, br, before=K, pos_col=pos_col), cols, keys, pos_col, r, K, null_mode)

    if null_mode == "carry":
        # Carry across blocks: last non-null mean per (series, block), then the
        # last one of all earlier blocks.
        summ = h.groupBy(*keys, _BLK).agg(*[
            F.max_by(F.col(f"_e_{c}"), F.when(F.col(f"_e_{c}").isNotNull(), p)).alias(f"_b_{c}")
            for c in cols])
        w_prev = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
        prev = summ.select(*keys, _BLK, *[F.last(f"_b_{c}", ignorenulls=True).over(w_prev).alias(f"_p_{c}")
                                         for c in cols])
        if not keys:
            prev = _small(prev, n_rows, br)
        h = _keyed_join(h, prev, keys, [_BLK], "left")
        vals = {c: F.coalesce(F.col(f"_c_{c}"), F.col(f"_p_{c}")) for c in cols}
    else:
        vals = {c: F.col(f"_e_{c}") for c in cols}

    if fill:
        h = h.withColumns({c: F.coalesce(F.col(c).cast("double"), vals[c]) for c in cols})
    else:
        h = h.withColumns({f"{c}{suffix}": vals[c] for c in cols})
    tmp = [x for c in cols for x in (f"_e_{c}", f"_c_{c}", f"_p_{c}") if x in h.columns]
    h = h.drop(*tmp, _BLK)
    return h.drop(POS) if drop_pos else h


def _ewm_block(h: DataFrame, cols, keys, pos_col, r, K, null_mode) -> DataFrame:
    p = F.col(pos_col)
    w_frame = Window.partitionBy(*keys, _BLK).orderBy(pos_col).rowsBetween(-K, 0)
    w_run = Window.partitionBy(*keys, _BLK).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    # weights r^d as a literal table: the same doubles whatever the engine,
    # summed oldest to newest
    wts = F.array(*[F.lit(float(wd)) for wd in ewm_weights(r, K)])
    nn_cols = {}
    for c in cols:
        x = F.col(c).cast("double")
        arr = F.collect_list(F.when(x.isNotNull(), F.struct(p.alias("p"), x.alias("v")))).over(w_frame)
        wt = lambda e: F.element_at(wts, (p - e["p"] + 1).cast("int"))
        num = F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + e["v"] * wt(e))
        den = F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + wt(e))
        nn_cols[f"_e_{c}"] = F.when(x.isNotNull() & ~F.col(_HALO), num / den)
    h = h.withColumns(nn_cols)
    if null_mode == "carry":
        # halo rows carry truncated means: only own-block rows feed the carry;
        # earlier blocks come through the summary table.
        h = h.withColumns({f"_c_{c}": F.last(F.col(f"_e_{c}"), ignorenulls=True).over(w_run) for c in cols})
    return h.where(~F.col(_HALO)).drop(_HALO)


# ------------------------------------------------------------ splits (WIN4/5)

def expanding_fold(pos: Column, n: Column, k: int = 5) -> Column:
    """WIN4 fold id: 0 = train-only head, j = validation block j (1..k).

    Block size ts = n // (k+1); block j starts at n - (k-j+1)*ts, so the
    remainder goes to the head.
    """
    ts = F.floor(n / (k + 1))
    head = n - F.lit(k) * ts
    return F.when(pos < head, F.lit(0)).otherwise(F.floor((pos - head) / ts) + 1).cast("int")


def contiguous_fold(pos: Column, n: Column, k: int = 10) -> Column:
    """WIN5 contiguous k-fold, no shuffle: the first n mod k folds get one
    extra row. 0-based fold id."""
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return F.when(pos < big, F.floor(pos / (q + 1))) \
            .otherwise(rem + F.floor((pos - big) / q)).cast("int")


def add_series_count(df: DataFrame, partition_by=None, n_col: str = "_n") -> DataFrame:
    """Series length per row: a grouped count joined back (broadcast when unkeyed)."""
    keys = _as_list(partition_by)
    if not keys:
        return df.withColumn(n_col, F.lit(df.count()).cast("long"))  # one scalar
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_col))
    return _keyed_join(df, cnt, keys, [], "inner")


def add_folds(df: DataFrame, kind: str = "expanding", k: int = 5, partition_by=None,
              pos_col: str = POS, fold_col: str = "fold") -> DataFrame:
    """Attach the WIN4/WIN5 fold id from positions and series length."""
    d = add_series_count(df, partition_by)
    n = F.col("_n")
    f = expanding_fold(F.col(pos_col), n, k) if kind == "expanding" else contiguous_fold(F.col(pos_col), n, k)
    return d.withColumn(fold_col, f).drop("_n")


# --------------------------------------------------------- sortedness (WIN6)

def sortedness(df: DataFrame, value_col: str, order_by, partition_by=None) -> DataFrame:
    """WIN6: per series, the number of rows whose value is below the previous
    row's value in ``order_by`` order, and ``is_sorted``."""
    keys = _as_list(partition_by)
    s = shift(df.select(*keys, *_as_list(order_by), value_col),
              {"_prev": (value_col, 1)}, order_by, keys)
    return s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(value_col) < F.col("_prev")).alias("n_unsorted"),
    ).withColumn("is_sorted", F.col("n_unsorted") == 0)


# ------------------------------------------------------ early stopping (WIN7)

def running_best(df: DataFrame, value_col: str, order_by, partition_by=None, pos_col: str | None = None,
                 block_rows: int | None = None, out: str = "best") -> DataFrame:
    """Running minimum with its first position, as struct ``out`` = (v, p).

    Block-wise: running min inside each (series, block), combined with the
    prefix minimum of all earlier blocks from a one-row-per-block table.
    """
    keys = _as_list(partition_by)
    if pos_col is None:
        df, lay = add_position(df, order_by, keys, with_layout=True)
        pos_col, br, n_rows = POS, block_rows or lay.block_rows, lay.n_rows
    else:
        n_rows = df.count()
        br = block_rows or default_block_rows(df, n_rows)
    p = F.col(pos_col)
    d = df.withColumn(_BLK, F.floor(p / F.lit(br)).cast("long"))
    item = F.when(F.col(value_col).isNotNull(), F.struct(F.col(value_col).cast("double").alias("v"), p.alias("p")))
    w_run = Window.partitionBy(*keys, _BLK).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.min(item).over(w_run))
    summ = d.groupBy(*keys, _BLK).agg(F.min("_in").alias("_bm"))
    w_prev = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    prev = summ.select(*keys, _BLK, F.min("_bm").over(w_prev).alias("_pm"))
    if not keys:
        prev = _small(prev, n_rows, br)
    d = _keyed_join(d, prev, keys, [_BLK], "left")
    best = F.when(F.col("_pm").isNull(), F.col("_in")).when(F.col("_in").isNull(), F.col("_pm")) \
            .otherwise(F.least(F.col("_in"), F.col("_pm")))
    return d.withColumn(out, best).drop("_in", "_pm", _BLK)


def early_stopping(df: DataFrame, value_col: str, order_by, partition_by=None, patience: int = 50,
                   pos_col: str | None = None) -> DataFrame:
    """WIN7: per series, stop at the first iteration whose best (lowest) metric
    is ``patience`` iterations old; report stop and best iterations.

    Output: keys, ``n_iter``, ``stop_pos`` (last position when never
    stopped), ``stopped``, ``best_pos``, ``best_value``.
    """
    keys = _as_list(partition_by)
    drop_pos = pos_col is None
    r = running_best(df, value_col, order_by, keys, pos_col=pos_col)
    pc = pos_col or POS
    p = F.col(pc)
    cond = (p - F.col("best.p")) >= patience
    g = r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_iter"),
        F.min(F.when(cond, p)).alias("_stop"),
        F.min_by(F.col("best"), F.when(cond, p)).alias("_bstop"),
        F.max(p).alias("_last"),
        F.min(F.col("best")).alias("_ball"),
    )
    b = F.coalesce(F.col("_bstop"), F.col("_ball"))
    return g.select(*keys, "n_iter", F.coalesce("_stop", "_last").alias("stop_pos"),
                    F.col("_stop").isNotNull().alias("stopped"),
                    b["p"].alias("best_pos"), b["v"].alias("best_value"))
