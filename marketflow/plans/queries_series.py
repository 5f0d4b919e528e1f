"""Registered queries: ordered-series operators (WIN1-WIN7, FLT6), unkeyed on
the panel and keyed (many series) on ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import series
from marketflow.plans.oracle import with_panel
from marketflow.plans.queries_stats import round_doubles
from marketflow.plans.registry import panel, query, table

# EWM centre of mass and the split sizes.
EWM_COM = 0.5
N_SPLITS = 5
CV_FOLDS = 10
PATIENCE = 50

EWM_COLS = ["E3", "P9", "S1", "S5", "V2"]
_R = 1.0 - series.ewm_alpha(com=EWM_COM)  # decay per row
_K = series.ewm_window_rows(series.ewm_alpha(com=EWM_COM))
# the same literal weights the operator uses, so both sides are bit-identical
_W = "[" + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in series.ewm_weights(_R, _K)) + "]"


def _ewm_sql(src: str, key: str | None, order: str, cols: list[str], mode: str, ids: list[str]) -> str:
    """Bounded self-join EWM oracle: weights r**(pos_t - pos_j) over the last K
    rows, carry = last non-null mean."""
    part = f"PARTITION BY {key} " if key else ""
    on_key = f"a.{key} = b.{key} AND " if key else ""
    idsel = ", ".join(f"a.{i}" for i in ids)
    pieces, sel = [], []
    for c in cols:
        num = f"list_reduce(list_prepend(0.0, list(b.{c} * {_W}[a.pos - b.pos + 1] ORDER BY b.pos)), lambda acc, v: acc + v)"
        den = f"list_reduce(list_prepend(0.0, list({_W}[a.pos - b.pos + 1] ORDER BY b.pos)), lambda acc, v: acc + v)"
        pieces.append(f"""e_{c} AS (
  SELECT {idsel}, a.pos, {num} / {den} AS m
  FROM s a JOIN s b ON {on_key}b.pos BETWEEN a.pos - {_K} AND a.pos AND b.{c} IS NOT NULL
  WHERE a.{c} IS NOT NULL GROUP BY ALL)""")
    body_cols = []
    joins = []
    for c in cols:
        joins.append(f"LEFT JOIN e_{c} USING ({', '.join(ids)})")
        if mode == "carry":
            body_cols.append(f"last_value(e_{c}.m IGNORE NULLS) OVER ({part}ORDER BY s.pos ROWS UNBOUNDED PRECEDING) AS v_{c}")
        else:
            body_cols.append(f"e_{c}.m AS v_{c}")
    ctes = (f"s AS (SELECT {', '.join(ids)}, {', '.join(cols)}, row_number() OVER ({part}ORDER BY {order}) - 1 AS pos FROM {src}),\n"
            + ",\n".join(pieces)
            + f",\nv AS (SELECT s.*, {', '.join(body_cols)} FROM s {' '.join(joins)})")
    for c in cols:
        if mode == "fill":
            sel.append(f"coalesce({c}, v_{c}) AS {c}")
        else:
            sel.append(f"v_{c} AS {c}_ewm")
    return ctes, f"SELECT {', '.join(ids)}, {', '.join(sel)} FROM v"


def _panel_ewm_sql(mode: str) -> str:
    ctes, body = _ewm_sql("panel", None, "date_id", EWM_COLS, "propagate" if mode == "propagate" else "carry",
                          ["date_id"])
    if mode == "fill":
        body = "SELECT date_id, " + ", ".join(f"coalesce({c}, v_{c}) AS {c}" for c in EWM_COLS) + " FROM v"
    return with_panel(body, ctes)


# ------------------------------------------------------------------ positions

@query("win1_positions_unkeyed", with_panel(
    "SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS pos FROM panel"))
def q_pos(spark, sf_dir):
    """WIN1 without a one-partition window: quantile buckets + offsets."""
    return series.add_position(panel(spark, sf_dir).select("date_id"), "date_id")


@query("win1_positions_keyed",
       "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos FROM events")
def q_pos_keyed(spark, sf_dir):
    """WIN1 per series (user), hot series split over buckets."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return series.add_position(ev, "ts", "user_id").drop("ts")


@query("win1_shift_lag_lead", """
SELECT event_id, lag(value) OVER (ORDER BY ts) AS prev_value, lead(value, 2) OVER (ORDER BY ts) AS next2_value
FROM events""")
def q_shift(spark, sf_dir):
    """lag / lead on an unkeyed series through halo blocks."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    s = series.shift(ev, {"prev_value": ("value", 1), "next2_value": ("value", -2)}, "ts")
    return s.select("event_id", "prev_value", "next2_value")


# ------------------------------------------------------------------------ EWM

def _panel_ewm(spark, sf_dir, mode):
    p = panel(spark, sf_dir).select("date_id", *EWM_COLS)
    if mode == "fill":
        return series.ewm(p, EWM_COLS, "date_id", com=EWM_COM, null_mode="carry", fill=True)
    out = series.ewm(p, EWM_COLS, "date_id", com=EWM_COM, null_mode=mode)
    return out.select("date_id", *[f"{c}_ewm" for c in EWM_COLS])


@query("win2_ewm_carry", _panel_ewm_sql("carry"))
def q_ewm_carry(spark, sf_dir):
    """WIN2 EWM mean (com=0.5, adjusted, nulls hold a position), carry mode."""
    return _panel_ewm(spark, sf_dir, "carry")


@query("win2_ewm_propagate", _panel_ewm_sql("propagate"))
def q_ewm_prop(spark, sf_dir):
    """WIN2 EWM mean, NULL at null inputs."""
    return _panel_ewm(spark, sf_dir, "propagate")


@query("win3_imp1_ewm_fill", _panel_ewm_sql("fill"))
def q_ewm_fill(spark, sf_dir):
    """WIN3: fill_null(ewm_mean) -- leading nulls stay null, runs longer than
    the window carry the last mean."""
    return _panel_ewm(spark, sf_dir, "fill")


_EV_NULLED = "(SELECT event_id, user_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value FROM events)"


def _events_ewm_sql():
    ctes, _ = _ewm_sql(_EV_NULLED, "user_id", "ts", ["value"], "carry", ["event_id", "user_id"])
    return f"WITH {ctes}\nSELECT event_id, value, v_value AS value_ewm FROM v"


@query("win2_ewm_keyed", _events_ewm_sql())
def q_ewm_keyed(spark, sf_dir):
    """WIN2 per series: event values (errors as missing) by user in time order."""
    ev = table(spark, sf_dir, "events")
    v = ev.select("event_id", "user_id", "ts",
                  F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    out = series.ewm(v, ["value"], "ts", "user_id", com=EWM_COM, null_mode="carry")
    return out.select("event_id", "value", "value_ewm")


# --------------------------------------------------------------------- splits

_FOLD_SQL = """SELECT date_id, pos, CAST(CASE WHEN pos < n - {k} * (n // ({k} + 1)) THEN 0
       ELSE (pos - (n - {k} * (n // ({k} + 1)))) // (n // ({k} + 1)) + 1 END AS INTEGER) AS fold
FROM (SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM panel)"""


@query("win4_expanding_folds", with_panel(_FOLD_SQL.format(k=N_SPLITS)))
def q_folds(spark, sf_dir):
    """WIN4: expanding-window split, 5 validation blocks; fold 0 = train-only head."""
    p = series.add_position(panel(spark, sf_dir).select("date_id"), "date_id")
    return series.add_folds(p, "expanding", N_SPLITS).select("date_id", "pos", "fold")


@query("win4_expanding_folds_keyed", """
SELECT event_id, user_id, pos, CAST(CASE WHEN pos < n - 5 * (n // 6) THEN 0
       ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS INTEGER) AS fold
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS pos,
             count(*) OVER (PARTITION BY user_id) AS n FROM events)""")
def q_folds_keyed(spark, sf_dir):
    """WIN4 for many series at once (one split per user)."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    p = series.add_position(ev, "ts", "user_id")
    return series.add_folds(p, "expanding", N_SPLITS, partition_by="user_id").select("event_id", "user_id", "pos", "fold")


@query("win5_contiguous_folds", with_panel("""
SELECT date_id, pos, CAST(CASE WHEN pos < (n % 10) * (n // 10 + 1) THEN pos // (n // 10 + 1)
       ELSE (n % 10) + (pos - (n % 10) * (n // 10 + 1)) // (n // 10) END AS INTEGER) AS fold
FROM (SELECT date_id, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM panel)"""))
def q_kfold(spark, sf_dir):
    """WIN5: contiguous 10-fold, no shuffle; first n mod 10 folds one row longer."""
    p = series.add_position(panel(spark, sf_dir).select("date_id"), "date_id")
    return series.add_folds(p, "contiguous", CV_FOLDS).select("date_id", "pos", "fold")


@query("flt6_fold_slice", with_panel("SELECT * FROM (" + _FOLD_SQL.format(k=N_SPLITS) + ") WHERE fold = 3"))
def q_slice(spark, sf_dir):
    """FLT6: the rows of one validation block, selected by position."""
    return q_folds(spark, sf_dir).where(F.col("fold") == 3)


# ---------------------------------------------------------------- sortedness

@query("win6_sortedness", """
SELECT count(*) AS n_rows, count(*) FILTER (WHERE ts < prev) AS n_unsorted,
       count(*) FILTER (WHERE ts < prev) = 0 AS is_sorted
FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS prev FROM events)""")
def q_sorted(spark, sf_dir):
    """WIN6: is the time column sorted in id order?"""
    ev = table(spark, sf_dir, "events").select("event_id", "ts")
    return series.sortedness(ev, "ts", "event_id")


@query("win6_sortedness_keyed", """
SELECT user_id, count(*) AS n_rows, count(*) FILTER (WHERE value < prev) AS n_unsorted,
       count(*) FILTER (WHERE value < prev) = 0 AS is_sorted
FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)
GROUP BY user_id""")
def q_sorted_keyed(spark, sf_dir):
    """WIN6 per series: is each user's value sequence non-decreasing in time?"""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    return series.sortedness(ev, "value", "ts", "user_id")


# ------------------------------------------------------------ early stopping

def _stop_sql(src: str, key: str | None, order: str, val: str, patience: int) -> tuple[str, str]:
    """(CTEs, body): running min, first position of each value, stop row."""
    part = f"PARTITION BY {key} " if key else ""
    kcol = f"{key}, " if key else ""
    kjoin = f"r.{key} = f.{key} AND " if key else ""
    gjoin = f"a.{key} = g.{key} AND " if key else ""
    ctes = f"""s AS (SELECT {kcol}{val} AS v, row_number() OVER ({part}ORDER BY {order}) - 1 AS pos FROM {src}),
r AS (SELECT *, min(v) OVER ({part}ORDER BY pos ROWS UNBOUNDED PRECEDING) AS m FROM s),
f AS (SELECT {kcol}v, min(pos) AS fp FROM s WHERE v IS NOT NULL GROUP BY ALL),
a AS (SELECT r.*, f.fp AS bp FROM r LEFT JOIN f ON {kjoin}f.v = r.m),
g AS (SELECT {kcol}count(*) AS n_iter, min(pos) FILTER (WHERE pos - bp >= {patience}) AS stop, max(pos) AS last
      FROM a GROUP BY ALL)"""
    body = f"""SELECT {('g.' + key + ', ') if key else ''}n_iter, coalesce(stop, last) AS stop_pos, stop IS NOT NULL AS stopped,
       a.bp AS best_pos, round(a.m, 6) AS best_value
FROM g JOIN a ON {gjoin}a.pos = coalesce(g.stop, g.last)"""
    return ctes, body


_S_CTES, _S_BODY = _stop_sql("panel", None, "date_id", "E1", PATIENCE)
_K_CTES, _K_BODY = _stop_sql("events", "user_id", "ts", "value", PATIENCE)


@query("win7_early_stopping", with_panel(_S_BODY, _S_CTES))
def q_stop(spark, sf_dir):
    """WIN7: patience-50 early stopping over a metric sequence (E1 in date order)."""
    p = panel(spark, sf_dir).select("date_id", "E1")
    out = series.early_stopping(p, "E1", "date_id", patience=PATIENCE)
    return round_doubles(out)


@query("win7_early_stopping_keyed", f"WITH {_K_CTES}\n{_K_BODY}")
def q_stop_keyed(spark, sf_dir):
    """WIN7 for many metric sequences at once (per user, value in time order)."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    out = series.early_stopping(ev, "value", "ts", "user_id", patience=PATIENCE)
    return round_doubles(out)
