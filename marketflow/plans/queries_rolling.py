"""Registered queries: rolling statistics over short, long and whole-series row frames and over time ranges with gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import rolling, series
from marketflow.plans.materialize import materialize
from marketflow.plans.oracle import with_panel
from marketflow.plans.queries_models import _NATION_SQL, _nation_panel
from marketflow.plans.queries_stats import round_doubles
from marketflow.plans.registry import panel, query, table

_FN = {"count": "count({c})", "mean": "avg({c})", "std": "stddev_samp({c})", "min": "min({c})", "max": "max({c})", "sum": "sum({c})"}


def _sql(cols, aggs, windows, min_periods, partition=""):
    """Select items c_a_w over ROWS frames of each length w."""
    out = []
    for w in windows:
        for c in cols:
            for a in aggs:
                value = f"{_FN[a].format(c=c)} OVER w{w}"
                least = w if min_periods is None else min_periods
                value = value if a == "count" else f"round(CASE WHEN count({c}) OVER w{w} >= {least} THEN {value} END, 6)"
                out.append(f"{value} AS {c}_{a}_{w}")
    frames = ", ".join(f"w{w} AS ({partition} ORDER BY date_id ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in windows)
    return ", ".join(out), frames


_PANEL_WINDOWS = (3, 20, 250, 1500)
_ITEMS, _FRAMES = _sql(["P12", "S5", "V2"], ["mean", "std", "min", "max"], _PANEL_WINDOWS, 2)


@query("roll1_panel_rows", with_panel(f"SELECT date_id, {_ITEMS} FROM panel WINDOW {_FRAMES}"))
def q_panel(spark, sf_dir):
    """Rolling mean, std, min and max of panel columns over 3 to 1,500 rows (nulls skipped, two values at least)."""
    out = materialize(series.add_position(panel(spark, sf_dir).select("date_id", "P12", "S5", "V2"), "date_id"))
    for w in _PANEL_WINDOWS:
        out = rolling.rolling(out, ["P12", "S5", "V2"], w, "date_id", min_periods=2, name=lambda c, a, w=w: f"{c}_{a}_{w}", placed=True)
    return round_doubles(out.drop("P12", "S5", "V2", "pos"))


_WHOLE = 100_000
_NITEMS, _NFRAMES = _sql(["log_price", "log_qty"], ["count", "mean", "std", "min", "max"], (5, 200, _WHOLE), 1, "PARTITION BY nation")


@query("roll2_keyed_rows", f"SELECT nation, date_id, {_NITEMS} FROM (SELECT *, ln(avg_price) AS log_price, ln(avg_qty) AS log_qty FROM ({_NATION_SQL})) WINDOW {_NFRAMES}")
def q_keyed(spark, sf_dir):
    """Rolling statistics of every nation's series over 5 and 200 rows, and over all rows so far."""
    rows = _nation_panel(spark, sf_dir).select("nation", "date_id", F.ln("avg_price").alias("log_price"), F.ln("avg_qty").alias("log_qty"))
    out = materialize(series.add_position(rows, "date_id", "nation"))
    for w in (5, 200, _WHOLE):
        out = rolling.rolling(out, ["log_price", "log_qty"], w, "date_id", "nation", ("count", "mean", "std", "min", "max"), 1,
                              name=lambda c, a, w=w: f"{c}_{a}_{w}", placed=True)
    return round_doubles(out.drop("log_price", "log_qty", "pos"))


_SPANS = (7, 365)
_RANGE_SQL = ", ".join(f"{'' if a == 'count' else 'round('}{_FN[a].format(c='price')} OVER r{s}{'' if a == 'count' else ', 6)'} AS price_{a}_{s}"
                       for s in _SPANS for a in ("count", "mean", "std", "min", "max"))


@query("roll3_time_ranges", f"""SELECT DISTINCT custkey, day, {_RANGE_SQL}
FROM (SELECT o_custkey AS custkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS day, ln(o_totalprice) AS price FROM orders)
WINDOW {', '.join(f'r{s} AS (PARTITION BY custkey ORDER BY day RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW)' for s in _SPANS)}""")
def q_ranges(spark, sf_dir):
    """Log order values of every customer over the last 7 and 365 days: series with gaps and several orders a day."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("custkey"), F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("day"),
        F.ln("o_totalprice").alias("price"))
    per = [rolling.rolling_range(orders, ["price"], s, "day", "custkey", ("count", "mean", "std", "min", "max"),
                                 name=lambda c, a, s=s: f"{c}_{a}_{s}") for s in _SPANS]
    return round_doubles(per[0].join(per[1], ["custkey", "day"]))
