"""DuckDB SQL used as the independent oracle for the registered queries.

``PANEL_CTE`` is the panel of ``plans/panel.py`` written in plain SQL (with
``lead``/``lag`` over the whole panel; fine for an oracle). Queries build on it
with ``WITH panel AS (...)``.
"""

from __future__ import annotations

PANEL_SQL = """
WITH l AS (
  SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS date_id,
         l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus,
         CAST(l_quantity AS BIGINT) AS q,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS pc,
         CAST(round(l_discount * 100) AS BIGINT) AS dc,
         CAST(round(l_tax * 100) AS BIGINT) AS tc
  FROM lineitem
), d AS (
  SELECT date_id,
         CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS np,
         CAST(count(DISTINCT l_suppkey) AS DOUBLE) AS ns,
         CAST(sum(l_linenumber) AS DOUBLE) AS sl, CAST(sum(q) AS DOUBLE) AS sq,
         CAST(max(q) AS DOUBLE) AS xq, CAST(min(q) AS DOUBLE) AS mq,
         CAST(sum(pc) AS DOUBLE) AS sp, CAST(max(pc) AS DOUBLE) AS xp, CAST(min(pc) AS DOUBLE) AS mp,
         CAST(sum(dc) AS DOUBLE) AS sd, CAST(max(dc) AS DOUBLE) AS xd, CAST(sum(tc) AS DOUBLE) AS st,
         CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS nr,
         CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS DOUBLE) AS na,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS DOUBLE) AS no
  FROM l GROUP BY date_id
), f AS (
  SELECT date_id,
         CASE WHEN date_id % 7 = 0 THEN 1 ELSE 0 END AS D1,
         CASE WHEN date_id % 30 = 0 THEN 1 ELSE 0 END AS D2,
         sp / n / 100000 AS E1, xp / 100000 AS E2, CASE WHEN date_id >= 40 THEN mp / 100000 END AS E3,
         n AS I1, np AS I2, ns AS I7, sl / n AS I9,
         sd / n AS M1, xd AS M2, st / n AS M11,
         sp / sq / 100 AS P8, CASE WHEN date_id % 7 <> 3 THEN xp / mp END AS P9,
         (xp - mp) / 100000 AS P10, xp / sp AS P12, mp / sp AS P13,
         CASE WHEN date_id % 101 <> 0 THEN nr / n END AS S1,
         CASE WHEN date_id % 101 <> 0 THEN na / n END AS S2,
         CASE WHEN date_id % 101 <> 0 AND NOT (date_id BETWEEN 500 AND 620) THEN no / n END AS S5,
         sq AS V1, CASE WHEN date_id % 53 <> 0 THEN xq END AS V2,
         CASE WHEN date_id % 53 <> 0 THEN mq END AS V3,
         lead(sp / n) OVER (ORDER BY date_id) / (sp / n) - 1 AS forward_returns,
         CAST(0.0001 AS DOUBLE) AS risk_free_rate
  FROM d
)
SELECT *, forward_returns - risk_free_rate AS market_forward_excess_returns,
       lag(forward_returns) OVER (ORDER BY date_id) AS lagged_forward_returns
FROM f
"""


def with_panel(body: str, extra_ctes: str = "") -> str:
    """``WITH panel AS (<panel>)[, extra] <body>``."""
    ctes = f"panel AS ({PANEL_SQL})"
    if extra_ctes:
        ctes += ",\n" + extra_ctes
    return f"WITH {ctes}\n{body}"
