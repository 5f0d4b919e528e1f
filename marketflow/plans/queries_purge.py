"""Registered queries: purged and embargoed folds, walk-forward splits, interval overlap over series."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.operators import purge
from marketflow.plans.oracle import with_panel
from marketflow.plans.queries_models import _NATION_SQL, _nation_panel
from marketflow.plans.registry import panel, query

# Fixed values of the queries: a label is known 1 to 15 days after its row; the embargo and the training span in days.
EMBARGO, TRAIN_SPAN = 10, 400
_HORIZON = "(date_id + 1 + date_id % 15)"


def _contiguous(n: str, k: int) -> str:
    return f"CASE WHEN pos < ({n} % {k}) * ({n} // {k} + 1) THEN pos // ({n} // {k} + 1) ELSE ({n} % {k}) + (pos - ({n} % {k}) * ({n} // {k} + 1)) // ({n} // {k}) END"


_ROLE = f"""CASE WHEN t.fold = f.fold THEN 'test'
  WHEN EXISTS (SELECT 1 FROM r x WHERE x.fold = f.fold {{same}} AND x.fold <> t.fold AND (x.date_id BETWEEN t.date_id AND t.label_end
    OR t.date_id BETWEEN x.date_id AND x.label_end)) THEN 'purged'
  {{embargo}} ELSE 'train' END"""


@query("purge1_keyed_purged_kfold", f"""WITH p AS ({_NATION_SQL}),
r AS (SELECT *, {_contiguous('n', 5)} AS fold FROM (SELECT nation, date_id, {_HORIZON} AS label_end,
  row_number() OVER (PARTITION BY nation ORDER BY date_id) - 1 AS pos, count(*) OVER (PARTITION BY nation) AS n FROM p)),
l AS (SELECT nation, fold, max(label_end) AS last FROM r GROUP BY nation, fold)
SELECT t.nation, t.date_id, CAST(f.fold AS INTEGER) AS fold, {_ROLE.format(same='AND x.nation = t.nation',
    embargo=f"WHEN t.fold > f.fold AND t.date_id <= f.last + {EMBARGO} THEN 'embargoed'")} AS role
FROM r t JOIN l f ON f.nation = t.nation""")
def q_purged(spark, sf_dir):
    """Purged and embargoed 5-fold split of every nation's series: all rows with their role in every fold."""
    rows = _nation_panel(spark, sf_dir).select("nation", "date_id", F.expr("date_id + 1 + date_id % 15").alias("label_end"))
    return purge.purged_folds(rows, "date_id", "label_end", 5, "nation", EMBARGO).select("nation", "date_id", "fold", "role")


@query("purge2_walk_forward", with_panel(f"""
SELECT t.date_id, CAST(f.fold AS INTEGER) AS fold, {_ROLE.format(same='', embargo='')} AS role
FROM r t JOIN (SELECT fold, min(date_id) AS first FROM r WHERE fold >= 1 GROUP BY fold) f
  ON t.fold <= f.fold AND (t.fold = f.fold OR t.date_id >= f.first - {TRAIN_SPAN})""", f"""
r AS (SELECT *, CASE WHEN pos < n - 5 * (n // 6) THEN 0 ELSE (pos - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold
  FROM (SELECT date_id, {_HORIZON} AS label_end, row_number() OVER (ORDER BY date_id) - 1 AS pos, count(*) OVER () AS n FROM panel))"""))
def q_walk_forward(spark, sf_dir):
    """Walk-forward split of the panel: five validation blocks, each trained on the last TRAIN_SPAN days before it, purged."""
    rows = panel(spark, sf_dir).select("date_id", F.expr("date_id + 1 + date_id % 15").alias("label_end"))
    return purge.purged_folds(rows, "date_id", "label_end", 5, walk_forward=True, train_span=TRAIN_SPAN).select("date_id", "fold", "role")


@query("purge3_overlap_with_scattered_tests", f"""WITH p AS (SELECT nation, date_id, {_HORIZON} AS label_end FROM ({_NATION_SQL}))
SELECT nation, date_id, EXISTS (SELECT 1 FROM p x WHERE x.nation = t.nation AND x.date_id % 31 = 0
  AND (x.date_id BETWEEN t.date_id AND t.label_end OR t.date_id BETWEEN x.date_id AND x.label_end)) AS overlaps FROM p t""")
def q_overlap(spark, sf_dir):
    """Rows whose label horizon overlaps that of any test row of their series, for test rows scattered over the series."""
    rows = _nation_panel(spark, sf_dir).select("nation", "date_id", F.expr("date_id + 1 + date_id % 15").alias("label_end"))
    return purge.overlaps_any(rows, rows.where("date_id % 31 = 0"), "date_id", "label_end", "nation").select("nation", "date_id", "overlaps")
