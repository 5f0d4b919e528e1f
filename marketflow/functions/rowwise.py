"""Row-wise (horizontal) statistics over groups of columns (ROW1-ROW6) and the
column-group metadata they need (PRJ9, PRJ10, AGG16).

All expressions are plain null-skipping arithmetic over the group's columns
(no arrays, no lambdas), so they compile into whole-stage codegen and need no
shuffle: a row's statistics depend on that row only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The one-letter, case-sensitive feature-group prefixes, in
# the order the groups are processed.
GROUP_PREFIXES = ["D", "E", "I", "M", "P", "S", "V"]
# Groups that take part in pairwise interactions (D is left out).
INTERACTION_GROUPS = ["E", "I", "M", "P", "S", "V"]
# Columns that are never base features.
EXCLUDE_COLUMNS = ["date_id", "is_scored", "forward_returns", "risk_free_rate",
                   "market_forward_excess_returns"]


def feature_groups(columns: list[str], prefixes=GROUP_PREFIXES) -> dict[str, list[str]]:
    """PRJ9: prefix -> columns in table order (case-sensitive startswith)."""
    return {g: [c for c in columns if c.startswith(g)] for g in prefixes}


def base_features(columns: list[str], exclude=EXCLUDE_COLUMNS) -> list[str]:
    """PRJ10: every column not in the exclusion list, in table order."""
    ex = set(exclude)
    return [c for c in columns if c not in ex]


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _count(cols: list[str]) -> Column:
    n = F.lit(0)
    for c in cols:
        n = n + F.col(c).isNotNull().cast("int")
    return n


def _sum(terms: list[Column]) -> Column:
    """Left-to-right sum skipping nulls (adding 0.0 is exact), plain
    arithmetic so the whole expression stays in whole-stage codegen."""
    acc = F.lit(0.0)
    for t in terms:
        acc = acc + F.coalesce(t, F.lit(0.0))
    return acc


def row_mean(cols: list[str]) -> Column:
    """ROW1: mean of the non-null values; NULL when none."""
    n = _count(cols)
    return F.when(n > 0, F.try_divide(_sum([_d(c) for c in cols]), n))


def row_std(cols: list[str]) -> Column:
    """ROW2: sample std (ddof=1) of the non-null values, two-pass; NULL when <2."""
    n = _count(cols)
    mu = F.try_divide(_sum([_d(c) for c in cols]), n)
    ss = _sum([(_d(c) - mu) * (_d(c) - mu) for c in cols])
    return F.when(n >= 2, F.sqrt(ss / (n - 1)))


def row_min(cols: list[str]) -> Column:
    """ROW3 (nulls skipped; NULL when all null)."""
    return F.least(*[_d(c) for c in cols]) if len(cols) > 1 else _d(cols[0])


def row_max(cols: list[str]) -> Column:
    """ROW4."""
    return F.greatest(*[_d(c) for c in cols]) if len(cols) > 1 else _d(cols[0])


def interaction_names(groups: dict[str, list[str]], among=INTERACTION_GROUPS) -> list[tuple[str, str]]:
    """ROW6 pairs: unordered pairs of non-empty groups, in list order."""
    present = [g for g in among if groups.get(g)]
    return list(combinations(present, 2))


def add_group_features(df: DataFrame, groups: dict[str, list[str]] | None = None,
                       among=INTERACTION_GROUPS) -> DataFrame:
    """ROW1-ROW6 in three projections: counts, means, min, max first; then std
    and range from those columns (the mean is computed once per row, not once
    per term inside a conditional branch); then the interaction products."""
    groups = groups if groups is not None else feature_groups(df.columns)
    groups = {g: cs for g, cs in groups.items() if cs}
    first = {}
    for g, cols in groups.items():
        first[f"_n_{g}"] = _count(cols)
        first[f"{g}_mean"] = row_mean(cols)
        first[f"{g}_min"] = row_min(cols)
        first[f"{g}_max"] = row_max(cols)
    out = df.withColumns(first)
    second = {}
    for g, cols in groups.items():
        n, mu = F.col(f"_n_{g}"), F.col(f"{g}_mean")
        ss = _sum([(_d(c) - mu) * (_d(c) - mu) for c in cols])
        second[f"{g}_std"] = F.when(n >= 2, F.sqrt(ss / (n - 1)))
        second[f"{g}_range"] = F.col(f"{g}_max") - F.col(f"{g}_min")
    out = out.withColumns(second)
    order = [c for c in df.columns] + [f"{g}_{k}" for g in groups for k in ("mean", "std", "min", "max", "range")]
    out = out.select(*order)
    inter = {f"{a}_{b}_interaction": F.col(f"{a}_mean") * F.col(f"{b}_mean")
             for a, b in interaction_names(groups, among)}
    return out.withColumns(inter) if inter else out
