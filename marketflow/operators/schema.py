"""Projection, filters and set operations (PRJ1-PRJ18, FLT1-FLT8, SET1-SET5).

Column lists are resolved on the driver from ``df.columns`` (metadata only);
the data work is plain select / where / unionByName, so Catalyst prunes columns
and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.functions.scalar import to_double
from marketflow.operators.series import POS, add_position, add_series_count


# ----------------------------------------------------------------- projection

def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """PRJ1: rename columns (missing names are ignored, like a soft rename)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def all_except(df: DataFrame, *excluded: str) -> list[str]:
    """PRJ2: every column but the excluded ones, in table order."""
    ex = set(excluded)
    return [c for c in df.columns if c not in ex]


def cast_all_double(df: DataFrame, except_cols=("date_id",)) -> DataFrame:
    """PRJ3 applied to all columns but ``except_cols``: non-strict cast to double."""
    return df.withColumns({c: to_double(F.col(f"`{c}`")) for c in all_except(df, *except_cols)})


def select_ordered(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ4 / PRJ8 (one column) / PRJ15 (ids first)."""
    return df.select(*[F.col(f"`{c}`") for c in cols])


def drop(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ7."""
    return df.drop(*cols)


def common_columns(left: DataFrame, right: DataFrame) -> list[str]:
    """PRJ11: columns of ``left`` that ``right`` also has, in left order."""
    r = set(right.columns)
    return [c for c in left.columns if c in r]


def ids_first(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """PRJ15: id columns first, then the rest in their order."""
    return df.select(*id_cols, *[c for c in df.columns if c not in id_cols])


def attach_ids(pred: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """PRJ16: overwrite/attach id columns from ``ids`` by joining on the row
    key (never positionally): ``ids`` columns win over same-named ones."""
    id_cols = [c for c in ids.columns if c != key]
    p = pred.drop(*id_cols)
    out = p.join(ids, on=key, how="left")
    return out.select(key, *id_cols, *[c for c in p.columns if c != key])


def score_table(df: DataFrame, id_col: str, pred: Column, name: str) -> DataFrame:
    """PRJ17: the two-column (id, prediction) table."""
    return df.select(F.col(id_col), pred.alias(name))


def named_scores(df: DataFrame, id_col: str = "batch_id", value_col: str | None = None,
                 name: str = "prediction") -> DataFrame:
    """PRJ18: unnamed scores -> typed, named one-column-plus-id table; falls
    back to the first non-id column when no value column is named."""
    v = value_col or [c for c in df.columns if c != id_col][0]
    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(v).cast("double").alias(name))


def to_vector(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """PRJ13: columns -> ML vector (nulls kept as NaN)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(df)


def from_vector(df: DataFrame, vec: str, names: list[str], keep: list[str] = ()) -> DataFrame:
    """PRJ14: vector -> named columns (NaN back to NULL)."""
    arr = vector_to_array(F.col(vec))
    cols = []
    for i, n in enumerate(names):
        x = arr[i]
        cols.append(F.when(~F.isnan(x), x).alias(n))
    return df.select(*keep, *cols)


# -------------------------------------------------------------------- filters

def where_equal(df: DataFrame, col: str, value) -> DataFrame:
    """FLT1: equality filter (pushed to the parquet scan)."""
    return df.where(F.col(col) == F.lit(value))


def drop_nulls(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """FLT3: drop rows with any null (NaN is already NULL at load)."""
    return df.dropna(how="any", subset=cols)


def all_but_last(df: DataFrame, n: int, order_by, partition_by=None, pos_col: str = POS) -> DataFrame:
    """FLT4: every row but the last ``n`` of each series (``head(-n)``)."""
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    p = df if pos_col in df.columns else add_position(df, order_by, keys, pos_col=pos_col)
    p = add_series_count(p, keys, "_n")
    return p.where(F.col(pos_col) < F.col("_n") - n).drop("_n")


def first_n(df: DataFrame, n: int, order_by) -> DataFrame:
    """FLT5 head(n): top-k by the order key (the limit is the feature)."""
    return df.orderBy(*[F.col(c).asc() for c in ([order_by] if isinstance(order_by, str) else order_by)]).limit(n)


def last_n(df: DataFrame, n: int, order_by) -> DataFrame:
    """FLT5 tail(n): top-k by descending order key."""
    return df.orderBy(*[F.col(c).desc() for c in ([order_by] if isinstance(order_by, str) else order_by)]).limit(n)


def first_per_batch(df: DataFrame, batch_col: str, value_col: str, order_col: str,
                    out: str = "prediction") -> DataFrame:
    """FLT8: first value of every batch by ``order_col`` (``predict(X)[0]``).
    A batch whose value is missing yields NULL."""
    return df.groupBy(batch_col).agg(F.min_by(F.col(value_col), F.col(order_col)).alias(out))


# ----------------------------------------------------------------------- sets

def concat_strict(*dfs: DataFrame) -> DataFrame:
    """SET1: vertical concat; schemas must match exactly (names and types)."""
    first = dfs[0]
    for d in dfs[1:]:
        if [(f.name, f.dataType) for f in d.schema.fields] != [(f.name, f.dataType) for f in first.schema.fields]:
            raise ValueError("concat_strict: schemas differ")
    out = first
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


class ConcatError(ValueError):
    pass


def concat_relaxed(*dfs: DataFrame) -> DataFrame:
    """SET2: vertical concat with numeric widening; a different column count
    or a non-numeric type clash is an error before any job runs."""
    n = len(dfs[0].columns)
    if any(len(d.columns) != n for d in dfs):
        raise ConcatError("Inconsistent prediction column counts")
    names = dfs[0].columns
    for c in names:
        ts = [d.schema[c].dataType if c in d.columns else None for d in dfs]
        if any(t is None for t in ts):
            raise ConcatError("Inconsistent prediction column counts")
        num = [isinstance(t, T.NumericType) for t in ts]
        if not (all(num) or len({t.simpleString() for t in ts}) == 1):
            raise ConcatError("Inconsistent prediction types")
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def concat_ignore_index(*dfs: DataFrame) -> DataFrame:
    """SET3: concat; row identity comes from key columns, not an index."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def distinct_in_order(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """SET5: distinct keys with their first-appearance position (order key of
    the first row); sort by ``first_pos`` to get the order."""
    return df.groupBy(key).agg(F.min(order_col).alias("first_pos"))
