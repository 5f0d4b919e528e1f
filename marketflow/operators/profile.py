"""Missing-value profile and column statistics (AGG1-AGG9, AGG16, FLT7).

Each profile is ONE aggregation over the table (map-side partial aggregates,
a single tiny final merge), then reshaped to a long table with ``unpivot`` so
downstream filters (FLT7) and counts (AGG6) are ordinary DataFrame ops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame, include_bool: bool = False) -> list[str]:
    """PRJ12: numeric columns in table order; booleans excluded by default."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType) or (include_bool and isinstance(f.dataType, T.BooleanType)):
            out.append(f.name)
    return out


def column_stats(df: DataFrame, col: str) -> DataFrame:
    """AGG1-AGG3: mean, sample std, min, max of one column (nulls skipped)."""
    c = F.col(col)
    return df.agg(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                  F.min(c).alias("min"), F.max(c).alias("max"))


def prediction_stats(df: DataFrame, col: str) -> DataFrame:
    """AGG4: mean, POPULATION std, min, max."""
    c = F.col(col)
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"),
                  F.min(c).alias("min"), F.max(c).alias("max"))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AGG5: long table (column, n_null), one row per column, table order kept
    in ``col_idx``."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(cols)])
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("col_idx"), F.lit(c).alias("column"), F.col(f"c{i}").alias("n_null"))
        for i, c in enumerate(cols)]))
    return wide.select(stack.alias("s")).select("s.col_idx", "s.column", "s.n_null")


def columns_with_nulls(nulls: DataFrame) -> DataFrame:
    """FLT7: keep only columns that have missing values."""
    return nulls.where(F.col("n_null") > 0)


def missing_summary(df: DataFrame) -> DataFrame:
    """AGG6-AGG8 in one aggregation: rows, columns, columns with nulls, total
    nulls and the missing ratio in percent."""
    n_cols = len(df.columns)
    per = [F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"), F.array(*per).alias("_nn"))
    total = F.aggregate("_nn", F.lit(0).cast("long"), lambda a, x: a + x)
    return agg.select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_cols"),
        F.size(F.filter("_nn", lambda x: x > 0)).cast("long").alias("n_cols_with_nulls"),
        total.alias("n_null_cells"),
        F.when(F.col("n_rows") > 0, total * 100.0 / (F.col("n_rows") * F.lit(n_cols))).alias("missing_pct"),
    )


def group_profile(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """AGG16 (+PRJ9): per feature group, its column count, cell count and null
    cells, from one aggregation over the table."""
    parts = []
    for g, cols in groups.items():
        nn = sum((F.count_if(F.col(c).isNull()) for c in cols), F.lit(0).cast("long")) if cols else F.lit(0).cast("long")
        parts.append(F.struct(F.lit(g).alias("group"), F.lit(len(cols)).cast("long").alias("n_columns"),
                              nn.alias("n_null")))
    agg = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*parts).alias("_g"))
    return agg.select("_rows", F.explode("_g").alias("g")).select(
        "g.group", "g.n_columns", (F.col("g.n_columns") * F.col("_rows")).alias("n_cells"), "g.n_null")
