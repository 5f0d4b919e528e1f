"""Scans and sinks (SRC1-SRC6).

Readers take an explicit schema, or infer one from the whole file in one extra
distributed pass (CSV without a schema), and normalise NaN to SQL NULL at load, so every later
operator can rely on ``isNull`` / ``dropna`` / ``avg`` skipping the same cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The NA tokens the pandas CSV reader turns into missing values
# by default (SRC1). The polars reader (SRC2) treats only the empty field as
# missing.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
POLARS_NA_TOKENS = [""]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Driver test tables: one parquet per table under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Turn floating NaN into NULL (the load-time rule of the data model)."""
    cols = cols if cols is not None else df.columns
    fl = {f.name for f in df.schema.fields
          if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(F.isnan(F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
        if c in fl and c in cols else F.col(c)
        for c in df.columns
    ])


def _csv_typed(raw: DataFrame, schema: T.StructType, na_tokens: list[str]) -> DataFrame:
    """Read every field as text, map NA tokens to NULL, then ``try_cast``.

    A value that does not parse becomes NULL instead of failing the job
    (non-strict cast, PRJ3), exactly like a declared-type reader with
    ``mode=PERMISSIVE`` but per cell instead of per row.
    """
    out = []
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        c = F.when(c.isin(*na_tokens), F.lit(None)).otherwise(c) if na_tokens else c
        if isinstance(f.dataType, T.StringType):
            out.append(c.alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            low = F.lower(F.trim(c))
            out.append(F.when(low == "true", F.lit(True))
                       .when(low == "false", F.lit(False)).alias(f.name))
        else:
            v = c.try_cast(f.dataType)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                v = F.when(F.isnan(v), F.lit(None)).otherwise(v)
            out.append(v.alias(f.name))
    return raw.select(*out)


def infer_csv_schema(spark: SparkSession, path: str, flavor: str = "pandas") -> T.StructType:
    """Types of a CSV file with header, from all its rows in one aggregation: boolean, bigint,
    double or string, the first that every present value parses as. In the pandas flavor
    an integer or boolean column with missing values is double or string, as there."""
    tokens = PANDAS_NA_TOKENS if flavor == "pandas" else POLARS_NA_TOKENS
    raw = spark.read.option("header", True).option("inferSchema", False).option("emptyValue", "") \
        .option("nullValue", "\u0000never\u0000").csv(path)
    aggs = []
    for i, name in enumerate(raw.columns):
        c = F.col(f"`{name}`")
        c = F.when(c.isin(*tokens), F.lit(None)).otherwise(c)
        whole = c.rlike(r"^\s*[+-]?[0-9]+\s*$") & c.try_cast("bigint").isNotNull()
        aggs += [F.count(F.lit(1)).alias(f"n{i}"), F.count(c).alias(f"v{i}"), F.count_if(whole).alias(f"i{i}"),
                 F.count_if(c.try_cast("double").isNotNull()).alias(f"d{i}"),
                 F.count_if(F.lower(F.trim(c)).isin("true", "false")).alias(f"b{i}")]
    row = raw.agg(*aggs).first() if aggs else {}

    def kind(i: int) -> T.DataType:
        n, v, ints, doubles, flags = (row[f"{k}{i}"] for k in "nvidb")
        missing = flavor == "pandas" and v < n
        if v and flags == v:
            return T.StringType() if missing else T.BooleanType()
        if v and ints == v:
            return T.DoubleType() if missing else T.LongType()
        return T.DoubleType() if doubles == v and (v or flavor == "pandas") else T.StringType()

    return T.StructType([T.StructField(name, kind(i), True) for i, name in enumerate(raw.columns)])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             flavor: str = "pandas") -> DataFrame:
    """SRC1 (``flavor='pandas'``) / SRC2 (``flavor='polars'``) CSV scan with header.

    The header is matched by name; the declared schema fixes the output types, and
    without one they are inferred (``infer_csv_schema``).
    """
    tokens = PANDAS_NA_TOKENS if flavor == "pandas" else POLARS_NA_TOKENS
    schema = infer_csv_schema(spark, path, flavor) if schema is None else schema
    text_schema = T.StructType([T.StructField(f.name, T.StringType(), True)
                                for f in schema.fields])
    raw = (spark.read.option("header", True).option("enforceSchema", False)
           .option("nullValue", "\u0000never\u0000").option("emptyValue", "")
           .schema(text_schema).csv(path))
    return _csv_typed(raw, schema, tokens)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None,
                 where: Column | None = None, where_cols: list[str] = ()) -> DataFrame:
    """SRC3: parquet scan with NaN normalised to NULL.

    Projection and filter are applied to the RAW columns before the NaN
    normalisation, so Catalyst pushes them into the scan (a predicate on the
    normalised ``CASE WHEN isnan(x) ...`` expression would not reach Parquet).
    ``where_cols`` names the floating columns the predicate reads: their NaN
    rows are excluded, exactly as the predicate on NULL would exclude them.
    """
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    if where is not None:
        guard = where
        for c in where_cols:
            guard = guard & ~F.isnan(F.col(c))
        df = df.where(guard)
    return nan_to_null(df)


def write_parquet(df: DataFrame, path: str) -> str:
    """SRC4: parquet sink (no index column), overwrite."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """SRC5: CSV sink with header. Doubles are written in shortest round-trip form."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


# Error kinds of a scoring run and their codes (FN10).
ERROR_TYPES = [
    (0, "UNSPECIFIED"),
    (1, "SERVER_NEVER_STARTED"),
    (2, "SERVER_CONNECTION_FAILED"),
    (3, "SERVER_RAISED_EXCEPTION"),
    (4, "SERVER_MISSING_ENDPOINT"),
    (5, "GATEWAY_RAISED_EXCEPTION"),
    (6, "INVALID_SUBMISSION"),
    (7, "GRPC_DEADLINE_EXCEEDED"),
]
MAX_ERROR_DETAILS = 8000


def error_name(code: Column) -> Column:
    """FN10: error code -> name as a literal map lookup (JVM side, no join)."""
    m = F.create_map(*[x for k, n in ERROR_TYPES for x in (F.lit(k), F.lit(n))])
    return m[code]


def run_report(checks: DataFrame, batch_col: str | None = None) -> DataFrame:
    """SRC6: one-row run report from a per-batch check table.

    ``checks`` has ``status`` ('ok' or an error text) and ``error_type`` (int,
    NULL when ok) per batch. The report carries the first failing batch, by
    ``batch_col`` (default: the first column). One global aggregate: partial per partition, one row out.
    """
    batch_col = batch_col or checks.columns[0]
    bad = F.col("status") != F.lit("ok")
    first = F.min_by(F.struct("error_type", "status"),
                     F.when(bad, F.col(batch_col)))
    agg = checks.agg(F.count_if(bad).alias("_n_bad"), first.alias("_first"))
    ok = F.col("_n_bad") == 0
    return agg.select(
        ok.alias("Succeeded"),
        F.when(~ok, F.col("_first.error_type")).cast("int").alias("ErrorType"),
        F.when(~ok, error_name(F.col("_first.error_type"))).alias("ErrorName"),
        F.when(~ok, F.substring(F.col("_first.status"), 1, MAX_ERROR_DETAILS)).alias("ErrorDetails"),
    )


def write_report(report: DataFrame, path: str) -> str:
    """SRC6 sink: the one-row report as JSON (coalesced: it is one row)."""
    report.coalesce(1).write.mode("overwrite").json(path)
    return path
