"""Registered queries: sources/sinks, projection, filters, sets, joins
(SRC1-SRC6, PRJ1-PRJ18, FLT1-FLT8, SET1-SET5, JOIN1-JOIN3, ST3, FN8, FN10)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.functions.rowwise import EXCLUDE_COLUMNS, base_features, feature_groups
from marketflow.functions.scalar import classify_error, to_double, u1, u2
from marketflow.operators import joins, profile, schema
from marketflow.operators.series import add_position
from marketflow.plans.oracle import with_panel
from marketflow.plans.panel import PANEL_COLUMNS
from marketflow.plans.materialize import materialize
from marketflow.plans.linear_signal import MODEL_VARS
from marketflow.plans.registry import cached, panel, query, table
from marketflow.session import scratch_path
from marketflow.sources import io

P = PANEL_COLUMNS

# Rows at the end of the train table that recur in the test table.
TEST_TAIL_ROWS = 10


def panel_schema() -> T.StructType:
    ints = {"date_id": T.LongType(), "D1": T.IntegerType(), "D2": T.IntegerType()}
    return T.StructType([T.StructField(c, ints.get(c, T.DoubleType()), True) for c in P])


# -------------------------------------------------------------------- sources

def _csv_roundtrip(spark, sf_dir, flavor):
    p = panel(spark, sf_dir)
    path = io.write_csv(p, scratch_path(spark, "panel-csv"))
    return io.read_csv(spark, path, panel_schema(), flavor=flavor)


@query("fixture_panel", with_panel("SELECT * FROM panel"))
def q_panel(spark, sf_dir):
    """The daily panel itself: lineitem aggregated per ship date (exact distinct
    counts as pair aggregations), injected nulls, forward/lagged returns by
    lead/lag through halo blocks."""
    return panel(spark, sf_dir)


@query("src1_csv_scan_pandas", with_panel("SELECT * FROM panel"))
def q_src1(spark, sf_dir):
    """Panel written as CSV, read back with declared types and pandas NA tokens."""
    return _csv_roundtrip(spark, sf_dir, "pandas")


@query("src2_csv_scan_polars", with_panel("SELECT * FROM panel"))
def q_src2(spark, sf_dir):
    return _csv_roundtrip(spark, sf_dir, "polars")


@query("src1_src2_csv_scan_inferred", with_panel(
    "SELECT 'pandas' AS flavor, * REPLACE (CAST(D1 AS BIGINT) AS D1, CAST(D2 AS BIGINT) AS D2) FROM panel UNION ALL "
    "SELECT 'polars', * REPLACE (CAST(D1 AS BIGINT) AS D1, CAST(D2 AS BIGINT) AS D2) FROM panel"))
def q_src_inferred(spark, sf_dir):
    """Panel written as CSV and read back without a schema, in both flavors."""
    path = io.write_csv(panel(spark, sf_dir), scratch_path(spark, "panel-csv"))
    both = [io.read_csv(spark, path, flavor=f).withColumn("flavor", F.lit(f)) for f in ("pandas", "polars")]
    return both[0].unionByName(both[1])


@query("src3_parquet_scan",
       "SELECT event_id, ts, user_id, event_type, value FROM events WHERE value > 10")
def q_src3(spark, sf_dir):
    """Parquet scan with NaN->NULL, a pruned column set and a filter pushed
    into the scan (PushedFilters: value > 10)."""
    return io.read_parquet(spark, f"{sf_dir}/events.parquet",
                           columns=["event_id", "ts", "user_id", "event_type", "value"],
                           where=F.col("value") > 10, where_cols=["value"])


@query("src4_parquet_sink", with_panel("SELECT date_id, forward_returns FROM panel"))
def q_src4(spark, sf_dir):
    """PRJ17 score table written to parquet (no index) and read back."""
    s = schema.score_table(panel(spark, sf_dir), "date_id", F.col("forward_returns"), "forward_returns")
    path = io.write_parquet(s, scratch_path(spark, "scores-parquet"))
    return io.read_parquet(spark, path)


@query("src5_csv_sink", with_panel("SELECT date_id, forward_returns FROM panel"))
def q_src5(spark, sf_dir):
    s = schema.score_table(panel(spark, sf_dir), "date_id", F.col("forward_returns"), "forward_returns")
    path = io.write_csv(s, scratch_path(spark, "scores-csv"))
    st = T.StructType([T.StructField("date_id", T.LongType()), T.StructField("forward_returns", T.DoubleType())])
    return io.read_csv(spark, path, st, flavor="pandas")


# ST3 / JOIN3 input: labels act as the predictions for documents, one batch per source; toxic ones also
# send a prediction for an id that no batch expects.
_ALIGN_SQL = """
e AS (SELECT source AS batch_id, doc_id, count(*) AS n_exp FROM documents GROUP BY ALL),
p AS (SELECT doc_id FROM labels UNION ALL
      SELECT -1 - doc_id FROM labels WHERE toxic = 1),
r AS (SELECT coalesce(d.source, 'unknown') AS batch_id, p.doc_id, count(*) AS n_rcv
      FROM p LEFT JOIN documents d USING (doc_id) GROUP BY ALL),
j AS (SELECT coalesce(e.batch_id, r.batch_id) AS batch_id, coalesce(n_exp, 0) AS n_exp, coalesce(n_rcv, 0) AS n_rcv
      FROM e FULL OUTER JOIN r ON e.batch_id = r.batch_id AND e.doc_id = r.doc_id),
per AS (SELECT batch_id, CAST(sum(n_exp) AS BIGINT) AS n_expected, CAST(sum(n_rcv) AS BIGINT) AS n_received,
        CAST(count(*) FILTER (WHERE n_exp > 0 AND n_rcv = 0) AS BIGINT) AS n_missing,
        CAST(count(*) FILTER (WHERE n_exp = 0 AND n_rcv > 0) AS BIGINT) AS n_extra,
        CAST(count(*) FILTER (WHERE n_rcv > 1) AS BIGINT) AS n_dup
        FROM j GROUP BY batch_id),
chk AS (SELECT *,
  CASE WHEN n_expected = 0 THEN 'Missing row IDs for batch'
       WHEN n_received <> n_expected THEN printf('Invalid predictions: expected %d rows but received %d', n_expected, n_received)
       WHEN n_missing > 0 OR n_extra > 0 OR n_dup > 0 THEN 'Invalid predictions: row ids do not match'
       ELSE 'ok' END AS status,
  CAST(CASE WHEN n_expected = 0 THEN 5 WHEN NOT (n_received = n_expected AND n_missing = 0 AND n_extra = 0 AND n_dup = 0) THEN 6 END AS INTEGER) AS error_type
  FROM per)
"""


def _alignment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("batch_id"), "doc_id")
    labels = table(spark, sf_dir, "labels")
    # predictions for the labelled documents, and some for ids that no batch has
    preds = labels.select("doc_id").unionByName(labels.where("toxic = 1").select((-1 - F.col("doc_id")).alias("doc_id")))
    received = preds.join(docs, on="doc_id", how="left").withColumn("batch_id", F.coalesce("batch_id", F.lit("unknown")))
    return joins.alignment(docs, received, "batch_id", "doc_id")


@query("join3_st3_alignment_check", f"WITH {_ALIGN_SQL} SELECT * FROM chk")
def q_align(spark, sf_dir):
    """JOIN3/ST3: per-batch row alignment of predictions (labels) vs expected ids (documents)."""
    return _alignment(spark, sf_dir)


@query("src6_fn10_run_report", f"""WITH {_ALIGN_SQL},
agg AS (SELECT count(*) FILTER (WHERE status <> 'ok') AS n_bad,
               arg_min(error_type, CASE WHEN status <> 'ok' THEN batch_id END) AS et,
               arg_min(status, CASE WHEN status <> 'ok' THEN batch_id END) AS st FROM chk)
SELECT n_bad = 0 AS "Succeeded",
       CAST(CASE WHEN n_bad > 0 THEN et END AS INTEGER) AS "ErrorType",
       CASE WHEN n_bad > 0 THEN (['UNSPECIFIED','SERVER_NEVER_STARTED','SERVER_CONNECTION_FAILED',
            'SERVER_RAISED_EXCEPTION','SERVER_MISSING_ENDPOINT','GATEWAY_RAISED_EXCEPTION',
            'INVALID_SUBMISSION','GRPC_DEADLINE_EXCEEDED'])[et + 1] END AS "ErrorName",
       CASE WHEN n_bad > 0 THEN substr(st, 1, 8000) END AS "ErrorDetails"
FROM agg""")
def q_report(spark, sf_dir):
    """SRC6 + FN10: one-row run report of the alignment check, written as JSON
    and read back."""
    rep = io.run_report(_alignment(spark, sf_dir))
    path = io.write_report(rep, scratch_path(spark, "run-report"))
    st = T.StructType([T.StructField("Succeeded", T.BooleanType()), T.StructField("ErrorType", T.IntegerType()),
                       T.StructField("ErrorName", T.StringType()), T.StructField("ErrorDetails", T.StringType())])
    return spark.read.schema(st).json(path)


# ----------------------------------------------------------------- projection

def _load_train(spark, sf_dir):
    p = schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"})
    p = schema.cast_all_double(p, ("date_id",))
    return schema.all_but_last(p, TEST_TAIL_ROWS, "date_id").drop("pos")


def _load_test(spark, sf_dir):
    p = panel(spark, sf_dir)
    n = p.count()
    pos = add_position(p, "date_id")
    t = pos.where(F.col("pos") >= n - TEST_TAIL_ROWS).drop("pos").withColumn("is_scored", F.lit(True))
    t = schema.rename(t, {"lagged_forward_returns": "target"})
    return schema.cast_all_double(t, ("date_id",))


def load_train(spark, sf_dir):
    """Train table: PRJ1 rename, PRJ2/PRJ3 cast all but date_id, FLT4 head(-10).
    Written once per session (it is read by several fits and checks)."""
    return cached("train", spark, sf_dir, lambda: materialize(_load_train(spark, sf_dir)))


def load_test(spark, sf_dir):
    """Test table: the last 10 panel rows with ``is_scored`` and the lagged
    returns renamed to ``target`` (PRJ1), cast like the train table."""
    return cached("test", spark, sf_dir, lambda: materialize(_load_test(spark, sf_dir)))


def _dbl(c, alias=None):
    return f"CAST({c} AS DOUBLE) AS {alias or c}"


_TRAIN_SQL = ("train AS (SELECT date_id, " + ", ".join(
    _dbl(c, "target" if c == "market_forward_excess_returns" else None) for c in P if c != "date_id") +
    " FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10)")
_TEST_SQL = ("test AS (SELECT date_id, " + ", ".join(
    _dbl(c, "target" if c == "lagged_forward_returns" else None) for c in P if c != "date_id") +
    ", CAST(1.0 AS DOUBLE) AS is_scored FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) <= 10)")


@query("prj1_prj2_prj3_flt4_load_train", with_panel(
    "SELECT date_id, " + ", ".join(
        f"CAST({c} AS DOUBLE) AS {'target' if c == 'market_forward_excess_returns' else c}"
        for c in P if c != "date_id") +
    " FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10"))
def q_load_train(spark, sf_dir):
    return load_train(spark, sf_dir)


@query("prj3_try_cast_text",
       """SELECT event_id, TRY_CAST(props AS DOUBLE) AS props_num,
                 TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_num,
                 TRY_CAST(event_type AS DOUBLE) AS type_num,
                 CAST(value > 20 AS DOUBLE) AS big_flag
          FROM events""")
def q_prj3(spark, sf_dir):
    """PRJ3 non-strict cast on text: JSON text -> NULL, extracted number ->
    double, label text -> NULL, bool -> 1.0/0.0."""
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", to_double(F.col("props")).alias("props_num"),
                     to_double(F.get_json_object("props", "$.k")).alias("k_num"),
                     to_double(F.col("event_type")).alias("type_num"),
                     to_double(F.col("value") > 20).alias("big_flag"))


@query("prj5_prj6_derived_u1_u2", with_panel(
    "SELECT date_id, I2 - I1 AS U1, M11 / nullif((I2 + I9 + I7) / 3, 0) AS U2 FROM panel"))
def q_u(spark, sf_dir):
    p = panel(spark, sf_dir)
    return p.select("date_id", u1().alias("U1"), u2().alias("U2"))


def model_table(df):
    """PRJ4: ["date_id", "target"] + MODEL_VARS after deriving U1/U2."""
    d = df.withColumns({"U1": u1(), "U2": u2()})
    return schema.select_ordered(d, ["date_id", "target", *MODEL_VARS])


_MODEL_COLS_SQL = ("date_id, market_forward_excess_returns AS target, S2, E2, E3, P9, S1, S5, I2, P8, P10, P12, P13, "
                   "I2 - I1 AS U1, M11 / nullif((I2 + I9 + I7) / 3, 0) AS U2")


@query("prj4_select_model_columns", with_panel(f"SELECT {_MODEL_COLS_SQL} FROM panel"))
def q_prj4(spark, sf_dir):
    p = schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"})
    return model_table(p)


@query("prj7_prj8_split_x_y", with_panel(
    f"SELECT * EXCLUDE (date_id), target AS y FROM (SELECT {_MODEL_COLS_SQL} FROM panel)"))
def q_prj7(spark, sf_dir):
    """PRJ7 drop(date_id) / PRJ8 extract target, kept side by side on the row
    (a detached vector would lose the row identity)."""
    p = model_table(schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"}))
    x = schema.drop(p, ["date_id"])
    return x.withColumn("y", F.col("target"))


@query("prj9_agg16_group_profile", with_panel("""
SELECT g AS "group", CAST(n_columns AS BIGINT) AS n_columns, CAST(n_columns * n_rows AS BIGINT) AS n_cells,
       CAST(n_null AS BIGINT) AS n_null FROM (
  SELECT 'D' AS g, 2 AS n_columns, count(*) AS n_rows, count(*) FILTER (WHERE D1 IS NULL) + count(*) FILTER (WHERE D2 IS NULL) AS n_null FROM panel
  UNION ALL SELECT 'E', 3, count(*), count(*) - count(E1) + count(*) - count(E2) + count(*) - count(E3) FROM panel
  UNION ALL SELECT 'I', 4, count(*), 4 * count(*) - count(I1) - count(I2) - count(I7) - count(I9) FROM panel
  UNION ALL SELECT 'M', 3, count(*), 3 * count(*) - count(M1) - count(M2) - count(M11) FROM panel
  UNION ALL SELECT 'P', 5, count(*), 5 * count(*) - count(P8) - count(P9) - count(P10) - count(P12) - count(P13) FROM panel
  UNION ALL SELECT 'S', 3, count(*), 3 * count(*) - count(S1) - count(S2) - count(S5) FROM panel
  UNION ALL SELECT 'V', 3, count(*), 3 * count(*) - count(V1) - count(V2) - count(V3) FROM panel)"""))
def q_groups(spark, sf_dir):
    """PRJ9 prefix groups + AGG16 group sizes, with cell and null counts from
    one aggregation of the panel."""
    p = panel(spark, sf_dir)
    return profile.group_profile(p, feature_groups(p.columns))


@query("prj10_base_features", with_panel(
    "SELECT * EXCLUDE (date_id, forward_returns, risk_free_rate, market_forward_excess_returns) FROM panel"))
def q_base(spark, sf_dir):
    p = panel(spark, sf_dir)
    return schema.select_ordered(p, base_features(p.columns, EXCLUDE_COLUMNS))


_COMMON = [c if c != "market_forward_excess_returns" else "target" for c in P
           if c not in ("lagged_forward_returns",)]


@query("prj11_set1_concat_train_test", with_panel(
    "SELECT " + ", ".join(_COMMON) + " FROM train UNION ALL SELECT " + ", ".join(_COMMON) + " FROM test",
    _TRAIN_SQL + ",\n" + _TEST_SQL))
def q_join_tt(spark, sf_dir):
    """PRJ11 common columns in train order + SET1 strict vertical concat."""
    tr, te = load_train(spark, sf_dir), load_test(spark, sf_dir)
    common = schema.common_columns(tr, te)
    return schema.concat_strict(tr.select(*common), te.select(*common))


@query("prj12_numeric_only", with_panel(
    "SELECT * EXCLUDE (lagged_forward_returns, is_scored) FROM "
    "(SELECT *, market_forward_excess_returns > 0 AS is_scored FROM panel)"))
def q_numeric(spark, sf_dir):
    """PRJ12: numeric columns only; a boolean column is excluded."""
    p = panel(spark, sf_dir).drop("lagged_forward_returns") \
        .withColumn("is_scored", F.col("market_forward_excess_returns") > 0)
    return p.select(*profile.numeric_columns(p))


@query("prj13_prj14_vector_roundtrip", with_panel(f"SELECT {_MODEL_COLS_SQL} FROM panel"))
def q_vec(spark, sf_dir):
    """PRJ13 columns -> vector, PRJ14 vector -> named columns."""
    p = model_table(schema.rename(panel(spark, sf_dir), {"market_forward_excess_returns": "target"}))
    v = schema.to_vector(p, MODEL_VARS)
    return schema.from_vector(v, "features", MODEL_VARS, keep=["date_id", "target"])


@query("prj15_prj16_attach_ids", """
SELECT d.doc_id, d.source, d.lang, CAST(l.quality AS DOUBLE) AS prediction
FROM labels l LEFT JOIN documents d USING (doc_id)""")
def q_ids(spark, sf_dir):
    """PRJ16 attach id columns by key (never positionally) + PRJ15 ids first."""
    pred = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("prediction"),
                                                 F.lit("stale").alias("source"))
    ids = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    out = schema.attach_ids(pred, ids, "doc_id")
    return schema.ids_first(out, ["doc_id", "source", "lang"])


@query("prj17_prj18_named_scores", with_panel(
    "SELECT CAST(date_id AS BIGINT) AS batch_id, CAST(lagged_forward_returns AS DOUBLE) AS prediction FROM panel"))
def q_named(spark, sf_dir):
    """PRJ17 (id, score) table, PRJ18 typed/named output with default names."""
    p = panel(spark, sf_dir)
    s = schema.score_table(p, "date_id", F.col("lagged_forward_returns"), "value")
    return schema.named_scores(s.withColumnRenamed("date_id", "batch_id"))


# -------------------------------------------------------------------- filters

@query("flt1_equality_filter", "SELECT * FROM events WHERE event_type = 'purchase'")
def q_flt1(spark, sf_dir):
    return schema.where_equal(table(spark, sf_dir, "events"), "event_type", "purchase")


@query("flt2_join1_semi_join", """
SELECT * FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 5000)""")
def q_semi(spark, sf_dir):
    """FLT2 ``is_in`` / JOIN1 left-semi: orders of high-balance customers."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").where(F.col("c_acctbal") > 5000) \
        .select(F.col("c_custkey").alias("o_custkey"))
    return joins.semi_join(o, c, "o_custkey")


@query("flt3_drop_nulls", with_panel("SELECT * FROM panel WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in P)))
def q_flt3(spark, sf_dir):
    return schema.drop_nulls(panel(spark, sf_dir))


@query("flt4_all_but_last_n", with_panel(
    "SELECT * FROM panel QUALIFY row_number() OVER (ORDER BY date_id DESC) > 10"))
def q_flt4(spark, sf_dir):
    return schema.all_but_last(panel(spark, sf_dir), TEST_TAIL_ROWS, "date_id").drop("pos")


@query("flt5_head_tail", """
SELECT 'head' AS part, * FROM (SELECT * FROM events ORDER BY ts LIMIT 5)
UNION ALL SELECT 'tail' AS part, * FROM (SELECT * FROM events ORDER BY ts DESC LIMIT 5)""")
def q_flt5(spark, sf_dir):
    """FLT5: first / last 5 rows in time order (top-k; the limit is the feature)."""
    ev = table(spark, sf_dir, "events")
    h = schema.first_n(ev, 5, "ts").select(F.lit("head").alias("part"), "*")
    t = schema.last_n(ev, 5, "ts").select(F.lit("tail").alias("part"), "*")
    return h.unionByName(t)


@query("flt8_set4_first_per_batch", """
SELECT user_id AS batch_id, arg_min(value, ts) AS prediction FROM events GROUP BY user_id""")
def q_flt8(spark, sf_dir):
    """FLT8 first prediction of each batch + SET4 scalars -> keyed column."""
    ev = table(spark, sf_dir, "events").withColumnRenamed("user_id", "batch_id")
    return schema.first_per_batch(ev, "batch_id", "value", "ts")


# ----------------------------------------------------------------------- sets

@query("set2_concat_relaxed", """
SELECT doc_id AS batch_id, CAST(quality AS DOUBLE) AS prediction FROM labels
UNION ALL SELECT event_id AS batch_id, value AS prediction FROM events""")
def q_set2(spark, sf_dir):
    """SET2: int and double predictions concatenated with widening."""
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("batch_id"), F.col("quality").alias("prediction"))
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_id"), F.col("value").alias("prediction"))
    return schema.concat_relaxed(a, b)


@query("set3_concat_ignore_index", """
SELECT doc_id, quality, toxic, NULL::VARCHAR AS lang FROM labels
UNION ALL SELECT doc_id, NULL::INTEGER, NULL::INTEGER, lang FROM documents""")
def q_set3(spark, sf_dir):
    a = table(spark, sf_dir, "labels")
    b = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return schema.concat_ignore_index(a, b)


@query("set5_distinct_in_order", "SELECT user_id, min(event_id) AS first_pos FROM events GROUP BY user_id")
def q_set5(spark, sf_dir):
    """SET5: distinct ids keeping first-appearance order (sort by first_pos)."""
    return schema.distinct_in_order(table(spark, sf_dir, "events"), "user_id", "event_id")


# ------------------------------------------------------- error classification

_MSG = """CASE event_type
  WHEN 'error' THEN concat('<_InactiveRpcError: "Exception calling application: value ', printf('%.2f', value), ' out of range">')
  WHEN 'signup' THEN 'No listener for predict was registered'
  WHEN 'view' THEN 'Failed to connect to server after waiting 900 seconds'
  ELSE concat('exception calling application without quotes ', event_type) END"""


@query("fn8_classify_errors", f"""
SELECT event_id, msg,
  CAST(CASE WHEN contains(msg, 'Failed to connect to server after waiting') THEN 1
            WHEN contains(msg, 'No listener for predict was registered') THEN 4
            WHEN contains(msg, 'Exception calling application') THEN 3 END AS INTEGER) AS error_type,
  CASE WHEN contains(msg, 'Failed to connect to server after waiting') THEN NULL
       WHEN contains(msg, 'No listener for predict was registered') THEN 'Server did not register a listener for predict'
       WHEN contains(msg, 'Exception calling application') THEN
            coalesce(nullif(regexp_extract(msg, '"Exception calling application: (.*)"', 1, 'i'), ''), msg)
       ELSE msg END AS details
FROM (SELECT event_id, {_MSG} AS msg FROM events)""")
def q_fn8(spark, sf_dir):
    """FN8: server error messages (one per event, built from the event) classified
    by ordered substring tests and a case-insensitive regex extraction."""
    ev = table(spark, sf_dir, "events")
    v = F.format_string("%.2f", F.col("value"))
    msg = (F.when(F.col("event_type") == "error",
                  F.concat(F.lit('<_InactiveRpcError: "Exception calling application: value '), v,
                           F.lit(' out of range">')))
           .when(F.col("event_type") == "signup", F.lit("No listener for predict was registered"))
           .when(F.col("event_type") == "view", F.lit("Failed to connect to server after waiting 900 seconds"))
           .otherwise(F.concat(F.lit("exception calling application without quotes "), F.col("event_type"))))
    m = ev.select("event_id", msg.alias("msg"))
    et, det = classify_error(F.col("msg"))
    return m.select("event_id", "msg", et.alias("error_type"), det.alias("details"))
