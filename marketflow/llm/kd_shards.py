"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

Every row is a point: one integer for each metadata dimension (numbers as they are, other values by their
crc32, null as 0) and a weight, its size in bytes. A node that holds ``k`` shards is cut in two along its widest
dimension (extent over the extent of the whole table; of equal ones the first) at the weighted quantile that
gives ``k // 2`` shards their part, the weighted median where k is even, until every leaf is one shard. The
number of shards is given, or follows from ``target_bytes``.

A cut is exact. The rows are put in one total order (node, value in the node's dimension, crc32 of the text, id,
row number) by range partitions, which are written; sums by range and node give each range its offset, and a
running sum inside a range gives each row its place among the node's bytes. A row goes left when its middle lies
in the left part, so a cut misses its quantile by half a row at most. Rows of one value, one source or one text
are cut like any others: no group meets in one task. Only one row for each node (at most the number of shards) comes
to the driver. Texts are never shuffled; sizes and checksums are taken in the scan.

The law that holds is ``bytes``: shards are near equal in bytes. ``slot`` numbers the rows of a shard by (id, crc32,
row number) without gaps.

Defined cases: a null or empty text has size 1 and crc32 0; null ids come first in the order and are dimension
value 0; repeated rows are rows of their own (which of them comes first does not change the result); an empty
table gives no rows; a table with fewer rows than shards leaves shards empty. A dimension column that is not there is an
error. Input columns other than the text stay, except that columns with the names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.llm import common
from marketflow.session import shuffle_partitions

COLUMNS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
#: Metadata dimensions besides the size: columns of the input.
DIMENSIONS = ("doc_id", "source", "lang")


def coordinate(df: DataFrame, column: str) -> Column:
    """A column's value as an integer."""
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, T.IntegralType):
        whole = c.cast("bigint")
    elif isinstance(kind, T.NumericType):
        whole = F.floor(c.try_cast("double")).try_cast("bigint")
    else:
        whole = F.crc32(c.cast("string").cast("binary"))
    return F.coalesce(whole, F.lit(0).cast("bigint"))


def _ranges(rows: DataFrame, order: list[str], group: str, name: str) -> DataFrame:
    """``rows`` written in range partitions of ``order``, each row with the number ``__range`` of its own."""
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order)
    return common.written(dealt.withColumn("__range", F.spark_partition_id()), name)


def _running(rows: DataFrame, order: list[str], group: str, amount: Column) -> DataFrame:
    """``rows`` of ``_ranges`` plus ``__upto``: the sum of ``amount`` in the group up to and with the row."""
    parts = rows.groupBy("__range", group).agg(F.sum(amount).alias("__part"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("__range", group, F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("__upto", F.sum(amount).over(inside)).join(offsets, ["__range", group])
    return summed.withColumn("__upto", F.col("__upto") + F.col("__offset")).drop("__offset", "__range")


def _cut(rows: DataFrame, shards: dict[int, int], n_dims: int, name: str) -> tuple[DataFrame, dict[int, int]]:
    """One level: all nodes with several shards are cut. ``rows`` has __node (first shard of the node); ``shards``: their
    number by node."""
    dims = range(n_dims)
    extents = [f(F.col("__dims")[d]).alias(f"{n}{d}") for d in dims for n, f in (("a", F.min), ("b", F.max))]
    nodes = rows.groupBy("__node").agg(F.sum("__size").alias("total"), *extents).collect()  # at most one row for each shard
    span = [max((r[f"b{d}"] for r in nodes), default=0) - min((r[f"a{d}"] for r in nodes), default=0) for d in dims]
    plan = []
    for r in nodes:
        wide = [(r[f"b{d}"] - r[f"a{d}"]) / span[d] if span[d] else 0.0 for d in dims]
        plan.append((r["__node"], shards[r["__node"]], wide.index(max(wide)), int(r["total"])))
    table = rows.sparkSession.createDataFrame(plan, "__node int, __k int, __dim int, __total bigint")
    order = ["__value", "__crc", "__id", "__row"]
    at = rows.join(F.broadcast(table), "__node").withColumn("__value", F.element_at("__dims", F.col("__dim") + 1))
    left = (F.col("__k") / 2).cast("int")
    middle = (2 * F.col("__upto") - F.col("__size")).cast("decimal(38,0)") * F.col("__k")
    goes_left = (F.col("__k") == 1) | (middle <= (2 * F.col("__total")).cast("decimal(38,0)") * left)
    placed = _running(_ranges(at, order, "__node", name), order, "__node", F.col("__size"))
    cut = placed.withColumn("__node", F.when(goes_left, F.col("__node")).otherwise(F.col("__node") + left))
    after = dict(shards)
    for node, k in shards.items():
        if k > 1:
            after |= {node: k // 2, node + k // 2: k - k // 2}
    return cut.drop("__value", "__k", "__dim", "__total", "__upto"), after


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id",
              text_col: str = "text", dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """Input columns without the text, plus ``COLUMNS``. Give ``shards``, or ``target_bytes`` of a shard."""
    if (shards is None) == (target_bytes is None):
        raise ValueError("give either shards or target_bytes")
    carried = [c for c in docs.columns if c != text_col and c not in COLUMNS]
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = F.octet_length(text).cast("bigint") + 1
    rows = common.written(docs.select(
        F.struct(*(F.col(c) for c in carried)).alias("__kept"), size.alias("__size"), F.crc32(text).alias("__crc"),
        F.col(id_col).alias("__id"), F.array(*(coordinate(docs, c) for c in dimensions), size).alias("__dims"),
        F.monotonically_increasing_id().alias("__row"), F.lit(0).alias("__node")), "points")
    if shards is None:
        shards = max(1, -(-int(rows.agg(F.sum("__size")).first()[0] or 0) // target_bytes))
    nodes = {0: int(shards)}
    for level in range(max(0, shards - 1).bit_length()):
        rows, nodes = _cut(rows, nodes, len(dimensions) + 1, f"level{level}")
    order = ["__id", "__crc", "__row"]
    dealt = _ranges(rows.drop("__dims"), order, "__node", "slots")
    placed = _running(dealt, order, "__node", F.lit(1).cast("bigint"))
    return placed.select("__kept.*", F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
                         F.lit("bytes").alias("law"), F.col("__node").alias("shard"), (F.col("__upto") - 1).alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))


def _crc32_table() -> list[int]:
    """Table of CRC-32 (reflected polynomial EDB88320, a fixed value), made by its rule."""
    table = []
    for k in range(256):
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    return table


def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte with ``crc_table``."""
    bytes_ = (f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: (instr('0123456789ABCDEF', h[1]) - 1) * 16"
              " + instr('0123456789ABCDEF', h[2]) - 1)")
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_}::BIGINT[]), "
            "lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295)")


def _level_sql(k: int, source: str) -> str:
    """One level of cuts in SQL: nodes with k shards each (k a power of two)."""
    dims = ("d0", "d1", "d2", "d3")
    wide = ", ".join(f"coalesce((max({d}) - min({d}))::DOUBLE / nullif((SELECT max({d}) - min({d}) FROM {source}), 0), 0)" for d in dims)
    return f"""n{k} AS MATERIALIZED (SELECT node, sum(size)::HUGEINT AS total, [{wide}] AS wide FROM {source} GROUP BY node),
p{k} AS MATERIALIZED (SELECT r.*, n.total, [{', '.join(dims)}][list_position(n.wide, list_max(n.wide))] AS value
  FROM {source} r JOIN n{k} n USING (node)),
c{k} AS MATERIALIZED (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY value, crc, doc_id NULLS FIRST
  ROWS UNBOUNDED PRECEDING) AS upto FROM p{k}),
l{k} AS MATERIALIZED (SELECT doc_id, size, crc, {', '.join(dims)},
  CASE WHEN (2 * upto - size) * {k} <= 2 * total * {k // 2} THEN node ELSE node + {k // 2} END AS node FROM c{k})"""


def oracle(shards: int) -> str:
    """SQL of ``kd_shards(documents, shards)`` for a power of two."""
    levels, source, k = [], "l0", shards
    while k > 1:
        levels.append(_level_sql(k, source))
        source, k = f"l{k}", k // 2
    return f"""WITH t AS (SELECT {_crc32_table()}::BIGINT[] AS crc_table),
names AS MATERIALIZED (SELECT c, {_crc32_sql('c')} AS code FROM (SELECT source AS c FROM documents UNION SELECT lang FROM documents), t WHERE c IS NOT NULL),
l0 AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32_sql("coalesce(text, '')")} AS crc,
  coalesce(doc_id, 0) AS d0, coalesce((SELECT code FROM names WHERE c = source), 0) AS d1,
  coalesce((SELECT code FROM names WHERE c = lang), 0) AS d2, octet_length(encode(coalesce(text, ''))) + 1 AS d3, 0 AS node FROM documents, t),
{', '.join(levels)}
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, node::INT AS shard,
  row_number() OVER (PARTITION BY node ORDER BY doc_id NULLS FIRST, crc) - 1 AS slot, NULL::INT AS grown_shard FROM {source}"""
