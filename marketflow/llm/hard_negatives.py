"""Hard-negative mining by slot-decomposed selection.

Vectors are made whole numbers (floor of ``scale`` times a component). For every anchor the other rows of its label
with the highest scores (inner products) are its positives; a negative of a positive with score p has another
label and a score between ``low`` and ``high`` times p. All windows of an anchor overlap, and all end at the
positives' upper limits: these limits cut the scores into disjoint slots, one from each limit down to the next
(the last down to the smallest lower limit). Each slot keeps its best ``negatives`` rows, so a row is
counted in one slot, whatever number of windows hold it. A window is the slots from its own limit downwards: its
rows are the first of these slots merged in descending order, cut at its own lower limit. Nothing beyond the best
``negatives`` of a slot can be among the first of a window, so the result is exact.

How the work is dealt out. Anchors and rows are dealt by a hash of their row number to blocks of about
``BLOCK_ROWS``; a task meets one block of rows with one block of anchors (a matrix product) and returns the best
few rows for each anchor (and slot). These are combined in rounds of ``FAN_IN`` blocks, so an anchor's
candidates never meet in one place in a number that grows with the table. Labels are no key of any shuffle: a label
that a third of the rows hold is like any other. The scores themselves are never written.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; vectors meet only
vectors of their own length; a null id is never an anchor and comes last among ties; rows with equal ids are
rows of their own, ordered by row number in the table as it was first written; no positives, or windows without rows,
give no rows; positives with a negative score have an empty window. Products are exact: in
doubles where they stay below 2**53, else in Python integers, and scores beyond a long are set to its ends.
The result has new columns only, so columns of the input cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketflow.llm import common, vectors

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: Window of a negative's score over its positive's, as numerators over ``WINDOW_OF``.
LOW, HIGH, WINDOW_OF = 3, 9, 10
#: Rows (and anchors) of a block; their product is the score matrix that a task holds.
BLOCK_ROWS = 4096
#: Blocks whose best rows are combined at once.
FAN_IN = 64
_LAST = (1 << 63) - 1
_BEST = "anchor bigint, slot int, score bigint, id bigint, uid bigint"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers, as int64."""
    top = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if top * top * max(1, a.shape[1]) < 2.0 ** 53:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in row] for row in m] for m in (a, b)]
    return np.array([[min(max(sum(x * y for x, y in zip(r, s)), -_LAST - 1), _LAST) for s in whole[1]] for r in whole[0]], np.int64)


def upper(score):
    """Largest score that is at most HIGH / WINDOW_OF of ``score`` (works on arrays and near the ends of a long)."""
    return score // WINDOW_OF * HIGH + score % WINDOW_OF * HIGH // WINDOW_OF


def lower(score):
    """Smallest score that is at least LOW / WINDOW_OF of ``score``."""
    return score // WINDOW_OF * LOW - (-(score % WINDOW_OF * LOW) // WINDOW_OF)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, earlier places first among ties."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.argsort(-scores[near], kind="stable")[:k]]
    return np.argsort(-scores, kind="stable")[:k]


def _tile(rows: pa.Table, anchors: pa.Table, pick) -> pa.Table:
    """The best rows of one block for each anchor of one block: ``pick(anchor number, scores, same label)`` gives (slot,
    places) of rows sorted by (id, uid)."""
    rows = rows.sort_by([("id", "ascending"), ("uid", "ascending")])
    uid, ids = rows.column("uid").to_numpy(), rows.column("id")
    label, anchor_uid = rows.column("label").to_numpy(), anchors.column("anchor_uid").to_numpy()
    out: dict[str, list] = {"anchor": [], "slot": [], "score": [], "at": []}
    mine = {n: (at, m) for n, at, m in vectors.by_length(anchors.column("anchor_vector"))}
    for n, at, matrix in vectors.by_length(rows.column("vector")):
        own, other = mine.get(n, (np.zeros(0, np.int64), np.zeros((0, n))))
        scores = products(other, matrix)
        for k, a in enumerate(own):
            same = label[at] == anchors.column("anchor_label")[int(a)].as_py()
            for slot, places in pick(int(a), scores[k], same, uid[at] == anchor_uid[a]):
                out["anchor"].append(np.full(len(places), anchor_uid[a]))
                out["slot"].append(np.full(len(places), slot))
                out["score"].append(scores[k][places])
                out["at"].append(at[places])
    whole = {c: np.concatenate([np.zeros(0, np.int64), *v]) for c, v in out.items()}
    place = pa.array(whole["at"])
    return pa.table({"anchor": pa.array(whole["anchor"], pa.int64()), "slot": pa.array(whole["slot"], pa.int32()),
                     "score": pa.array(whole["score"], pa.int64()), "id": ids.take(place).cast(pa.int64()),
                     "uid": pa.array(uid[whole["at"]], pa.int64())})


def _positives(k: int):
    def run(rows, anchors):
        def pick(a, scores, same, itself):
            places = np.flatnonzero(same & ~itself)
            yield 0, places[_first(scores[places], k)]

        return _tile(rows, anchors, pick)

    return run


def _slots(k: int):
    def run(rows, anchors):
        limits, floor = anchors.column("anchor_limits").to_pylist(), anchors.column("anchor_floor").to_pylist()

        def pick(a, scores, same, itself):
            ends = [*limits[a], floor[a] - 1]  # descending
            inside = np.flatnonzero(~same & (scores <= ends[0]) & (scores > ends[-1]))
            slot = np.searchsorted(-np.array(ends[:-1]), -scores[inside], side="right") - 1
            for s in np.unique(slot):
                places = inside[slot == s]
                yield int(s), places[_first(scores[places], k)]

        return _tile(rows, anchors, pick)

    return run


def _met(rows: DataFrame, anchors: DataFrame, blocks: tuple[int, int], run) -> DataFrame:
    """(block, anchor, slot, score, id, uid): every block of rows meets every block of anchors once."""
    n_rows, n_anchors = blocks
    block = F.pmod(F.xxhash64("uid"), F.lit(n_rows))
    spread = rows.withColumn("block", block).withColumn("tile", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)))).withColumn(
        "tile", F.col("block") * n_anchors + F.col("tile"))
    here = F.pmod(F.xxhash64("uid"), F.lit(n_anchors))
    dealt = anchors.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)))).withColumn("tile", F.col("__block") * n_anchors + here)
    # both sides may come from one table: names of their own keep the columns of the two apart
    dealt = dealt.select("tile", *(F.col(c).alias(f"anchor_{c}") for c in anchors.columns))

    def meet(key, left, right):
        best = run(left, right) if left.num_rows and right.num_rows else pa.table(
            {c: pa.array([], t) for c, t in (("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("uid", pa.int64()))})
        return best.add_column(0, "block", pa.array(np.full(best.num_rows, key[0].as_py() // n_anchors), pa.int64()))

    return spread.groupBy("tile").cogroup(dealt.groupBy("tile")).applyInArrow(meet, "block bigint, " + _BEST)


def _combined(best: DataFrame, k: int, n_blocks: int) -> DataFrame:
    """The first k rows of each (anchor, slot), combined in rounds over the blocks they come from."""
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), "uid"]
    while True:
        n_blocks = -(-n_blocks // FAN_IN)
        best = best.withColumn("block", F.floor(F.col("block") / FAN_IN))
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("anchor", "slot", "block").orderBy(*order))).where(F.col("rank") <= k)
        if n_blocks == 1:
            return best.drop("block")


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where ``anchor`` holds.

    ``anchor`` is a condition on the columns of ``df``."""
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    whole_label = isinstance(df.schema[label_col].dataType, T.IntegralType)
    label = F.col(label_col).cast("bigint") if whole_label else F.xxhash64(label_col)
    rows = common.written(df.where(F.col(label_col).isNotNull() & vectors.usable(vector_col)).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"), label.alias("label"),
        whole.alias("vector"), (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("is_anchor")), "rows")
    anchors = rows.where("is_anchor").drop("is_anchor")
    rows = rows.drop("is_anchor")
    blocks = max(1, -(-rows.count() // BLOCK_ROWS)), max(1, -(-anchors.count() // BLOCK_ROWS))
    best = _combined(_met(rows, anchors, blocks, _positives(positives)), positives, blocks[0])
    best = common.written(best.select("anchor", F.col("rank").alias("place"), "id", "score"), "positives")
    ends = best.where("score >= 0").groupBy("anchor").agg(
        F.reverse(F.array_sort(F.collect_set(_upper_column("score")))).alias("limits"), F.min(_lower_column("score")).alias("floor"))
    limited = common.written(anchors.join(ends.withColumnRenamed("anchor", "uid"), "uid"), "anchors")
    found = _combined(_met(rows, limited, blocks, _slots(negatives)), negatives, blocks[0])
    merged = found.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("down"), F.coalesce("id", F.lit(_LAST)).alias("by"), "uid", "slot", "score", "id"))).alias("rows"))
    suffix = F.slice(F.filter("rows", lambda x: (x["slot"] >= F.array_position("limits", _upper_column("positive_score")) - 1)
                              & (x["score"] >= _lower_column("positive_score"))), 1, negatives)
    pairs = best.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).where("positive_score >= 0")
    named = limited.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id"), "limits")
    return pairs.join(named, "anchor").join(merged, "anchor").select(
        "anchor_id", "positive_id", "positive_score", F.posexplode(suffix).alias("at", "n")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score",
        F.col("n.score").alias("negative_score"))


def _upper_column(score: str) -> Column:
    """``upper`` of a score of 0 or more."""
    return F.expr(f"{score} div {WINDOW_OF} * {HIGH} + {score} % {WINDOW_OF} * {HIGH} div {WINDOW_OF}")


def _lower_column(score: str) -> Column:
    """``lower`` of a score of 0 or more."""
    return F.expr(f"{score} div {WINDOW_OF} * {LOW} + ({score} % {WINDOW_OF} * {LOW} + {WINDOW_OF - 1}) div {WINDOW_OF}")


ORACLE = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10"""
