"""Vector code compression: each of ``parts`` equal pieces of a vector is replaced by the number of its nearest codebook
entry, found with a GNAT (geometric near-neighbour access tree) over the entries.

Components become whole numbers (floor of ``scale`` times a component), so all distances are exact. A part's codebook
starts as that part of the vectors with the ``entries`` smallest ids; each of ``rounds`` rounds assigns every part to
the nearest entry (ties to the lower number) and replaces an entry by the floor of the mean of its parts; unused
entries stay.

The tree: a node takes ``DEGREE`` of its entries as split points (farthest first), gives every other entry to the nearest
split point, and stores for each pair (split point, child) the least and largest distance from the split point to the
child's entries. A query measures the split points; with its best distance so far, r, a child is left out when the range
[d - r, d + r] of some split point's distance d does not touch the stored range: by the triangle inequality all of
its entries are then farther than r. Distances are rounded outwards by one unit in the last place and the test is
strict, so no entry that is as near as the best is lost; the comparison itself is made in squared integers, ties to
the lower number. All rows of a batch go down the tree together, as arrays.

How the work is dealt out. The whole-number vectors are written once. A round is one pass: every task returns sums and
counts for each (part, entry), one row each of fixed size, added up by Spark; the codebooks (parts x entries pieces)
are all that the driver holds.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, and so are rows whose vector has
not the length of the smallest id's (or is empty); ``parts`` must divide that length. Null ids come after all
others; of equal ids the one with the smaller hash of its vector is first. Components are limited to what keeps a squared
distance in a long (2**27 after scaling for 64 components). With fewer rows than ``entries`` the codebook has as
many entries as rows; an empty table gives no rows. Other columns stay, except that columns with the names
of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Split points of a tree node; a node of at most as many entries is a leaf.
DEGREE = 4
COLUMNS = ("code", "error")
_FAR = np.int64((1 << 63) - 1)


def _squared(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of all queries to all points."""
    out = np.zeros((len(queries), len(points)), np.int64)
    for k in range(queries.shape[1]):
        gap = queries[:, k, None] - points[None, :, k]
        out += gap * gap
    return out


def _below(squared):
    return np.nextafter(np.sqrt(np.asarray(squared, np.float64)), -np.inf)


def _above(squared):
    return np.nextafter(np.sqrt(np.asarray(squared, np.float64)), np.inf)


class Gnat:
    """Exact nearest entries (ties to the lower number) for many queries at once."""

    def __init__(self, entries: np.ndarray, degree: int = DEGREE):
        self.entries = np.asarray(entries, np.int64)
        self.degree = degree
        self.measured = 0
        self.root = self._node(np.arange(len(entries))) if len(entries) else None

    def _node(self, members: np.ndarray):
        """(split points, None) of a leaf; (split points, [(members' node, least, largest distance by split point)])."""
        if len(members) <= self.degree:
            return members, None
        near = _squared(self.entries[members], self.entries[members])
        splits, gap = [0], near[0]
        while len(splits) < self.degree:
            gap = gap.copy()
            gap[splits] = -1
            splits.append(int(np.argmax(gap)))
            gap = np.minimum(gap, near[splits[-1]])
        rest = np.setdiff1d(np.arange(len(members)), splits)
        owner = np.argmin(near[np.ix_(rest, splits)], axis=1)
        children = []
        for c in range(self.degree):
            own = rest[owner == c]
            if len(own):
                reach = near[np.ix_(splits, own)]
                children.append((self._node(members[own]), _below(reach.min(axis=1)), _above(reach.max(axis=1))))
        return members[splits], children

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry numbers and squared distances."""
        best = np.full(len(queries), _FAR), np.zeros(len(queries), np.int64)
        if self.root is not None and len(queries):
            self._visit(self.root, queries, np.arange(len(queries)), *best)
        return best[1], best[0]

    def _visit(self, node, queries, rows, far, number):
        splits, children = node
        gaps = _squared(queries[rows], self.entries[splits])
        self.measured += gaps.size
        for k, entry in enumerate(splits):
            better = (gaps[:, k] < far[rows]) | ((gaps[:, k] == far[rows]) & (entry < number[rows]))
            far[rows[better]], number[rows[better]] = gaps[better, k], entry
        low, high = _below(gaps), _above(gaps)
        for child, least, largest in children or ():
            reach = _above(far[rows])
            out = ((low - reach[:, None] > largest) | (high + reach[:, None] < least)).any(axis=1)
            if not out.all():
                self._visit(child, queries, rows[~out], far, number)


def _limit(length: int) -> int:
    """Bound of a component that keeps squared distances of vectors of this length below 2**62."""
    return math.isqrt((1 << 62) // length) // 2


def _assign(matrix: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """(entry numbers, squared distances), rows x parts."""
    width = matrix.shape[1] // len(trees)
    found = [t.nearest(matrix[:, p * width:(p + 1) * width]) for p, t in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(-1, length)


def _sums(rows: DataFrame, books: np.ndarray, length: int) -> DataFrame:
    """(part, entry, at, n, total): component sums of the parts assigned to each entry."""
    parts, entries, width = books.shape

    def run(batches):
        trees = [Gnat(b) for b in books]
        totals, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            matrix = _matrix(batch.column(0), length)
            number, _ = _assign(matrix, trees)
            for p in range(parts):
                np.add.at(totals[p], number[:, p], matrix[:, p * width:(p + 1) * width])
                counts[p] += np.bincount(number[:, p], minlength=entries)
        part, entry, at = (x.ravel() for x in np.indices(totals.shape))
        used = counts[part, entry] > 0
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x[used].astype(np.int32)) for x in (part, entry, at)), pa.array(counts[part, entry][used]),
             pa.array(totals.ravel()[used])], names=["part", "entry", "at", "n", "total"])

    sums = rows.select("vector").mapInArrow(run, "part int, entry int, at int, n bigint, total bigint")
    return sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(rows: DataFrame, first: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` rounds over rows (vector), from the first vectors."""
    length = first.shape[1]
    books = first.reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _sums(rows, books, length).collect():  # parts x entries x width rows at most
            books[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return books


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
                 rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows kept, without the vector, plus code and error; codebooks)."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    kept = df.where(vectors.usable(vector_col) & (F.size(vector_col) > 0))
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), F.xxhash64(vector_col)).select(vector_col).limit(entries).collect()
    names = [c for c in df.columns if c != vector_col and c not in COLUMNS]
    length = len(first[0][0]) if first else parts
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    limit = _limit(length)
    whole = F.transform(vector_col, lambda x: F.least(F.greatest(F.floor(x.cast("double") * scale), F.lit(-limit)), F.lit(limit)).cast("bigint"))
    rows = common.written(kept.where(F.size(vector_col) == length).select(
        F.struct(*(F.col(c) for c in names), F.lit(0).alias("__")).alias("kept"), whole.alias("vector")), "vectors")
    start = [[min(max(math.floor(float(x) * scale), -limit), limit) for x in r[0]] for r in first if len(r[0]) == length]
    books = train(rows, np.array(start, np.int64).reshape(-1, length), parts, rounds)

    def code(batches):
        trees = [Gnat(b) for b in books]
        for batch in batches:
            number, far = _assign(_matrix(batch.column(1), length), trees)
            text = number.astype(np.uint8).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([text[k:k + 2 * parts] for k in range(0, len(text), 2 * parts)], pa.string()),
                 pa.array(far.sum(axis=1))], names=["kept", *COLUMNS])

    coded = rows.mapInArrow(code, f"kept {rows.schema['kept'].dataType.simpleString()}, code string, error bigint")
    return coded.select(*(F.col("kept")[c].alias(c) for c in names), *COLUMNS), books


#: Rows of a table of sums by label up to which it may be broadcast.
BROADCAST_LABELS = 100_000


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """``coded`` plus label_error: the errors of equal labels added up (nulls together; null beyond a long)."""
    coded = common.written(coded, "coded")
    sums = common.written(coded.groupBy(F.col(label_col).alias("__label")).agg(F.try_sum("error").alias("label_error")), "label_errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col(label_col).eqNullSafe(F.col("__label"))).drop("__label")


def codebook_text(books: np.ndarray) -> str:
    """All components, by part, entry and position, joined by commas."""
    return ",".join(str(int(x)) for x in books.ravel())


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """SQL of the query: the rounds written out one after the other, by plain comparison of all entries."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS MATERIALIZED (SELECT x.vec, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS far
  FROM x JOIN b{r} b USING (part, pos) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec, part, min(entry) AS entry, any_value(far) AS far FROM
  (SELECT *, min(far) OVER (PARTITION BY vec, part) AS least FROM d{r}) WHERE far = least GROUP BY vec, part)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN
  (SELECT a.part, a.entry, x.pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM a{r} a JOIN x USING (vec, part) GROUP BY ALL) m
  USING (part, entry, pos))""")
    return f"""WITH k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS place, len(embedding) // {parts} AS width FROM k),
x AS MATERIALIZED (SELECT vec, place // width AS part, place % width AS pos, floor({scale} * x::DOUBLE)::BIGINT AS v FROM e),
b0 AS MATERIALIZED (SELECT part, vec - 1 AS entry, pos, v FROM x WHERE vec <= {entries}),
{', '.join(steps)},
c AS (SELECT vec, string_agg(lower(printf('%02x', entry::INT)), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY vec)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM k JOIN c USING (vec)"""
