"""Shared helpers of the text operators: columnar word splitting and hashing over Arrow
batches, bounded batch slicing, frequency sketches of fixed size, and written lineage cuts.

Words are found and hashed with a few numpy passes over the UTF-8 buffer of a whole
batch slice, so no per-word Python object is made.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.session import scratch_path

U64 = np.uint64
#: Bytes of text that one columnar step works on at a time (a longer single text is one step).
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch sent to Python; bounds the memory of batches of long texts.
ARROW_ROWS = 1000
#: Cells of a frequency sketch: a fixed size, whatever the input.
SKETCH_CELLS = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def prepare(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch (long texts) for the Python stages of this session."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut: write Parquet to a fresh path in the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """128 bits of a text: with the id the key of a row, also where many rows share a (null) id."""
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.coalesce(key, F.lit(b""))  # never null, and known to be so: joins need no filter on it


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a partition; the worker, which lives on for other stages, then gives the memory
    of freed arrays and Arrow buffers back to the system."""

    def partition(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim()

    return partition


def trim() -> None:
    """Hand freed memory back to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def byte_table(word: Callable[[int], bool]) -> np.ndarray:
    return np.array([word(b) for b in range(256)], dtype=bool)


#: Bytes of words [^\x20\x09-\x0D]+ ; every byte of a multi-byte character belongs to a word.
NON_SPACE = byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
ALNUM = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants, fixed values)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, U64(_BASE)), np.full(size, U64(_INV))
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """What ``span_hash`` needs of the values, for callers that hash spans of the same values several times."""
    n = len(values)
    up, _ = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    return sums


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hash of values[start:end] for every span, by prefix sums (position independent)."""
    sums = prefix_sums(values) if sums is None else sums
    _, down = _POWERS.get(len(values) + 1)
    out = (sums[end] - sums[start]) * down[start]
    return mix(out + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


class Words:
    """Words of the texts of one slice: byte spans, 64-bit hashes, and word offsets by document."""

    def __init__(self, texts: pa.Array, table: np.ndarray = NON_SPACE, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        _, off, buf = texts.buffers()
        n = len(texts)
        offsets = np.frombuffer(off, np.int64, n + 1 + texts.offset)[texts.offset:]
        base, last = int(offsets[0]), int(offsets[-1])
        raw = np.frombuffer(buf, np.uint8)[base:last] if buf is not None and last > base else np.zeros(0, np.uint8)
        data = _LOWER[raw] if lower else raw
        self.offsets = offsets - base
        self.raw, self.data = raw, data
        word = table[data]
        first, final = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        final[:-1] &= ~word[1:]
        size = np.diff(self.offsets)
        begin = self.offsets[:-1][size > 0]
        stop = self.offsets[1:][size > 0] - 1
        first[begin] = word[begin]
        final[stop] = word[stop]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(final) + 1
        self.doc = np.searchsorted(self.start, self.offsets)
        self.hash = span_hash(data, self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each position (positions near the end of the slice are cut off)."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, U64)
        acc = np.zeros(m, U64)
        for k in range(n):
            acc = acc * U64(_BASE) + self.hash[k:k + m]
        return mix(acc)

    def window_starts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Start positions of all n-word windows inside documents, and their document numbers."""
        per = np.maximum(self.counts - n + 1, 0)
        doc = np.repeat(np.arange(len(per)), per)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        return self.doc[:-1][doc] + inner, doc


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece are about ``limit`` bytes (one long text may exceed it)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, begin = np.cumsum(size), 0
        while begin < len(size):
            before = total[begin - 1] if begin else 0
            stop = max(begin + 1, int(np.searchsorted(total, before + limit, side="right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def merged_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                  limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Like ``slices``, but small batches are put together first, so that one piece is about ``limit`` bytes."""
    held, size = [], 0
    for piece in slices(batches, column, limit):
        n = piece.column(piece.schema.get_field_index(column)).nbytes
        if held and size + n > limit:
            yield _together(held)
            held, size = [], 0
        held.append(piece)
        size += n
    if held:
        yield _together(held)


def _together(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(pieces) == 1:
        return pieces[0]
    return pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]


def sketch(df: DataFrame, cells: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Counts of hashed items in SKETCH_CELLS cells over all rows: one array of fixed size per
    partition, added up in a tree. ``cells`` yields arrays of cell numbers."""

    def count(batches):
        out = np.zeros(SKETCH_CELLS, np.int64)
        for c in cells(batches):
            out += np.bincount(c, minlength=SKETCH_CELLS)
        out = out.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([out.tobytes()], pa.binary())})

    parts = df.mapInArrow(lean(count), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.uint32).astype(np.int64))
    add = lambda a, b: a + b
    return parts.treeAggregate(0, add, add, 3) + np.zeros(SKETCH_CELLS, np.int64)


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(46)).astype(np.int64)


def hot_classes(counts: np.ndarray) -> np.ndarray:
    """0 for cells of usual load, and the binary order of magnitude beyond it for hot cells."""
    usual = 8 * float(counts.mean()) + 64
    return np.maximum(0, np.floor(np.log2(np.maximum(counts, 1) / usual)) + 1).astype(np.uint8)
