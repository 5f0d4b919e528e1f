"""Benchmark decontamination with an FM-index per shard of the training documents.

A shard is one slice of documents (a few MB of text). Its words become codes of the benchmark's own
vocabulary; a word outside it can be in no occurrence, so runs of known words, with a separator between
runs, are what the index holds. All test windows are searched backward at once through wavelet-matrix
ranks, occurrences are located by sampled suffix positions, and overlapping ones merge into removal spans.
Documents are never shuffled; the work grows with the text and, in blocks, with the benchmark.

Words: A-Z lower-cased, then runs of digits, letters a-z and characters beyond ASCII. A window is
``window`` consecutive words of an item; a shorter item (but not an empty one) is one window.

Defined cases: a null or empty text has no words, no hits and is not contaminated; items without words
have no window; an item id that is null counts hits but is in no item list; repeated items count once;
rows are judged one by one, so repeated rows give repeated results. Input columns stay, except that
columns with the names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm import common
from marketflow.llm.fm_index import FMIndex

WINDOW = 13
#: A document is contaminated when at least 1/20 of its words are hit.
MIN_SHARE = 20
#: Every SAMPLE-th text position of a shard keeps its suffix position.
SAMPLE = 8
#: Text of one benchmark block: what is collected and broadcast at once. More text makes more blocks.
BLOCK_BYTES = 8 << 20
#: Occurrences located at once.
LOCATE_ROWS = 1 << 20
COLUMNS = ("n_words", "n_hit", "spans", "items", "contaminated")


class TestBlock:
    """Windows of a block of benchmark items: codes over the block's vocabulary, and the items of each window."""

    __test__ = False

    def __init__(self, ids: list, texts: list, window: int):
        words = common.Words(pa.array(texts, pa.string()), common.ALNUM, lower=True)
        self.vocabulary = np.unique(words.hash)
        codes = np.searchsorted(self.vocabulary, words.hash) + 1
        rows: dict[bytes, set] = {}
        for name, a, b in zip(ids, words.doc[:-1], words.doc[1:]):
            for s in range(a, max(b - window + 1, a + (b > a))):
                rows.setdefault(codes[s:min(s + window, b)].tobytes(), set()).add(name)
        self.items = [sorted(str(x) for x in v if x is not None) for v in rows.values()]
        seqs = [np.frombuffer(k, codes.dtype) for k in rows]
        self.lengths = np.array([len(s) for s in seqs], np.int64)
        self.patterns = np.zeros((len(seqs), window), np.int64)
        for row, s in zip(self.patterns, seqs):
            row[window - len(s):] = s
        self.shortest = int(self.lengths.min()) if len(seqs) else 0

    def occurrences(self, words: common.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window number, word position in the slice) of every occurrence, in bounded pieces."""
        if not len(self.lengths) or not len(words.hash):
            return
        at = np.minimum(np.searchsorted(self.vocabulary, words.hash), len(self.vocabulary) - 1)
        codes = np.where(self.vocabulary[at] == words.hash, at + 1, 0)
        cut = codes == 0
        first = np.ones(len(codes), bool)
        first[1:] = cut[:-1]
        first[words.doc[:-1][words.counts > 0]] = True
        first &= ~cut
        starts = np.flatnonzero(first)
        stops = np.flatnonzero(np.append(first, True) | np.append(cut, True))
        ends = stops[np.searchsorted(stops, starts, side="right")]
        long = ends - starts >= self.shortest
        starts, size = starts[long], (ends - starts)[long]
        if not len(starts):
            return
        begin = np.cumsum(size + 1) - size - 1
        shift = starts - begin
        text = np.zeros(int(size.sum()) + len(size), np.int64)
        inner = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        text[inner] = codes[inner + np.repeat(shift, size)]
        index = FMIndex(text, len(self.vocabulary) + 1, sample=SAMPLE)
        lo, hi = index.count(self.patterns, self.lengths)
        found = np.flatnonzero(hi > lo)
        total = np.cumsum(hi[found] - lo[found])
        for a in range(0, int(total[-1]) if len(total) else 0, LOCATE_ROWS):
            rank = np.arange(a, min(a + LOCATE_ROWS, int(total[-1])))
            which = np.searchsorted(total, rank, side="right")
            rows = hi[found[which]] - (total[which] - rank)
            pos = index.locate(rows)
            yield found[which], pos + shift[np.searchsorted(begin, pos, side="right") - 1]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list, list]]:
    """The benchmark in blocks of about BLOCK_BYTES of text, each collected on its own."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k).distinct().collect() if n > 1 else rows.collect()
        yield [r[0] for r in block], [r[1] for r in block]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` plus n_words, n_hit, spans (merged removal spans in words, end exclusive), items (ids of
    the items with an occurring window, sorted as strings) and contaminated."""
    spark = docs.sparkSession
    common.prepare(spark)
    state = "__spans array<int>, __items array<string>, __words bigint"
    out = docs.drop(*COLUMNS).withColumns({"__spans": F.array().cast("array<int>"),
                                           "__items": F.array().cast("array<string>"), "__words": F.lit(0).cast("bigint")})
    names = out.columns[:-3]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[:-3]) + ", " + state
    for ids, texts in _blocks(benchmark, item_col, item_text_col):
        block = spark.sparkContext.broadcast(TestBlock(ids, texts, window))

        def search(batches, block=block):
            for piece in common.merged_slices(batches, text_col):
                yield _search(piece, names, text_col, block.value)

        out = out.mapInArrow(search, schema)
    hit = F.aggregate(F.sequence(F.lit(0), F.size("__spans") - 1, F.lit(2)), F.lit(0),
                      lambda n, i: n + F.get("__spans", i + 1) - F.get("__spans", i))
    spans = F.transform(F.sequence(F.lit(0), F.size("__spans") - 1, F.lit(2)),
                        lambda i: F.struct(F.get("__spans", i).alias("start"), F.get("__spans", i + 1).alias("end")))
    some = F.size("__spans") > 0
    return out.withColumns({
        "n_words": F.col("__words"), "n_hit": F.when(some, hit).otherwise(0).cast("bigint"),
        "spans": F.when(some, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")),
        "items": F.array_sort("__items"),
    }).withColumn("contaminated", (F.col("n_hit") > 0) & (MIN_SHARE * F.col("n_hit") >= F.col("n_words"))).drop(
        "__spans", "__items", "__words")


def _search(piece: pa.RecordBatch, names: list[str], text_col: str, block: TestBlock) -> pa.RecordBatch:
    words = common.Words(piece.column(names.index(text_col)), common.ALNUM, lower=True)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    pairs = []
    for which, pos in block.occurrences(words):
        np.add.at(cover, pos, 1)
        np.add.at(cover, pos + block.lengths[which], -1)
        doc = np.searchsorted(words.doc, pos, side="right") - 1
        pairs.append(np.unique(doc * len(block.items) + which))
    hit = np.cumsum(cover)[:-1] > 0
    spans, items = piece.column(len(names)), piece.column(len(names) + 1)
    if pairs:
        before, held = spans.to_pylist(), [set(x) for x in items.to_pylist()]
        for pair in np.unique(np.concatenate(pairs)).tolist():
            doc, which = divmod(pair, len(block.items))
            held[doc].update(block.items[which])
        for doc in np.unique(np.searchsorted(words.doc, np.flatnonzero(hit), side="right") - 1).tolist():
            a, b = words.doc[doc], words.doc[doc + 1]
            mask = hit[a:b].copy()
            for s, e in zip(before[doc][::2], before[doc][1::2]):
                mask[s:e] = True
            before[doc] = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)).tolist()
        spans = pa.array(before, pa.list_(pa.int32()))
        items = pa.array([sorted(x) for x in held], pa.list_(pa.string()))
    columns = [*piece.columns[:len(names)], spans, items, pa.array(words.counts, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "__spans", "__items", "__words"])
