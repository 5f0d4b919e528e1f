"""Substring deduplication with compressed FM-indexes: every word covered by a run of ``window`` words that
also starts in a document with a smaller id is removed.

How the work is dealt out. Each window of a document is given an anchor: the least of its word ``GRAM``-grams
in one order for all documents, rare grams (by a frequency sketch of fixed size over all documents) before
common ones. Windows with the same words have the same anchor, so a maximal run of windows with one anchor
(a segment) only has to meet segments of that anchor. Windows that reach beyond a very common passage hold a
rarer gram and choose that, so segments of a common anchor are the same words everywhere and are combined
before anything is shuffled by content. Anchors seen in a single document end there.

For anchors with different segments, shards of whole anchors are indexed: an FM-index over the distinct
segments, in which every segment is streamed from its right end. Backward search keeps the matching
statistics up to ``window`` words (beyond that the row range is widened to the ``window``-word group), and
windows whose group holds a smaller document id are reported as intervals.

Defined cases: words are runs of characters other than white space (\\x20, \\x09-\\x0D); a null or empty text
has no words and stays empty; texts shorter than the window lose nothing; a null id counts as larger than
all others; rows with the same id are one document (no row removes text of another with the same id) and
are judged row by row. Input columns stay, except that columns with the names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm import common
from marketflow.llm.common import U64
from marketflow.llm.fm_index import FMIndex

WINDOW = 50
#: Words of a gram that can be an anchor.
GRAM = 8
#: Segment text that one FM-index holds; an index ends at the next change of anchor.
SHARD_BYTES = 4 << 20
COLUMNS = ("n_words", "n_removed", "removed", "kept_text")
_LAST = (1 << 63) - 1


def _runs(words: common.Words, classes: np.ndarray, window: int, gram: int):
    """Segments of a slice: document number, anchor, first word, number of words."""
    at, doc = words.window_starts(window)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    grams = words.grams(gram)
    low = (classes[common.cell_of(grams)].astype(U64) << U64(58)) | (grams >> U64(6))
    width, least, size = window - gram + 1, low, 1
    while size * 2 <= width:
        least = np.minimum(least[:len(least) - size], least[size:])
        size *= 2
    least = np.minimum(least[:len(low) - width + 1], least[width - size:width - size + len(low) - width + 1])
    anchor = least[at]
    first = np.ones(len(at), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(first)
    count = np.diff(np.append(begin, len(at)))
    return doc[begin], anchor[begin].view(np.int64), at[begin], count + window - 1


def _segments(docs: DataFrame, classes, window: int, gram: int) -> DataFrame:
    """(doc, th, anchor, seg, start, n): segments of all documents; seg is a hash of the segment's words."""

    def run(batches):
        for piece in common.slices(batches):
            words = common.Words(piece.column(2))
            doc, anchor, start, n = _runs(words, classes.value, window, gram)
            seg = common.span_hash(words.hash, start, start + n)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0).take(pa.array(doc)), piece.column(1).take(pa.array(doc)), pa.array(anchor),
                 pa.array(seg.view(np.int64)), pa.array((start - words.doc[doc]).astype(np.int32)),
                 pa.array(n.astype(np.int32))], names=["doc", "th", "anchor", "seg", "start", "n"])

    return docs.mapInArrow(common.lean(run), "doc bigint, th binary, anchor bigint, seg bigint, start int, n int")


def search_shard(texts: pa.Array, owners: np.ndarray, window: int) -> list[list[int]]:
    """For each segment text: the runs of windows [a, b, a, b, ...] (by first word) that a segment of a
    smaller owner also holds."""
    words = common.Words(texts)
    _, codes = np.unique(words.hash, return_inverse=True)
    size = words.counts
    lanes = len(size)
    begin = np.cumsum(size + 1) - size - 1
    text = np.zeros(int(size.sum()) + lanes, np.int32)
    text[np.arange(len(codes)) + np.repeat(np.arange(lanes), size)] = codes + 1
    sigma = int(codes.max(initial=0)) + 2
    del words, codes
    index = FMIndex(text, sigma, limit=window + 1, keep_depth=window)
    sa, (rank, depth) = index.sa, index.kept
    index.sa = index.kept = None
    tail = rank[np.minimum(sa + (window - depth), len(text) - 1)]
    head = rank[sa]
    new = np.ones(len(sa), bool)
    new[1:] = (head[1:] != head[:-1]) | (tail[1:] != tail[:-1])
    del rank, tail, head
    starts = np.flatnonzero(new).astype(np.int32)
    stops = np.append(starts[1:], np.int32(len(sa)))
    group = np.cumsum(new, dtype=np.int32) - np.int32(1)
    by_owner, place = np.unique(owners, return_inverse=True)  # owners in order, as small numbers
    lane_at = np.repeat(place.astype(np.int32), size + 1)
    least = by_owner[np.minimum.reduceat(lane_at[sa], starts)]
    del sa, new, lane_at

    lo, hi = np.zeros(lanes, np.int64), np.full(lanes, len(text), np.int64)
    repeated = np.zeros(len(text), bool)
    live = np.argsort(-size, kind="stable")
    for step in range(int(size.max(initial=0))):
        live = live[:np.searchsorted(-size[live], -step, side="left")]
        pos = begin[live] + size[live] - 1 - step
        lo[live], hi[live] = index.extend(text[pos], lo[live], hi[live])
        if step >= window - 1:
            at = group[lo[live]]
            lo[live], hi[live] = starts[at], stops[at]
            repeated[pos] = least[at] < owners[live]
    edges = np.flatnonzero(np.diff(repeated.astype(np.int8), prepend=0, append=0))
    out: list[list[int]] = [[] for _ in range(lanes)]
    lane = np.searchsorted(begin, edges[::2], side="right") - 1
    for k, a, b in zip(lane.tolist(), (edges[::2] - begin[lane]).tolist(), (edges[1::2] - begin[lane]).tolist()):
        out[k] += [a, b]
    return out


def _searched(segments: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, owner, runs) of segments (anchor, seg, owner, text) of anchors that have several."""

    def run(batches):
        held, size, last = [], 0, None

        def flush(part):
            rows = pa.Table.from_batches(part).combine_chunks()
            owners = rows.column("owner").to_numpy()
            runs = search_shard(rows.column("text").chunk(0), owners, window)
            keep = pa.array([k for k, r in enumerate(runs) if r], pa.int64())
            found = rows.select(["anchor", "seg", "owner"]).take(keep)
            return found.append_column("runs", pa.array([r for r in runs if r], pa.list_(pa.int32()))).to_batches()

        for piece in common.slices(batches, limit=SHARD_BYTES // 4):
            anchors = piece.column(0).to_numpy()
            if size >= SHARD_BYTES:
                # whole anchors only: the open anchor goes on to the next index
                change = np.flatnonzero(anchors != last)
                if len(change):
                    held.append(piece.slice(0, int(change[0])))
                    yield from flush(held)
                    held, size = [], 0
                    piece, anchors = piece.slice(int(change[0])), anchors[change[0]:]
            held.append(piece)
            size += piece.column(3).nbytes
            last = anchors[-1]
        if held:
            yield from flush(held)

    dealt = segments.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(common.lean(run), "anchor bigint, seg bigint, owner bigint, runs array<int>")


def _fetched(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(anchor, seg, owner, text) of wanted segments, cut out of their owners' texts.

    All columns of ``docs`` are read, so that this join and the last one are fed by one exchange of the texts."""
    lists = wanted.groupBy(F.col("first.doc").alias("__doc"), F.col("first.th").alias("__th")).agg(
        F.collect_list(F.struct("anchor", "seg", "first.start", "first.n")).alias("__lists"))
    joined = docs.join(lists, ["__doc", "__th"])
    doc_at, text_at = joined.columns.index("__doc"), joined.columns.index(text_col)

    def run(batches):
        for piece in common.slices(batches, text_col):
            out = []
            for doc, text, lists in zip(*(piece.column(k).to_pylist() for k in (doc_at, text_at, piece.num_columns - 1))):
                words = text.encode().split()
                out += [(s["anchor"], s["seg"], doc, b" ".join(words[s["start"]:s["start"] + s["n"]]).decode()) for s in lists]
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                    names=["anchor", "seg", "owner", "text"])

    return joined.mapInArrow(common.lean(run), "anchor bigint, seg bigint, owner bigint, text string").dropDuplicates(["anchor", "seg"])


def repeated_intervals(base: DataFrame, text_col: str, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(__doc, __th, __spans): word intervals of documents (__doc, __th, text) that lie in windows seen in a
    smaller __doc."""
    spark = base.sparkSession
    docs = base.select(F.col("__doc").alias("doc"), F.col("__th").alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def cells(batches):
        for piece in common.slices(batches):
            words = common.Words(piece.column(0))
            yield common.cell_of(words.grams(gram)[words.window_starts(gram)[0]])

    counts = common.sketch(docs.select("text"), cells)
    classes = spark.sparkContext.broadcast(common.hot_classes(counts))
    found = common.written(_segments(docs, classes, window, gram), "segments")
    several = found.groupBy("anchor").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("anchor")
    shared = common.written(found.join(several, "anchor", "left_semi"), "shared")
    segs = common.written(shared.groupBy("anchor", "seg").agg(
        F.min(F.struct("doc", "th", "start", "n")).alias("first"), F.max("doc").alias("last")), "distinct")
    many = segs.groupBy("anchor").count().where("count > 1").select("anchor")
    runs = _searched(_fetched(base, segs.join(many, "anchor", "left_semi"), text_col), window)
    copies = shared.join(segs.where("first.doc < last").select("anchor", "seg", F.col("first.doc").alias("owner")),
                         ["anchor", "seg"]).where("doc > owner")
    whole = copies.select("doc", "th", F.array(F.col("start"), F.col("start") + F.col("n")).alias("span"))
    own = shared.join(runs, ["anchor", "seg"]).where("doc = owner")
    parts = own.select("doc", "th", "start", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("runs") - 1, F.lit(2)),
        lambda i: F.array(F.get("runs", i), F.get("runs", i + 1) + window - 1))).alias("r")).select(
        "doc", "th", F.transform("r", lambda x: x + F.col("start")).alias("span"))
    # a set: equal rows bring the same spans
    return whole.unionByName(parts).groupBy(
        F.col("doc").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_set("span").alias("__spans"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` plus n_words, n_removed, removed (merged word intervals) and kept_text."""
    common.prepare(docs.sparkSession)
    keys = {"__doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)),
            "__th": common.text_key(F.col(text_col))}
    base = docs.drop(*COLUMNS).withColumns(keys)
    joined = base.join(repeated_intervals(base, text_col, window), ["__doc", "__th"], "left").drop("__doc", "__th")
    names = joined.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for piece in common.slices(batches, text_col):
            n_words, n_removed, removed, kept = [], [], [], []
            for text, spans in zip(piece.column(names.index(text_col)).to_pylist(), piece.column(len(names)).to_pylist()):
                words = (text or "").encode().split()
                merged: list[list[int]] = []
                for a, b in sorted(spans or []):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in merged))
                removed.append([{"start": a, "end": b} for a, b in merged])
                for a, b in reversed(merged):
                    del words[a:b]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(removed, kind), pa.array(kept, pa.string())], names=[*names, *COLUMNS])

    return joined.mapInArrow(common.lean(cut), schema + ", n_words bigint, n_removed bigint, "
                             "removed array<struct<start:int,end:int>>, kept_text string")
