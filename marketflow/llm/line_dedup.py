"""Line deduplication by winnowed line hashes.

Every non-blank line is hashed. Of each ``WINDOW`` consecutive lines of a document the one with the least hash is an
anchor (the last of equal ones). Anchors are joined on their line hash with the first anchor in the corpus (by id,
then place) that has it, and a match is extended both ways as long as the neighbouring line hashes agree, by up to
``WINDOW`` lines, where the next anchor is. Matches of at least ``WINDOW`` lines, and matched anchors of at least
``LONG_WORDS`` words, are runs of an earlier copy.

No window guarantees a shared run of fewer than ``WINDOW`` lines, nor one whose anchor stands elsewhere before. So what
lies in no matched run is joined by itself with its first position: every line of at least ``LONG_WORDS`` words (1, so
every non-blank line), and windows that hold a shorter line. A first position lies in no matched run, since a
matched run has an earlier copy, so none is missed. The lines of later positions are deleted, adjoining ones as one
run; the first copy stays.

A hash's positions are combined to their first one before the shuffle, and joined back by key, so a
line that a third of the documents share is never gathered in one place.

Defined cases: null and empty texts have no lines and come back unchanged; blank lines are never deleted; rows
of one id are ordered by a hash of their text, and equal rows are one document (both keep what it keeps); a
null id comes after all others. Input columns stay, except that columns with the names of ``COLUMNS`` are
replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketflow.llm import common
from marketflow.llm.common import U64

WINDOW = 2
#: Least number of words of a line that is deleted without its neighbours.
LONG_WORDS = 1
LINE = common.byte_table(lambda b: b != 0x0A)
COLUMNS = ("n_lines", "deleted", "clean_text")
_LAST = (1 << 63) - 1


class Lines:
    """Non-blank lines of a slice: hashes, word counts, and line offsets by document."""

    def __init__(self, texts: pa.Array):
        lines, words = common.Words(texts, LINE), common.Words(texts)
        n_words = np.searchsorted(words.start, lines.end) - np.searchsorted(words.start, lines.start)
        some = n_words > 0
        before = np.append(0, np.cumsum(some))
        self.hash, self.words = lines.hash[some], n_words[some]
        self.start, self.end = lines.start[some], lines.end[some]
        self.doc = before[lines.doc]
        self.counts = np.diff(self.doc)

    @classmethod
    def of(cls, hashes: pa.Array, words: pa.Array) -> Lines:
        """From the bytes of each document's line hashes and word counts; without places in a text."""
        out = object.__new__(cls)
        hashes, words = hashes.to_pylist(), words.to_pylist()
        out.hash, out.words = np.frombuffer(b"".join(hashes), U64), np.frombuffer(b"".join(words), np.int32)
        out.counts = np.array([len(h) // 8 for h in hashes], np.int64)
        out.doc = np.append(0, np.cumsum(out.counts))
        return out

    def packed(self) -> tuple[pa.Array, pa.Array]:
        """What ``of`` takes."""
        hashes, words = self.hash.tobytes(), np.minimum(self.words, (1 << 31) - 1).astype(np.int32).tobytes()
        spans = list(zip(self.doc[:-1].tolist(), self.doc[1:].tolist()))
        return pa.array([hashes[8 * a:8 * b] for a, b in spans], pa.binary()), pa.array([words[4 * a:4 * b] for a, b in spans], pa.binary())


def fingerprints(lines: Lines, window: int):
    """(document, place, least line hash, content hash, number of lines) of all windows."""
    per = np.maximum(lines.counts - window + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    at = lines.doc[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    least, content = np.full(len(at), U64(0xFFFFFFFFFFFFFFFF)), np.zeros(len(at), U64)
    for k in range(window):
        here = lines.hash[at + k]
        least = np.minimum(least, here)
        content = common.mix(content ^ here) + U64(k + 1)
    return doc, at - lines.doc[:-1][doc], least, content, np.full(len(at), window)


def anchors(lines: Lines, window: int):
    """(document, number of the line in the slice) of the lines that have the least hash of a window, each once."""
    doc, place, least, _, _ = fingerprints(lines, window)
    first = lines.doc[:-1][doc] + place
    at = first.copy()
    for k in range(1, window):
        here = lines.hash[first + k] == least
        at[here] = first[here] + k
    at = np.unique(at)
    return np.searchsorted(lines.doc, at, side="right") - 1, at


def positions(lines: Lines, window: int):
    """(document, place, content hash, number of lines) of all that is joined: lines of at least ``LONG_WORDS``
    words, and windows with a shorter line."""
    long = np.flatnonzero(lines.words >= LONG_WORDS)
    doc = np.searchsorted(lines.doc, long, side="right") - 1
    found = doc, long - lines.doc[:-1][doc], ~lines.hash[long], np.ones(len(long), np.int64)
    if len(long) == len(lines.words):
        return found
    doc, place, _, content, size = fingerprints(lines, window)
    before = np.append(0, np.cumsum(lines.words < LONG_WORDS))
    at = lines.doc[:-1][doc] + place
    short = before[at + window] > before[at]
    return tuple(np.append(a, b[short]) for a, b in zip(found, (doc, place, content, size)))


def outside(lines: Lines, runs: list, doc: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which positions do not lie in one of the documents' matched runs [place, number of lines]."""
    start = np.array([lines.doc[d] + p for d, some in enumerate(runs) for p, _ in some or ()], np.int64)
    many = np.array([n for some in runs for _, n in some or ()], np.int64)
    # the farthest end of a run that starts at or before a line; runs of documents before it end before it
    end = np.zeros(len(lines.hash) + 1, np.int64)
    np.maximum.at(end, start, start + many)
    end = np.maximum.accumulate(end)
    at = lines.doc[:-1][doc] + place
    return np.flatnonzero(end[at] < at + size)


def _line_hashes(docs: DataFrame) -> DataFrame:
    """(doc, th, hashes, words) of documents (doc, th, text), as ``Lines.packed`` gives them."""

    def run(batches):
        for piece in common.slices(batches):
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *Lines(piece.column(2)).packed()],
                                             names=["doc", "th", "hashes", "words"])

    return docs.mapInArrow(common.lean(run), "doc bigint, th binary, hashes binary, words binary")


def matched_runs(hashed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, place, size): runs that start at a winnowed match, extended both ways."""
    sides = [f"{side}{k}" for side in "ba" for k in range(1, window + 1)]

    def run(batches):
        for batch in batches:
            lines = Lines.of(batch.column(2), batch.column(3))
            doc, at = anchors(lines, window)
            first, last, pick = lines.doc[:-1][doc], lines.doc[1:][doc], pa.array(doc)
            near = []
            for k in (*range(-1, -window - 1, -1), *range(1, window + 1)):
                there = (at + k >= first) & (at + k < last)
                near.append(pa.array(lines.hash[np.where(there, at + k, at)].view(np.int64), mask=~there))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(lines.hash[at].view(np.int64)),
                 pa.array((at - first).astype(np.int32)), pa.array(lines.words[at] >= LONG_WORDS), *near],
                names=["doc", "th", "line", "place", "long", *sides])

    found = hashed.mapInArrow(common.lean(run), ", ".join(["doc bigint, th binary, line bigint, place int, long boolean",
                                                           *(f"{s} bigint" for s in sides)]))
    here = F.struct("doc", "th", "place")
    first = found.groupBy("line").agg(F.min(F.struct("doc", "th", "place", *sides)).alias("first"), F.max(here).alias("last"))
    first = first.where(F.struct("first.doc", "first.th", "first.place") < F.col("last")).drop("last")

    def agreeing(side: str):
        n = F.lit(window)
        for k in range(window, 0, -1):
            n = F.when(F.col(f"{side}{k}") == F.col(f"first.{side}{k}"), n).otherwise(F.lit(k - 1))
        return n

    later = found.join(first, "line").where(here > F.struct("first.doc", "first.th", "first.place"))
    runs = later.select("doc", "th", "place", "long", agreeing("b").alias("before"), agreeing("a").alias("after"))
    whole = F.col("before") + 1 + F.col("after") >= window
    return runs.where(whole | F.col("long")).select(
        "doc", "th", F.when(whole, F.col("place") - F.col("before")).otherwise(F.col("place")).alias("place"),
        F.when(whole, F.col("before") + 1 + F.col("after")).otherwise(F.lit(1)).alias("size"))


def _of_documents(runs: DataFrame) -> DataFrame:
    return runs.groupBy("doc", "th").agg(F.collect_set(F.array("place", "size")).alias("runs"))


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, th, runs): runs [place, number of lines] of documents (doc, th, text) that have an earlier copy."""

    def run(batches):
        for batch in batches:
            lines = Lines.of(batch.column(2), batch.column(3))
            doc, place, content, size = positions(lines, window)
            left = outside(lines, batch.column(4).to_pylist(), doc, place, size)
            doc, place, content, size = doc[left], place[left], content[left], size[left]
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(content.view(np.int64)),
                 pa.array(place.astype(np.int32)), pa.array(size.astype(np.int32))], names=["doc", "th", "win", "place", "size"])

    hashed = common.written(_line_hashes(docs), "lines")
    matched = common.written(matched_runs(hashed, window), "matched")
    rest = hashed.join(_of_documents(matched), ["doc", "th"], "left").select("doc", "th", "hashes", "words", "runs")
    found = common.written(rest.mapInArrow(common.lean(run), "doc bigint, th binary, win bigint, place int, size int"), "fingerprints")
    here = F.struct("doc", "th", "place")
    first = found.groupBy("win").agg(F.min(here).alias("first"), F.max(here).alias("last")).where("first <> last")
    later = found.join(first.select("win", "first"), "win").where(here > F.col("first"))
    return _of_documents(matched.unionByName(later.select("doc", "th", "place", "size")))


def cut_text(text: str, runs: list) -> tuple[list[list[int]], str]:
    """Deleted line runs (non-blank line numbers, end exclusive) and the text without these lines."""
    merged: list[list[int]] = []
    for place, size in sorted(runs):
        if merged and place <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], place + size)
        else:
            merged.append([place, place + size])
    gone = {k for a, b in merged for k in range(a, b)}
    kept, number = [], 0
    for line in text.split("\n"):
        if line.encode().strip():
            if number not in gone:
                kept.append(line)
            number += 1
        else:
            kept.append(line)
    return merged, "\n".join(kept)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` plus n_lines (non-blank lines), deleted (runs of their numbers) and clean_text."""
    common.prepare(docs.sparkSession)
    keys = {"__doc": F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)), "__th": common.text_key(F.col(text_col))}
    slim = docs.select(keys["__doc"].alias("doc"), keys["__th"].alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    runs = repeated_runs(slim, window).select(F.col("doc").alias("__doc"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    joined = docs.drop(*COLUMNS).withColumns(keys).join(runs, ["__doc", "__th"], "left").drop("__doc", "__th")
    names = joined.columns[:-1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def cut(batches):
        for piece in common.slices(batches, text_col):
            texts = piece.column(names.index(text_col))
            counts = Lines(texts).counts
            deleted, clean = [], []
            for text, runs in zip(texts.to_pylist(), piece.column(len(names)).to_pylist()):
                merged, text = cut_text(text, runs) if runs else ([], text)
                deleted.append([{"start": a, "end": b} for a, b in merged])
                clean.append(text)
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(counts, pa.int64()), pa.array(deleted, kind), pa.array(clean, pa.string())],
                names=[*names, *COLUMNS])

    return joined.mapInArrow(common.lean(cut), schema + ", n_lines bigint, deleted array<struct<start:int,end:int>>, clean_text string")
