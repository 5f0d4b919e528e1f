"""Toxicity scores by the nearest labelled examples under exact TF-IDF cosine.

Terms are words (A-Z lower-cased; runs of digits, letters and characters beyond ASCII) and word beginnings of 4 to
8 bytes; a term that a text holds at least twice, and once in ``DENSE`` words or more often, also has a dense form.
The labelled examples are a bounded sample (``MAX_LABELLED`` rows of the training part, in hash order); all their
terms are kept, in sparse vectors. Document frequencies are counted over all documents. A term's weight is its
inverse document frequency times sqrt(1 + chi-square against the label): none is dropped by it, but terms that go
with the label count for more than the many rare words of a text. The examples' vectors form an inverted
index in blocks of examples: rare terms have posting lists, terms of at least one in ``FREQUENT`` examples a column
for each block with its maximum. A document's posting lists are added up, and the frequent terms only in blocks
whose upper bound reaches its k-th neighbour, so the neighbours are exact. Votes are weighted by similarity
squared, and the share of toxic votes is calibrated (monotone steps, fitted on leave-one-out votes of the examples
themselves). The neighbours are returned as evidence.

Labels enter only through training rows: crc32 of the id as text, modulo 3, other than 1. Labels, language,
source and id are no input of a score.

Defined cases: texts without any term of the examples (null and empty ones too) get the calibrated score of examples
without terms; of several labels of one id the largest counts; labels without id or value are left out;
with no labelled example every score is 0. A null id is not held out. Rows are scored one by one. Input
columns stay, except that columns with the names of ``COLUMNS`` are replaced.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import common
from marketflow.llm.common import U64

MAX_LABELLED = 12_000
#: A dense feature stands at least once in so many words.
DENSE = 150
BLOCK = 32
#: A term of at least one in so many examples is kept as a column, others as posting lists.
FREQUENT = 20
#: Queries, and postings of them, that are added up at a time (one query may exceed the latter).
QUERIES, POSTINGS = 256, 1 << 25
#: A posting list of at most so many entries is gathered together with those of other terms.
SHORT = 16
#: Examples, and entries of their vectors, that the fit handles at a time.
ROWS, ENTRIES = 1 << 9, 1 << 18
#: Leading bits by which a feature is looked up.
CELL_BITS = 20
NEIGHBOURS = 15
THRESHOLD = 0.7
STEMS = (4, 5, 6, 7, 8)
COLUMNS = ("held_out", "score", "predicted", "evidence")


def _features(texts: pa.Array):
    """Hashes of all features of a slice and their documents (a feature once for each place); words by document."""
    words = common.Words(texts, common.ALNUM, lower=True)
    doc = np.repeat(np.arange(len(texts)), words.counts)
    word, feature = _word_features(words, np.arange(len(doc)))
    return feature, doc[word], words.counts


def _word_features(words: common.Words, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among ``some``, hash) of all features of some words: the words themselves, then their beginnings."""
    out, places = [words.hash[some]], [np.arange(len(some))]
    start, size, place = words.start[some], words.end[some] - words.start[some], places[0]
    sums = common.prefix_sums(words.data)
    for stem in STEMS:
        long = np.flatnonzero(size > stem)
        start, size, place = start[long], size[long], place[long]
        out.append(common.span_hash(words.data, start, start + stem, sums) ^ U64(stem))
        places.append(place)
    return np.concatenate(places), np.concatenate(out)


class Sparse:
    """Entries (row, term, value) of a matrix, by row."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        if (row[1:] < row[:-1]).any():
            order = np.argsort(row, kind="stable")
            row, term, value = row[order], term[order], value[order]
        self.row, self.term, self.value, self.shape = row, term, value, shape
        self.start = np.searchsorted(self.row, np.arange(shape[0] + 1))

    def with_value(self, value: np.ndarray) -> Sparse:
        out = object.__new__(Sparse)
        out.row, out.term, out.value, out.shape, out.start = self.row, self.term, value, self.shape, self.start
        return out

    @classmethod
    def of(cls, dense: np.ndarray) -> Sparse:
        row, term = np.nonzero(dense)
        return cls(row, term, dense[row, term], dense.shape)

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape, self.value.dtype)
        out[self.row, self.term] = self.value
        return out

    def __len__(self) -> int:
        return self.shape[0]

    def __getitem__(self, k: int) -> np.ndarray:
        out = np.zeros(self.shape[1], self.value.dtype)
        here = slice(self.start[k], self.start[k + 1])
        out[self.term[here]] = self.value[here]
        return out


def _counted(feature: np.ndarray, doc: np.ndarray):
    """Distinct (feature, doc) with their number, by feature."""
    order = np.lexsort((doc, feature))
    feature, doc = feature[order], doc[order]
    new = np.flatnonzero(np.append(True, (feature[1:] != feature[:-1]) | (doc[1:] != doc[:-1]))) if len(feature) else np.zeros(0, np.int64)
    return feature[new], doc[new], np.diff(np.append(new, len(feature)))


class Vocabulary:
    """Terms: features (sorted hashes) and the dense forms of some of them (``dense``: their places among the
    features); ``counts`` gives the term counts of a slice's documents."""

    def __init__(self, hashes: np.ndarray, dense: np.ndarray):
        self.hashes = hashes
        self.dense_term = np.full(len(hashes), -1, np.int32)
        self.dense_term[dense] = len(hashes) + np.arange(len(dense))
        self.size = len(hashes) + len(dense)
        self.cells = np.searchsorted(hashes >> U64(64 - CELL_BITS), np.arange((1 << CELL_BITS) + 1, dtype=U64)).astype(np.int32)

    def __getstate__(self) -> dict:
        return {"hashes": self.hashes, "dense": np.flatnonzero(self.dense_term >= 0)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def counts(self, texts: pa.Array) -> Sparse:
        words = common.Words(texts, common.ALNUM, lower=True)
        if not len(words.hash) or not self.size:
            none = np.zeros(0, np.int64)
            return Sparse(none, none, none, (len(texts), self.size))
        # each different word of the slice is looked up once
        order = np.argsort(words.hash)
        new = np.append(True, words.hash[order][1:] != words.hash[order][:-1])
        first, word = order[new], np.empty(len(order), np.int64)
        word[order] = np.cumsum(new) - 1
        place, feature = _word_features(words, first)
        hit, at = self._places(feature)
        order = np.argsort(place[hit], kind="stable")
        place, at = place[hit][order], at[order]
        start = np.searchsorted(place, np.arange(len(first) + 1))
        size = np.diff(start)[word]
        doc = np.repeat(np.repeat(np.arange(len(texts)), words.counts), size)
        # equal (document, feature) side by side
        key = np.sort(doc * np.int64(len(self.hashes)) + at[_spans(start[word], size)])
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        doc, term = np.divmod(key[new], len(self.hashes))
        return self.with_dense(doc, term, np.diff(np.append(new, len(key))), words.counts)

    def _places(self, feature: np.ndarray):
        """Which of the features are in the vocabulary, and their places: all with the same leading bits are tried."""
        cell = (feature >> U64(64 - CELL_BITS)).astype(np.int64)
        at, last = self.cells[cell], self.cells[cell + 1]
        hits, places, left = [], [], np.flatnonzero(at < last)
        at, last = at[left], last[left]
        while len(left):
            same = self.hashes[at] == feature[left]
            hits.append(left[same])
            places.append(at[same])
            at = at + 1
            more = ~same & (at < last)
            left, at, last = left[more], at[more], last[more]
        none = [np.zeros(0, np.int64)]
        return np.concatenate(hits or none), np.concatenate(places or none)

    def with_dense(self, doc: np.ndarray, term: np.ndarray, count: np.ndarray, words: np.ndarray) -> Sparse:
        form = self.dense_term[term]
        some = np.flatnonzero((form >= 0) & _dense(count, words[doc]))
        # each dense form behind its feature, so that the rows stay together
        return Sparse(np.insert(doc, some + 1, doc[some]), np.insert(term, some + 1, form[some]), np.insert(count, some + 1, count[some]),
                      (len(words), self.size))


def _dense(count, words):
    return (count >= 2) & (count * np.int64(DENSE) >= words)


def vectors(counts: Sparse | np.ndarray, weight: np.ndarray) -> Sparse | np.ndarray:
    """Unit vectors of (1 + ln tf) times the weight of the term; rows without terms stay zero."""
    if isinstance(counts, np.ndarray):
        return vectors(Sparse.of(counts), weight).dense()
    rows, length = weighted(counts, weight)
    for here in _parts(len(rows.value)):
        rows.value[here] /= length[rows.row[here]]
    return rows


def weighted(counts: Sparse, weight: np.ndarray) -> tuple[Sparse, np.ndarray]:
    """(1 + ln tf) times the weight of the term, and the lengths of the rows."""
    w, weight = np.empty(len(counts.value), np.float32), np.asarray(weight, np.float32)
    length = np.full(len(counts), 1e-12, np.float32)
    for a in range(0, len(counts), ROWS):
        z = min(a + ROWS, len(counts))
        here = slice(counts.start[a], counts.start[z])
        x, row = np.log(counts.value[here].astype(np.float32)), counts.row[here] - a
        x += 1
        x *= weight[counts.term[here]]
        np.maximum(np.sqrt(np.bincount(row, weights=x * x, minlength=z - a)), 1e-12, out=length[a:z], casting="same_kind")
        w[here] = x
    return counts.with_value(w), length


def _tally(at: np.ndarray, size: int, weight: np.ndarray | None = None, of: np.ndarray | None = None) -> np.ndarray:
    """How often each number below ``size`` is in ``at``, or the sum of ``weight[of]`` there; some entries at a time."""
    total = np.zeros(size)
    for here in _parts(len(at)):
        total += np.bincount(at[here], None if weight is None else weight[of[here]], size)
    return total


def _parts(n: int):
    return (slice(a, min(a + ENTRIES, n)) for a in range(0, n, ENTRIES))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] numbers), start[1], ..."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _places(some: np.ndarray, lists: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``some`` by their list, and their places: the next free ones of each list, which move on."""
    some = some[np.argsort(lists[some], kind="stable")]
    own = lists[some]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else some
    size = np.diff(np.append(first, len(own)))
    at = _spans(free[own[first]], size)
    free[own[first]] += size.astype(free.dtype)
    return some, at


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; 0 where there are fewer, or where it is less."""
    if values.shape[1] < k:
        return np.zeros(len(values))
    return np.maximum(np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k], 0)


class BlockMaxIndex:
    """Vectors ``rows`` / ``length`` (None: 1) of examples. A posting is only the example's number: the entries of a term
    with one value lie side by side as a run, which holds the value, and the lengths divide the sums."""

    def __init__(self, rows: Sparse | np.ndarray, names: np.ndarray, labels: np.ndarray, length: np.ndarray | None = None):
        rows = Sparse.of(rows) if isinstance(rows, np.ndarray) else rows
        # rows with the same heaviest term side by side
        full = np.flatnonzero(np.diff(rows.start))
        heaviest = np.maximum.reduceat(rows.value, rows.start[full]) if len(full) else rows.value
        most = np.flatnonzero(rows.value == np.repeat(heaviest, np.diff(rows.start)[full]))
        lead = rows.term[most[np.searchsorted(rows.row[most], full)]] if len(full) else full
        order = full[np.lexsort((names[full], lead))]
        pad = -len(order) % BLOCK if len(order) else BLOCK
        self.names = np.append(names[order], np.zeros(pad, np.int64))
        self.labels = np.append(labels[order], np.zeros(pad, np.int64))
        self.size, self.terms = len(order), rows.shape[1]
        self.length = np.ones(len(self.names), np.float32)
        if length is not None:
            self.length[:self.size] = length[order]
        number = np.zeros(len(rows), np.int32)
        number[order] = np.arange(len(order))
        with_term = _tally(rows.term, self.terms)
        frequent = with_term * FREQUENT >= max(self.size, 1)
        self.column = np.where(frequent, np.cumsum(frequent) - 1, -1).astype(np.int32)
        of_column = with_term[frequent].astype(np.int64)
        with_term[frequent] = 0
        self.start = np.append(0, np.cumsum(with_term)).astype(np.int32 if len(rows.term) < 1 << 31 else np.int64)
        small = np.uint16 if len(self.names) < 1 << 16 else np.int32
        self.example, value_of = np.empty(self.start[-1], small), np.empty(self.start[-1], np.float32)
        # the frequent terms' entries, by column
        self.packed = of_column, np.empty(of_column.sum(), small), np.empty(of_column.sum(), np.float32)
        # lists fill up in the order of the rows, some entries at a time
        free, free_column = self.start[:-1].copy(), np.append(0, np.cumsum(of_column))[:-1]
        for here in _parts(len(rows.term)):
            term, example, value = rows.term[here], number[rows.row[here]], rows.value[here]
            some, at = _places(np.flatnonzero(frequent[term]), self.column[term], free_column)
            self.packed[1][at], self.packed[2][at] = example[some], value[some] / self.length[example[some]]
            rare, at = _places(np.flatnonzero(~frequent[term]), term, free)
            self.example[at], value_of[at] = example[rare], value[rare]
        self._runs(value_of)

    def _runs(self, value_of: np.ndarray) -> None:
        """Sort each list by value, some lists at a time; where the runs of equal values start, and their values."""
        first, values, runs, a = [], [], np.zeros(self.terms + 1, np.int32), 0
        while a < self.terms:
            z = max(a + 1, int(np.searchsorted(self.start, self.start[a] + ENTRIES, side="right")) - 1)
            here = slice(self.start[a], self.start[z])
            term = np.repeat(np.arange(a, z, dtype=np.int32), np.diff(self.start[a:z + 1]))
            order = np.lexsort((self.example[here], value_of[here], term))
            self.example[here], value = self.example[here][order], value_of[here][order]
            new = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (term[1:] != term[:-1]))) if len(term) else order
            first.append((new + self.start[a]).astype(self.start.dtype))
            values.append(value[new])
            runs[a + 1:z + 1] = np.bincount(term[new] - a, minlength=z - a)
            a = z
        #: Of each term its first run; of each run its first posting, and its value.
        self.runs = np.cumsum(runs, dtype=np.int32)
        self.run_start = np.concatenate([*first, self.start[-1:]])
        self.run_value = np.concatenate(values or [np.zeros(0, np.float32)])

    @functools.cached_property
    def blocks(self) -> np.ndarray:
        """The frequent terms' columns, by block of examples; mostly zeros, so only tasks that search hold them."""
        size, example, value = self.packed
        columns = np.zeros((len(self.names), len(size)), np.float32)
        columns[example, np.repeat(np.arange(len(size)), size)] = value
        return columns.reshape(len(columns) // BLOCK, BLOCK, len(size))

    @functools.cached_property
    def maxima(self) -> np.ndarray:
        return self.blocks.max(1).T.copy()

    @functools.cached_property
    def lists(self) -> tuple[np.ndarray, list]:
        """Number of each term's list among those of more than SHORT entries, and these lists as bytes, which join fastest."""
        long = np.flatnonzero(np.diff(self.start) > SHORT)
        number = np.full(self.terms, -1, np.int32)
        number[long] = np.arange(len(long))
        return number, [self.example[i:j].tobytes() for i, j in zip(self.start[long].tolist(), self.start[long + 1].tolist())]

    def __getstate__(self) -> dict:
        """Travels without zeros: the frequent terms' columns are mostly empty, and every executor gets a copy on its disk."""
        return {k: v for k, v in self.__dict__.items() if k not in ("blocks", "maxima", "lists")}

    def part(self, a: int, z: int) -> Sparse:
        """The vectors of the examples from number a to z."""
        columns = self.blocks.reshape(len(self.names), self.blocks.shape[2])[a:z]
        example, column = np.nonzero(columns)
        at = np.flatnonzero((self.example >= a) & (self.example < z))
        own, term = self.example[at].astype(np.int64), np.searchsorted(self.start, at, side="right") - 1
        value = self.run_value[np.searchsorted(self.run_start, at, side="right") - 1] / self.length[own]
        return Sparse(np.append(example, own - a), np.append(np.flatnonzero(self.column >= 0)[column], term),
                      np.append(columns[example, column], value), (z - a, self.terms))

    @property
    def rows(self) -> Sparse:
        return self.part(0, self.size)

    def own_votes(self, a: int, z: int) -> np.ndarray:
        """Votes on the examples from number a to z, each left out of its own neighbours."""
        return self.votes(*self.search(self.part(a, z), skip=np.arange(a, z)))

    def search(self, queries: Sparse | np.ndarray, k: int = NEIGHBOURS, skip: np.ndarray | None = None):
        """(example numbers, similarities) of the k nearest; -1 and 0 where there are fewer with a positive
        similarity. ``skip``: an example that a query may not have (itself, in leave-one-out)."""
        queries = Sparse.of(queries) if isinstance(queries, np.ndarray) else queries
        m = len(queries)
        best, who = np.zeros((m, k)), np.full((m, k), -1, np.int64)
        total = np.append(0, np.cumsum(np.diff(self.start)[queries.term]))[queries.start]
        a = 0
        while a < m:
            z = max(a + 1, min(a + QUERIES, int(np.searchsorted(total, total[a] + POSTINGS, side="right")) - 1))
            who[a:z], best[a:z] = self._nearest(queries, a, z, k, None if skip is None else skip[a:z])
            a = z
        return who, best

    def _nearest(self, queries: Sparse, a: int, z: int, k: int, skip: np.ndarray | None):
        m, n = z - a, len(self.names)
        here = slice(queries.start[a], queries.start[z])
        row, term, value = queries.row[here] - a, queries.term[here], queries.value[here]
        scores = self._added(m, row, term, value)
        common_terms = np.zeros((m, self.blocks.shape[2]), np.float32)
        column = self.column[term]
        common_terms[row[column >= 0], column[column >= 0]] = value[column >= 0]
        if skip is not None:
            scores[np.arange(m), skip] = -9
        # what the posting lists give is a lower bound of a similarity
        by_block = scores.reshape(m, -1, BLOCK).max(2)
        live = by_block + common_terms @ self.maxima + 1e-4 >= _kth(by_block, k)[:, None]
        # side by side, blocks that most queries need are one product for all queries
        most = 2 * live.sum(0) >= m
        for run in np.split(np.flatnonzero(most), np.flatnonzero(np.diff(np.flatnonzero(most)) > 1) + 1):
            if len(run):
                examples = slice(run[0] * BLOCK, (run[-1] + 1) * BLOCK)
                scores[:, examples] += common_terms @ self.blocks.reshape(n, -1)[examples].T
        for b in np.flatnonzero(live.any(0) & ~most):
            q = np.flatnonzero(live[:, b])
            scores[q, b * BLOCK:(b + 1) * BLOCK] += common_terms[q] @ self.blocks[b].T
        scores[:, self.size:] = 0
        if skip is not None:
            scores[np.arange(m), skip] = 0
        # k blocks have an example of at least the k-th largest maximum, so that no smaller similarity is among the k
        enough = np.maximum(_kth(scores.reshape(m, -1, BLOCK).max(2), k) - 2e-5, 0)
        q, e = np.nonzero(scores > enough[:, None])
        # rounded similarity, then the smaller number
        similarity = np.rint(scores[q, e] * 1e5).astype(np.int64)
        order = np.lexsort((e, -similarity, q))
        q, e, similarity = q[order], e[order], similarity[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(m))[q]
        some = (place < k) & (similarity > 0)
        who, best = np.full((m, k), -1, np.int64), np.zeros((m, k))
        who[q[some], place[some]], best[q[some], place[some]] = e[some], similarity[some] / 1e5
        return who, best

    def _added(self, m: int, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The posting lists' share of the similarities of m queries with all examples."""
        number, lists = self.lists
        scores = np.zeros((m, len(self.names)))
        size = self.start[term + 1] - self.start[term]
        long, short = np.flatnonzero(size > SHORT), np.flatnonzero((size > 0) & (size <= SHORT))
        at = _spans(self.start[term[short]], size[short])
        gathered, weight = self.example[at], np.repeat(*self._weights(term[short], value[short]))
        each, run_size = self._weights(term[long], value[long])
        one, at = np.ones(len(at), run_size.dtype), np.empty(int(np.bincount(row, size, m).max(initial=0)), np.int64)
        cuts, short_cuts = (np.searchsorted(row[some], np.arange(m + 1)) for some in (long, short))
        run_cuts = np.append(0, np.cumsum(self.runs[term[long] + 1] - self.runs[term[long]]))[cuts]
        at_cuts = np.append(0, np.cumsum(size[short]))[short_cuts]
        numbers = number[term[long]].tolist()
        for q in range(m):
            runs, few = slice(run_cuts[q], run_cuts[q + 1]), slice(at_cuts[q], at_cuts[q + 1])
            joined = b"".join([gathered[few].tobytes(), *[lists[x] for x in numbers[cuts[q]:cuts[q + 1]]]])
            who = np.frombuffer(joined, self.example.dtype)
            if len(who):
                at[:len(who)] = who
                what = np.repeat(np.append(weight[few], each[runs]), np.append(one[few], run_size[runs]))
                scores[q] = np.bincount(at[:len(who)], what, len(self.names))
        scores /= self.length
        return scores

    def _weights(self, term: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the runs of the terms' lists the value times that of the query, and the number of entries."""
        number = self.runs[term + 1] - self.runs[term]
        runs = _spans(self.runs[term], number)
        return np.repeat(value.astype(float), number) * self.run_value[runs], self.run_start[runs + 1] - self.run_start[runs]

    def votes(self, who: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Share of toxic votes, weighted by similarity squared; NaN without neighbours."""
        w = best * best
        total = w.sum(1)
        return np.where(total > 0, (w * self.labels[who]).sum(1) / np.maximum(total, 1e-12), np.nan)


class Calibration:
    """Monotone steps from vote shares to the observed share of label 1 (pool adjacent violators on bins)."""

    def __init__(self, votes: np.ndarray, labels: np.ndarray, bins: int = 20):
        none = np.isnan(votes)
        self.none = float(labels[none].sum() / max(none.sum(), 1)) if len(labels) else 0.0
        self.edges = np.linspace(0, 1, bins + 1)[1:-1]
        at = np.searchsorted(self.edges, votes[~none], side="right")
        n = np.bincount(at, minlength=bins) + 0.5
        ones = np.bincount(at, weights=labels[~none], minlength=bins) + 0.5 * (np.arange(bins) + 0.5) / bins
        pools: list[list[float]] = []
        for a, b in zip(ones, n):
            pools.append([a, b, 1])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a2, b2, c2 = pools.pop()
                pools[-1] = [pools[-1][0] + a2, pools[-1][1] + b2, pools[-1][2] + c2]
        self.steps = np.concatenate([np.full(c, a / b) for a, b, c in pools])

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.edges, np.nan_to_num(votes), side="right")
        return np.clip(np.where(np.isnan(votes), self.none, self.steps[at]), 0, 1)


class Model:
    """What scoring needs: the broadcast vocabulary, the broadcast (term weights, index), and the calibration."""

    def __init__(self, vocabulary: Broadcast, index: Broadcast, calibration: Calibration | None):
        self.vocabulary, self.weighted_index, self.calibration = vocabulary, index, calibration

    @property
    def index(self) -> BlockMaxIndex:
        return self.weighted_index.value[1]

    def score(self, texts: pa.Array):
        """(scores, example numbers, similarities)."""
        weight, index = self.weighted_index.value
        who, best = index.search(vectors(self.vocabulary.value.counts(texts), weight))
        if self.calibration is None:
            return np.zeros(len(texts)), who, best
        return self.calibration(index.votes(who, best)), who, best


def _own_votes(spark: SparkSession, index: Broadcast, size: int, step: int = 500) -> np.ndarray:
    """Leave-one-out votes of the examples, some in each task."""

    def run(batches):
        for batch in batches:
            for a in batch.column(0).to_pylist():
                part = index.value[1].own_votes(a, min(a + step, size))
                yield pa.RecordBatch.from_arrays([pa.array([a], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["id", "votes"])

    starts = spark.range(0, size, step, max(1, -(-size // step)))
    rows = starts.mapInArrow(common.lean(run), "id bigint, votes binary").collect()
    return np.frombuffer(b"".join(r["votes"] for r in sorted(rows, key=lambda r: r["id"])))


def _encoded(rows) -> tuple[np.ndarray, np.ndarray, Vocabulary, Sparse]:
    """(ids, labels, vocabulary, term counts) of the examples, by id. The terms of all examples are a large part of the
    driver's memory: each is held once, and arrays of all of them are filled a few examples at a time."""
    rows = sorted(((r["id"], r["toxic"], r["words"], bytes(r["f"]), bytes(r["n"])) for r in rows),
                  key=lambda r: (r[0], zlib.crc32(r[3]), zlib.crc32(r[4]), *r[1:3]))
    names, y, words = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    hashes = dense = np.zeros(0, U64)
    size = 0
    for a in range(0, len(rows), ROWS):
        doc, feature, count = _joined(rows[a:a + ROWS])
        extra = feature[_dense(count, words[a + doc])]
        hashes, dense, size = np.union1d(hashes, feature), np.union1d(dense, extra), size + len(feature) + len(extra)
    vocabulary = Vocabulary(hashes, np.searchsorted(hashes, dense))
    whole, at = [np.empty(size, np.int32) for _ in range(3)], 0
    for a in range(0, len(rows), ROWS):
        doc, feature, count = _joined(rows[a:a + ROWS])
        rows[a:a + ROWS] = [None] * len(rows[a:a + ROWS])
        part = vocabulary.with_dense(doc, np.searchsorted(hashes, feature).astype(np.int32), count, words[a:a + ROWS])
        for out, x in zip(whole, (part.row + np.int32(a), part.term, part.value)):
            out[at:at + len(x)] = x
        at += len(part.row)
        common.trim()
    return names, y, vocabulary, Sparse(*whole, (len(names), vocabulary.size))


def _joined(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the row, feature, count) of all terms of some examples."""
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[3]) // 8 for r in rows])
    counts = [np.frombuffer(r[4], np.uint8 if 8 * len(r[4]) == len(r[3]) else np.int32) for r in rows]  # bytes where all fit
    return doc, np.frombuffer(b"".join(r[3] for r in rows), U64), np.concatenate([np.zeros(0, np.int32), *counts])


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, by_label: bool = True) -> Model:
    """Fit on the bounded sample of labelled rows; document frequencies come from all documents. ``by_label``: whether
    the label's chi-square is a factor of a term's weight."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~_held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(MAX_LABELLED)
    rows = common.written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(sample), "id"), "labelled")

    def counted(batches):
        for piece in common.slices(batches):
            feature, doc, words = _features(piece.column(1))
            feature, doc, count = _counted(feature, doc)
            order = np.argsort(doc, kind="stable")
            feature, count = feature[order], count[order].astype(np.int32)
            cuts = np.searchsorted(doc[order], np.arange(piece.num_rows + 1))
            spans = list(zip(cuts, cuts[1:]))
            counts = [count[i:j] if (count[i:j] > 255).any() else count[i:j].astype(np.uint8) for i, j in spans]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(2), pa.array(words, pa.int64()), pa.array([feature[i:j].tobytes() for i, j in spans], pa.binary()),
                 pa.array([x.tobytes() for x in counts], pa.binary())], names=["id", "toxic", "words", "f", "n"])

    table = rows.select("id", "text", "toxic").mapInArrow(common.lean(counted), "id bigint, toxic int, words bigint, f binary, n binary")
    names, y, vocabulary, examples = _encoded(table.toLocalIterator())
    v, n, n1 = vocabulary.size, len(y), int(y.sum())
    # 2 x 2 table of (term in the text, label)
    seen, seen1 = _tally(examples.term, v), _tally(examples.term, v, y, examples.row)
    gap = seen1 * (n - n1) - (seen - seen1) * n1
    chi2 = gap * gap * n / (max(n1, 1) * max(n - n1, 1) * np.maximum(seen, 1) * np.maximum(n - seen, 1))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # also used for scoring: it travels once

    def frequencies(batches):
        total = np.zeros(v + 1, np.int64)
        for piece in common.slices(batches):
            total[:v] += np.bincount(shared.value.counts(piece.column(0)).term, minlength=v)
            total[v] += piece.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([total.tobytes()], pa.binary())})

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(common.lean(frequencies), "n binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    add = lambda a, b: a + b
    df = parts.treeAggregate(0, add, add, 3) + np.zeros(v + 1, np.int64)
    weight = np.log((1 + df[v]) / (1 + df[:v])) + 1
    weight = (weight * np.sqrt(1 + chi2) if by_label else weight).astype(np.float32)
    examples, length = weighted(examples, weight)
    index = BlockMaxIndex(examples, names, y, length)
    empty = y[np.diff(examples.start) == 0]
    del examples
    common.trim()
    sent = docs.sparkSession.sparkContext.broadcast((weight, index))
    size, known = index.size, np.append(index.labels[:index.size], empty)
    del index
    common.trim()
    if not n:
        return Model(shared, sent, None)
    votes = np.append(_own_votes(docs.sparkSession, sent, size), np.full(len(empty), np.nan))
    return Model(shared, sent, Calibration(votes, known))


def _held_out(name):
    return F.coalesce(F.crc32(name.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", by_label: bool = True) -> DataFrame:
    """``docs`` plus held_out, score, predicted and evidence (id, label and similarity of the neighbours)."""
    common.prepare(docs.sparkSession)
    model = fit(docs, labels, id_col, text_col, by_label)
    base = docs.drop(*COLUMNS)
    names = base.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields]
    evidence = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def run(batches):
        index = model.index
        for piece in common.slices(batches, text_col):
            score, who, best = model.score(piece.column(names.index(text_col)))
            some = who >= 0
            flat, sims = who[some], best[some]
            structs = pa.StructArray.from_arrays(
                [pa.array(index.names[flat], pa.int64()), pa.array(index.labels[flat].astype(np.int32)), pa.array(sims)],
                names=["id", "label", "similarity"])
            offsets = pa.array(np.append(0, np.cumsum(some.sum(1))), pa.int32())
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score), pa.ListArray.from_arrays(offsets, structs).cast(evidence)],
                                             names=[*names, "score", "evidence"])

    schema = ", ".join([*fields, "score double", "evidence array<struct<id:bigint,label:int,similarity:double>>"])
    return base.mapInArrow(common.lean(run), schema).withColumns({
        "held_out": _held_out(F.col(id_col)), "predicted": (F.col("score") >= THRESHOLD).cast("int")})
