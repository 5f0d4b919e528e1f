"""FM-index over integer sequences in numpy: suffix sorting by prefix doubling, a wavelet matrix of
packed bits with rank directories, vectorised backward search, and sampled suffix positions.

Sequences are joined by the separator 0; separators count as different symbols in order of position,
so no match runs over one. All searches work on arrays of patterns or lanes at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, sigma: int, limit: int | None = None, keep_depth: int | None = None):
    """Suffix array of ``text`` (codes 0..sigma-1, 0 separates).

    ``limit``: stop once suffixes are sorted by that many symbols (ties then stand in order of
    position); None sorts fully. ``keep_depth``: also return, for each text position, the group number
    at a depth between keep_depth/2 and keep_depth, and that depth.
    """
    n = len(text)
    small = np.int32 if n < 1 << 31 else np.int64  # of a shard's positions
    bits = max(1, int(sigma - 1).bit_length())
    depth = max(1, 62 // bits)
    if keep_depth:
        depth = min(depth, keep_depth)
    ends = np.flatnonzero(text == 0)
    if not len(ends) or ends[-1] != n - 1:
        raise ValueError("the text must end with a separator")
    to_end = (np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)).astype(small)
    key = np.zeros(n, np.int64)
    for k in range(depth):
        key <<= bits
        if k < n:
            key[:n - k] |= np.where(to_end[:n - k] < k, 0, text[k:])
    sa = np.argsort(key, kind="stable").astype(small)
    new = np.ones(n, bool)
    ordered = key[sa]
    new[1:] = (ordered[1:] != ordered[:-1]) | (to_end[sa[1:]] < depth)
    del key, ordered
    kept = None
    while True:
        starts = np.flatnonzero(new)
        rank = np.empty(n, small)
        rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
        if keep_depth and depth <= keep_depth:
            kept = (rank, depth)
        if limit is not None and depth >= limit:
            break
        size = np.diff(np.append(starts, n))
        tied = np.repeat(size > 1, size)
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        pos = sa[rows]
        group = rank[pos]
        nxt = rank[np.minimum(pos + depth, n - 1)]
        order = np.lexsort((nxt, group)) if n >= 1 << 31 else np.argsort(group.astype(np.int64) * n + nxt, kind="stable")
        pos, group, nxt = pos[order], group[order], nxt[order]
        sa[rows] = pos
        depth *= 2
        change = np.ones(len(rows), bool)
        change[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1]) | (to_end[pos[1:]] < depth)
        new[rows] = change
    return (sa, kept) if keep_depth else sa


class WaveletMatrix:
    """Rank over a sequence of codes below 2**levels: one packed bit vector with counts per 64 bits a level."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n = len(seq)
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.ranks, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.bitwise_count(words).astype(np.uint32)
            ranks = np.zeros(len(words), np.uint32)
            np.cumsum(ones[:-1], out=ranks[1:])
            self.bits.append(words)
            self.ranks.append(ranks)
            self.zeros.append(int(self.n - ones.sum(dtype=np.int64)))
            seq = np.concatenate([seq[~bit], seq[bit]])
            del bit, packed
        del seq
        codes = np.arange(sigma, dtype=np.int64)
        self.node = self._descend(codes, np.zeros(sigma, np.int64))

    def _rank1(self, k: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[k][word].astype(np.int64) + np.bitwise_count(self.bits[k][word] & mask)

    def _descend(self, codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._rank1(k, i)
            i = np.where((codes >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, codes: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often codes[j] stands before position i[j]."""
        return self._descend(codes, i) - self.node[codes]

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code at each position and how often it stands before it."""
        code = np.zeros(len(i), np.int64)
        for k in range(self.levels):
            word, shift = i >> 6, (i & 63).astype(np.uint64)
            bit = ((self.bits[k][word] >> shift) & np.uint64(1)).astype(np.int64)
            ones = self._rank1(k, i)
            i = np.where(bit, self.zeros[k] + ones, i - ones)
            code = (code << 1) | bit
        return code, i - self.node[code]


class FMIndex:
    """Backward search over joined sequences. With ``sample``, occurrences can be located."""

    def __init__(self, text: np.ndarray, sigma: int, limit: int | None = None,
                 keep_depth: int | None = None, sample: int | None = None):
        text = np.asarray(text)
        built = suffix_array(text, sigma, limit, keep_depth)
        sa, self.kept = built if keep_depth else (built, None)
        self.sa = sa if keep_depth else None
        self.n, self.sigma = len(text), sigma
        before = text[sa - 1]  # of position 0: the last separator
        self.first = np.zeros(sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=sigma), out=self.first[1:])
        self.wavelet = WaveletMatrix(before, sigma)
        if sample:
            marked = (sa % sample == 0) | (before == 0)
            self.marks = WaveletMatrix(marked.astype(np.int64), 2)
            self.samples = sa[marked]

    def extend(self, codes: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        """Rows of the patterns that get ``codes`` put in front."""
        base = self.first[codes]
        return base + self.wavelet.rank(codes, lo), base + self.wavelet.rank(codes, hi)

    def count(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of patterns (rows of codes, right-aligned to their length in ``patterns``)."""
        m, width = patterns.shape
        lo, hi = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.arange(m)
        for k in range(width):
            live = live[(lengths[live] > k) & (lo[live] < hi[live])]
            if not len(live):
                break
            codes = patterns[live, width - 1 - k]
            known = codes > 0
            hi[live[~known]] = lo[live[~known]]
            live, codes = live[known], codes[known]
            lo[live], hi[live] = self.extend(codes, lo[live], hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk back by LF steps to the next sampled suffix position."""
        out = np.empty(len(rows), np.int64)
        at, step, live = rows.copy(), 0, np.arange(len(rows))
        while len(live):
            here = at[live]
            bit, before = self.marks.access_rank(here)
            hit = bit == 1
            out[live[hit]] = self.samples[before[hit]] + step
            live = live[~hit]
            code, rank = self.wavelet.access_rank(at[live])
            at[live] = self.first[code] + rank
            step += 1
        return out
