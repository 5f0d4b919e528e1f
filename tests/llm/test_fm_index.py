import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from marketflow.llm import common
from marketflow.llm.fm_index import FMIndex, WaveletMatrix
from marketflow.llm.substring_dedup import search_shard


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), max_size=25), min_size=1, max_size=8), st.lists(st.integers(1, 5), min_size=1, max_size=5))
def test_count_and_locate_match_a_scan(parts, pattern):
    text = np.array([x for p in parts for x in [*p, 0]])
    index = FMIndex(text, 6, sample=4)
    lo, hi = index.count(np.array([pattern]), np.array([len(pattern)]))
    want = [i for i in range(len(text) - len(pattern) + 1) if list(text[i:i + len(pattern)]) == pattern]
    assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=300))
def test_wavelet_rank(seq):
    w = WaveletMatrix(np.array(seq, np.int64), 10)
    codes = np.repeat(np.arange(10), len(seq) + 1)
    at = np.tile(np.arange(len(seq) + 1), 10)
    assert w.rank(codes, at).tolist() == [seq[:i].count(c) for c, i in zip(codes, at)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=30), min_size=1, max_size=6), st.integers(2, 6))
def test_shard_search_reports_windows_of_smaller_owners(docs, window):
    texts = pa.array([" ".join(d) for d in docs])
    got = search_shard(texts, np.arange(len(docs)), window)
    for k, d in enumerate(docs):
        earlier = {tuple(e[i:i + window]) for e in docs[:k] for i in range(len(e) - window + 1)}
        want = [i for i in range(len(d) - window + 1) if tuple(d[i:i + window]) in earlier]
        assert [i for a, b in zip(got[k][::2], got[k][1::2]) for i in range(a, b)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b\x1cé中😀", max_size=12)), max_size=8))
def test_words_match_split(texts):
    words = common.Words(pa.array(texts, pa.string()))
    split = [(t or "").encode().split() for t in texts]
    assert words.counts.tolist() == [len(s) for s in split]
    seen = {}
    for w, h in zip([w for s in split for w in s], words.hash.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
