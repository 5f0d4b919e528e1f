"""Vector codes, k-d shards and hard negatives against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketflow.llm import hard_negatives as hn
from marketflow.llm import kd_shards as kd
from marketflow.llm import vector_codes as vc

INF = float("inf")
VECTORS = "vec_id bigint, embedding array<double>, label int, code string, error int, uid string, `rank` int, score double"


def vector_rows():
    """Ties, repeats, null and non-finite components, null ids and labels, one label with a third of the rows."""
    rng = random.Random(5)
    rows = [(k, [rng.randint(-3, 3) / 8 + rng.choice([0, 0, 1e-4]) for _ in range(8)], 0 if k % 3 else rng.randint(1, 4)) for k in range(0, 420, 2)]
    rows += [(100, rows[50][1], 2), (100, rows[50][1], 2), (101, rows[7][1], 0), (102, rows[7][1], 0), (103, rows[7][1], 3)]
    rows += [(None, rows[3][1], 1), (None, rows[9][1], None), (105, None, 1), (107, [0.5] * 7 + [float("nan")], 1),
             (109, [0.5] * 7 + [None], 1), (111, [INF] + [0.5] * 7, 2), (113, [0.25] * 8, None), (115, [0.0] * 8, 1), (117, [], 1), (119, [0.5] * 4, 1)]
    return rows


@pytest.fixture(scope="module")
def vectors_df(spark):
    return spark.createDataFrame([(*r, "c", 1, "u", 2, 0.5) for r in vector_rows()], VECTORS).repartition(3)


def good(v, length=8):
    return v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)


# --- vector codes ------------------------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds, scale):
    """(vec_id, code, error) rows and codebooks by plain comparison."""
    kept = sorted((r for r in rows if good(r[1])), key=lambda r: (r[0] is None, r[0] or 0))
    ints = [[math.floor(x * scale) for x in r[1]] for r in kept]
    width = 8 // parts
    cut = [[v[p * width:(p + 1) * width] for v in ints] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]

    def near(book, v):
        return min((sum((a - b) ** 2 for a, b in zip(e, v)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut[p]:
                own[near(books[p], v)[1]].append(v)
            for k, vs in own.items():
                books[p][k] = [sum(c) // len(vs) for c in zip(*vs)]
    out = []
    for k, r in enumerate(kept):
        found = [near(books[p], cut[p][k]) for p in range(parts)]
        out.append((r[0], "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found)))
    return out, books


@pytest.mark.parametrize("parts,entries", [(2, 16), (4, 7), (1, 40)])
def test_codes_equal_brute_force(vectors_df, parts, entries):
    coded, books = vc.vector_codes(vectors_df, parts=parts, entries=entries, rounds=3, scale=64)
    # the ids of the first entries are distinct, so their order is fixed
    want, want_books = brute_codes(vector_rows(), parts, entries, 3, 64)
    assert books.tolist() == want_books
    assert sorted(map(str, ((r.vec_id, r.code, r.error) for r in coded.collect()))) == sorted(map(str, want))
    assert coded.columns == ["vec_id", "label", "uid", "rank", "score", "code", "error"]


def test_label_errors_keep_null_labels(vectors_df):
    coded, _ = vc.vector_codes(vectors_df, parts=2, rounds=1)
    got = vc.with_label_error(coded).collect()
    sums = defaultdict(int)
    for r in got:
        sums[r.label] += r.error
    assert len(got) == coded.count() and all(r.label_error == sums[r.label] for r in got) and None in sums


def test_gnat_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (12, 6))
    entries = (centres[rng.integers(0, 12, 200)] + rng.integers(-40, 40, (200, 6))).astype(np.int64)
    entries[50:60] = entries[0]
    queries = np.concatenate([entries[rng.integers(0, 200, 500)] + rng.integers(-5, 6, (500, 6)), entries, (entries[:-1] + entries[1:]) // 2])
    tree = vc.Gnat(entries)
    number, far = tree.nearest(queries)
    every = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (far == every.min(axis=1)).all() and (number == every.argmin(axis=1)).all()
    assert tree.measured < 0.6 * every.size


def test_few_rows_none_and_large_components(spark):
    few = spark.createDataFrame([(2, [1e300, 0.0], 1), (1, [-1e300, 0.5], 1), (3, [0.1, 0.2], None)], "vec_id bigint, embedding array<double>, label int")
    coded, books = vc.vector_codes(few, parts=2)
    assert books.shape == (2, 3, 1) and all(r.error == 0 for r in coded.collect())
    coded, books = vc.vector_codes(few.limit(0))
    assert coded.count() == 0 and vc.codebook_text(books) == "" and vc.with_label_error(coded).count() == 0
    with pytest.raises(ValueError):
        vc.vector_codes(few, parts=3)


# --- hard negatives ----------------------------------------------------------------------------------------------


def brute_negatives(rows, every, scale, positives, negatives):
    usable = [(r[0], [math.floor(x * scale) for x in r[1]], r[2]) for r in rows if r[2] is not None and r[1] is not None and good(r[1], len(r[1]))]
    out = []
    for i, (a, v, label) in enumerate(usable):
        if a is None or a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), b is None, b or 0, lab == label, b)
                        for j, (b, w, lab) in enumerate(usable) if j != i and len(w) == len(v))
        for p, _, _, _, positive in [s for s in scored if s[3]][:positives]:
            inside = [s for s in scored if not s[3] and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(a, positive, k + 1, s[4], -p, -s[0]) for k, s in enumerate(inside)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16, 4096])
def test_negatives_equal_brute_force(vectors_df, monkeypatch, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "FAN_IN", 3)
    got = hn.hard_negatives(vectors_df, F.col("vec_id") % 10 == 0, scale=16, positives=4, negatives=6)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(vector_rows(), 10, 16, 4, 6)
    assert want and sorted((tuple(r) for r in got.collect()), key=str) == want


def test_negatives_of_nothing(spark, vectors_df):
    assert hn.hard_negatives(vectors_df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hn.hard_negatives(vectors_df, F.lit(False)).count() == 0
    assert hn.hard_negatives(vectors_df.where("label = 0"), F.col("vec_id") % 10 == 0).count() == 0


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0 ** 40, 1.0], [2.0 ** 28, 3.0]]), np.array([[2.0 ** 40, 1.0], [2.0 ** 28 + 1, -1.0]])
    assert hn.products(a, b).tolist() == [[(1 << 63) - 1, (1 << 63) - 1],
                                         [(1 << 63) - 1, (1 << 28) * ((1 << 28) + 1) - 3]]
    for p in [*range(-40, 200), (1 << 63) - 1, (1 << 62) + 7]:
        assert hn.upper(p) == 9 * p // 10 and hn.lower(p) == -(-3 * p // 10)


# --- k-d shards --------------------------------------------------------------------------------------------------


def brute_shards(rows, shards):
    """(id, size, crc) -> counts by shard; rows (id, text, source, lang)."""
    points = []
    for i, text, source, lang in rows:
        data = (text or "").encode()
        crc = lambda s: zlib.crc32(s.encode()) if s is not None else 0
        points.append((i, len(data) + 1, zlib.crc32(data), (i or 0, crc(source), crc(lang), len(data) + 1)))
    nodes = [(0, shards, points)]
    while any(k > 1 for _, k, _ in nodes):
        span = [max(p[3][d] for p in points) - min(p[3][d] for p in points) for d in range(4)]
        cut = []
        for node, k, own in nodes:
            if k == 1 or not own:
                cut.append((node, 1, own))
                continue
            wide = [(max(p[3][d] for p in own) - min(p[3][d] for p in own)) / span[d] if span[d] else 0.0 for d in range(4)]
            dim = wide.index(max(wide))
            own = sorted(own, key=lambda p: (p[3][dim], p[2], p[0] is not None, p[0] or 0))
            total, upto, left = sum(p[1] for p in own), 0, []
            for p in own:
                upto += p[1]
                if (2 * upto - p[1]) * k <= 2 * total * (k // 2):
                    left.append(p)
            cut += [(node, k // 2, left), (node + k // 2, k - k // 2, own[len(left):])]
        nodes = cut
    return sorted((str(p[:3]), node) for node, _, own in nodes for p in own)


def shard_rows(messy_rows):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text, rng.choice(["hot", "hot", "a", None]), rng.choice(["en", "de"])) for r in messy_rows]
    return rows + [(20 + k % 170, "same text " * (k % 5), "hot" if k % 3 else f"s{k % 9}", "en") for k in range(400)]


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_equal_brute_force(spark, messy, shards):
    rows = shard_rows(messy.select("doc_id", "text").collect())
    df = spark.createDataFrame([(*r, "x", 3, "y") for r in rows], "doc_id bigint, text string, source string, lang string, size string, slot int, law string")
    got = kd.kd_shards(df.repartition(3), shards=shards)
    assert got.columns == ["doc_id", "source", "lang", *kd.COLUMNS]
    got = got.collect()
    assert sorted((str((r.doc_id, r["size"], r.text_crc32)), r.shard) for r in got) == brute_shards(rows, shards)
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}


def test_shards_are_near_equal_and_follow_the_target(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "repeat('w', int(id % 97)) AS text", "IF(id % 3 = 0, 'hot', string(id % 11)) AS source", "'en' AS lang")
    total = 3000 + sum(k % 97 for k in range(3000))
    sizes = kd.kd_shards(df, target_bytes=total // 6 + 1).groupBy("shard").agg(F.sum("size")).collect()
    assert len(sizes) == 6 and all(abs(r[1] - total / 6) <= 97 * 3 for r in sizes)
    with pytest.raises(ValueError):
        kd.kd_shards(df)


def test_shards_of_nothing_and_without_python(spark, empty):
    df = empty.withColumn("source", F.lit("s"))
    assert kd.kd_shards(df, shards=8).count() == 0 and kd.kd_shards(df, target_bytes=10).count() == 0
    plan = kd.kd_shards(spark.createDataFrame([(1, "t", "s", "en")], "doc_id bigint, text string, source string, lang string"), shards=2)
    assert "Python" not in plan._jdf.queryExecution().toString() and "Arrow" not in plan._jdf.queryExecution().toString()
