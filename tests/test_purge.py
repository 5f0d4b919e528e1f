"""Purged, embargoed and walk-forward splits and interval overlap against all pairs."""

import random

import pytest

from marketflow.operators import purge

SCHEMA = "key string, id int, s bigint, e bigint, fold string"


def rows():
    rng = random.Random(3)
    out = [("hot", k, rng.randint(0, 300), None, "f") for k in range(300)]
    out += [(rng.choice(["a", "b", None]), 1000 + k, rng.randint(0, 90), None, "f") for k in range(240)]
    out = [(k, i, s, rng.choice([None, s, s - 5, s + rng.randint(0, 12)]), f) for k, i, s, _, f in out]
    return out + [("a", 5000, None, 7, "f"), ("one", 5001, 4, 9, "f")]


def end(r):
    return max(r[2], r[3] if r[3] is not None else r[2])


def test_purged_folds_equal_all_pairs(spark):
    data = [r for r in rows()]
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = purge.purged_folds(df, "s", "e", 4, "key", embargo=6, fold_col="in_fold").collect()
    by = {}
    for r in got:
        by.setdefault((r.key, r.in_fold), {})[r.id] = r.role
    spans = {r[1]: (r[2], end(r)) for r in data if r[2] is not None}
    assert {k for k, _ in by} == {"hot", "a", "b", None, "one"} and sum(len(x) for k, x in by.items() if k[0] == "hot") == 1200
    for (key, fold), roles in by.items():
        test = [spans[i] for i, role in roles.items() if role == "test"]
        first, last = min(a for a, _ in test), max(z for _, z in test)
        for i, role in roles.items():
            a, z = spans[i]
            touches = any(a <= y and x <= z for x, y in test)
            assert role == "test" or (role == "purged") == touches, (key, fold, i, role)
            if role in ("train", "embargoed"):
                assert (role == "embargoed") == (a > first and last < a <= last + 6)


def test_walk_forward_trains_on_the_past_only(spark):
    df = spark.createDataFrame([r for r in rows() if r[0] == "hot"], SCHEMA).repartition(4)
    got = purge.purged_folds(df, "s", "e", 3, walk_forward=True, train_span=60, fold_col="in_fold").collect()
    assert {r.in_fold for r in got} == {1, 2, 3}
    for f in (1, 2, 3):
        test = [r for r in got if r.in_fold == f and r.role == "test"]
        first = min(r.s for r in test)
        rest = [r for r in got if r.in_fold == f and r.role != "test"]
        assert rest and all(first - 60 <= r.s <= first for r in rest)
        assert all((r.role == "purged") == (max(r.s, r.e if r.e is not None else r.s) >= first) for r in rest)


def test_overlaps_any_equals_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    got = {r.id: r.overlaps for r in purge.overlaps_any(df, df.where("id % 17 = 0"), "s", "e", "key").collect()}
    test = [r for r in data if r[1] % 17 == 0 and r[2] is not None]
    assert len(got) == len(data)
    for r in data:
        want = r[2] is not None and any(t[0] == r[0] and r[2] <= end(t) and t[2] <= end(r) for t in test)
        assert got[r[1]] == want


@pytest.mark.parametrize("keys", [None, "key"])
def test_nothing_to_split(spark, keys):
    df = spark.createDataFrame([], SCHEMA)
    assert purge.purged_folds(df, "s", "e", 4, keys, fold_col="in_fold").count() == 0
    assert purge.overlaps_any(df, df, "s", "e", keys).count() == 0
