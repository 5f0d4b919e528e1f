"""Rows under one (null) id stay apart whatever their texts hash to, and equal rows are worked on once."""

import pytest

from marketflow.llm import jaccard_join, line_dedup, substring_dedup

# two texts with one 32-bit Murmur hash
TWINS = ["alpha beta gamma delta eps w158524", "alpha beta gamma delta eps w218033"]
SCHEMA = "doc_id bigint, text string"


def table(spark, texts, doc_id=None):
    return spark.createDataFrame([(doc_id, t) for t in texts], SCHEMA)


def test_the_texts_do_collide(spark):
    assert table(spark, TWINS).selectExpr("hash(text) AS h").distinct().count() == 1


def test_lines_of_twins_stay(spark):
    df = table(spark, [TWINS[0], TWINS[1]]).union(spark.createDataFrame([(1, TWINS[0])], SCHEMA))
    got = {(r.doc_id, r.text): r.clean_text for r in line_dedup.line_dedup(df).collect()}
    assert got == {(1, TWINS[0]): TWINS[0], (None, TWINS[0]): "", (None, TWINS[1]): TWINS[1]}


def test_components_of_twins(spark):
    near = " ".join(f"n{k}" for k in range(40))
    df = table(spark, TWINS).union(spark.createDataFrame([(2, TWINS[0]), (5, near)], SCHEMA)).union(table(spark, [near + " x"]))
    got = sorted(((r.doc_id, r.text, r.component_id) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert got == sorted([(2, TWINS[0], 2), (None, TWINS[0], 2), (None, TWINS[1], None), (5, near, 5), (None, near + " x", 5)], key=str)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_one_row_of_a_component_stays_whatever_its_ids(spark, doc_id):
    near = " ".join(f"n{k}" for k in range(60))
    df = table(spark, [near, near + " x", "y " + near, near, TWINS[0]], doc_id)
    kept = sorted(r.text for r in jaccard_join.near_duplicates(df, keep_one=True).collect())
    assert len(kept) == 2 and TWINS[0] in kept


def test_spans_of_twins(spark):
    long = [" ".join(f"v{k}" for k in range(70)) + " " + t for t in TWINS]
    df = spark.createDataFrame([(1, long[0])], SCHEMA).union(table(spark, long))
    got = {(r.doc_id, r.text): r.n_removed for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {(1, long[0]): 0, (None, long[0]): 76, (None, long[1]): 75}


def test_equal_rows_bring_their_spans_once(spark):
    passage = " ".join(f"v{k}" for k in range(60))
    df = table(spark, [f"start {passage} end"] * 3000, 9).union(spark.createDataFrame([(1, passage)], SCHEMA)).repartition(4)
    base = df.selectExpr("coalesce(doc_id, 9223372036854775807) AS __doc", "text").withColumn("__th", substring_dedup.common.text_key(df.text))
    spans = substring_dedup.repeated_intervals(base, "text").collect()
    assert len(spans) == 1 and len(spans[0]["__spans"]) <= 3
    out = substring_dedup.substring_dedup(df).groupBy("doc_id", "n_removed").count().collect()
    assert sorted(map(tuple, out)) == [(1, 0, 1), (9, 60, 3000)]


def test_equal_rows_are_one_set(spark):
    df = table(spark, [" ".join(f"v{k}" for k in range(60))] * 500, 3).union(
        table(spark, [" ".join(f"v{k}" for k in range(60)) + " z"] * 500, 4)).repartition(4)
    slim = df.select(df.doc_id.alias("doc"), jaccard_join.common.text_key(df.text).alias("th"), "text")
    sized = jaccard_join.common.written(jaccard_join._sized(slim, 5), "sized")
    kept = sized.groupBy("k1", "k2", "n").agg({"doc": "min"}).withColumnRenamed("min(doc)", "doc").join(
        sized.drop("doc").distinct(), ["k1", "k2", "n"]).selectExpr("doc", "th", "doc AS rep", "k1", "0L AS own", "k2")
    assert jaccard_join._survivors(slim, kept, 5).count() == 2


def test_index_travels_whole():
    import pickle

    import numpy as np

    from marketflow.llm import toxicity

    rng = np.random.default_rng(1)
    dense = (rng.random((70, 40)) * (rng.random((70, 40)) < np.linspace(0.02, 0.9, 40))).astype(np.float32)
    index = toxicity.BlockMaxIndex(dense, np.arange(70), np.arange(70) % 2)
    back = pickle.loads(pickle.dumps(index))
    assert (back.blocks == index.blocks).all() and (back.maxima == index.maxima).all()
    for a, b in zip(index.search(dense[:9]), back.search(dense[:9])):
        assert (a == b).all()
