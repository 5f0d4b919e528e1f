"""The pipeline against brute force, stage by stage, on messy rows and on sf0.001."""

import re

import duckdb

import corpus_pipeline
from marketflow.llm import quality_rules
from tests.llm.conftest import messy_texts
from tests.llm.test_text_operators import SF, brute_components, brute_hits, brute_lines


def brute(docs, items):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    docs = [(r[0], r[-1]) for r in con.sql(quality_rules._sql("documents")).fetchall() if r[-2]]
    lines = brute_lines(docs)
    docs = [(i, lines[i, t][3]) for i, t in docs if not lines[i, t][2] or re.search(r"[^\x20\x09-\x0D]", lines[i, t][3])]
    least = {i: c for i, _, c in brute_components(docs)}
    seen = set()
    docs = [(i, t) for i, t in docs if least[i] in (i, None) and not ((i, t) in seen or seen.add((i, t)))]
    bad = {i for i, *_, c in brute_hits(docs, items) if c}
    return [(i, t) for i, t in docs if i not in bad]


def test_pipeline(spark):
    from tokenizers import Tokenizer

    from marketflow.llm.queries import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path())
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    want = dict(brute(docs, items))
    assert set(got) == set(want)
    for i, text in want.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i]["decoded"] == text and got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)


def test_stages_on_messy_rows(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in messy_texts()]
    now = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
        assert out.where("n_chars <> length(text)").count() == 0
        assert stage(spark, now.limit(0), SF).count() == 0
        if name != "quality_rules":
            now = out
    name, stage = corpus_pipeline.STAGES[-1]
    assert stage(spark, now, SF).count() == now.count()
    one = corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(
        [(1, "a b c d e f g", "en", "s", 13)] * 3 + [(2, "a b c d e f g", "en", "s", 13)], now.schema), SF)
    assert [r[0] for r in one.collect()] == [1]
