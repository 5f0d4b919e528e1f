"""Registered queries: result columns and types, one row per input row, and the entry without this subpackage."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
WANT = {
    "op1_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op2_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op3_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op4_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                         "n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op6_html_extract": "page_id bigint, url string, text string, n_chars bigint",
    "op7_line_dedup": "doc_id bigint, n_lines bigint, n_deleted bigint, clean_sha256 string",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op9_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op10_byte_pair": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_vector_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op12_kd_shards": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}
SOURCES = {"op5_url_filter": "pages", "op6_html_extract": "pages", "op11_vector_codes": "embeddings", "op13_hard_negatives": None}


def test_all_are_registered():
    assert set(WANT) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", list(WANT))
def test_contract_columns(spark, name):
    got = entry.queries()[name](spark, SF)
    assert ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in got.schema.fields) == WANT[name]
    source = SOURCES.get(name, "documents")
    if source:
        assert got.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_entry_imports_without_the_subpackage():
    code = ("import sys; sys.modules['marketflow.llm'] = None; sys.modules.pop('corpus_pipeline', None)\n"
            "import importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name == 'corpus_pipeline': raise ModuleNotFoundError(name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e; q = e.queries(); assert q and not any(x.startswith('op1') for x in q)")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
