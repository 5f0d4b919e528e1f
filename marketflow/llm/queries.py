"""Registered queries of the text operators, over their whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketflow.llm import (bpe, decontaminate, hard_negatives, html_extract, jaccard_join, kd_shards, line_dedup, pii, quality_rules,
                            substring_dedup, toxicity, url_filter, vector_codes)
from marketflow.llm.registry import query, table



def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_quality_rules", quality_rules.ORACLE)
def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op5_url_filter", url_filter.ORACLE)
def op5_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.filter_urls(pages, url_filter.RULES).drop("url")


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    marked = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                         F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op10_byte_pair")
def op10_byte_pair(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, tokenizer_path()))


@query("op1_substring_dedup")
def op1_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cut = substring_dedup.substring_dedup(docs)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return jaccard_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


@query("op6_html_extract")
def op6_html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_extract.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score_toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query("op8_pii")
def op8_pii(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pii.digests(pii.find_pii(docs))


@query("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    n_deleted = F.aggregate("deleted", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", n_deleted.alias("n_deleted"), F.sha2(
        F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("clean_sha256"))


@query("op11_vector_codes", vector_codes.oracle())
def op11_vector_codes(spark, sf_dir):
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.sha2(
        F.lit(vector_codes.codebook_text(books)).cast("binary"), 256).alias("codebooks_sha256"))


@query("op12_kd_shards", kd_shards.oracle(8))
def op12_kd_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return kd_shards.kd_shards(docs, shards=8).select("doc_id", *kd_shards.COLUMNS)


@query("op13_hard_negatives", hard_negatives.ORACLE)
def op13_hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn(
        "label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)
