"""Corpus pipeline over ``documents``: quality rules, line deduplication, one document of each near-duplicate
group, benchmark decontamination, byte-pair encoding.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all that the stage before kept, and its
result is written as Parquet and read again as the next stage's docs. All stages but the last return the
columns of documents; n_chars follows the text. ``run`` applies them to the documents table.

* quality_rules: documents that the rules reject go; kept ones lose their failing lines.
* line_dedup: later copies of repeated runs of lines are deleted; a document with nothing left goes.
* jaccard_join: of each group of near duplicates the document with the smallest id stays.
* decontaminate: contaminated documents go.
* byte_pair: ids, their number, and the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketflow.llm import bpe, common, decontaminate, jaccard_join, line_dedup, quality_rules
from marketflow.llm.queries import tokenizer_path
from marketflow.llm.registry import query

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The documents' columns with another text."""
    return docs.withColumns({"text": F.col(text), "n_chars": F.length(text).cast("bigint")}).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(quality_rules.quality_rules(docs).where("kept"), "clean_text")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(docs)
    return _with_text(out.where((F.size("deleted") == 0) | (F.length(F.trim(F.col("clean_text"), F.lit(quality_rules.SPACES))) > 0)),
                      "clean_text")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(docs, keep_one=True).select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*COLUMNS)


def byte_pair_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(docs, tokenizer_path())
    return out.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", "decoded")


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("jaccard_join", jaccard_stage),
          ("decontaminate", decontaminate_stage), ("byte_pair", byte_pair_stage)]
#: Near-duplicate components and token ids have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
