"""A cleaning pipeline over `documents`: every stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallycast.llm import bpe, decontaminate, jaccard, lines, quality, tokens


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample; the others are rejected."""
    return quality.stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier one but for one edit at most."""
    return lines.stage(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.stage(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.stage(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and digests of ids and decoded text."""
    import public_tokenizers

    tokenizer = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    return bpe.encode(docs, tokenizer, ("doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]

#: The stages' models, samples and tokenizer cannot be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each returns is written beside the checkpoints and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), tokens.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
