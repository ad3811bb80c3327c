"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tallycast.llm import alignment, bpe, decontaminate, fingerprint, jaccard, language, lines, multi_index, quality, spelling, substring, suffix, tokens


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix.repeats(_table(spark, sf, "documents"), columns=("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"))


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return quality.classify(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op3_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.repeated(_table(spark, sf, "documents"), 1).drop("text_hash")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op4_token_id_output(spark: SparkSession, sf: str) -> DataFrame:
    path = tokens.scratch(spark, "tokens")
    tokens.write(_table(spark, sf, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return tokens.read(spark, path)


def op5_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.classes(_table(spark, sf, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language.identify(_table(spark, sf, "documents"))


def op8_bpe_encode_decode(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(_table(spark, sf, "documents"), _tokenizer("word_bpe_49k.json"), columns)


def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that lose something; the others lose nothing."""
    return substring.deduplicate(_table(spark, sf, "documents"), copies=True).where("n_removed > 0").drop("kept")


def op10_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return fingerprint.edited(_table(spark, sf, "documents")).drop("kept")


def op11_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.search(_table(spark, sf, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(_table(spark, sf, "documents"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return alignment.align(_table(spark, sf, "documents"), _tokenizer("byte_bpe_50k.json"), model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_quality_classifier,
        op3_line_dedup,
        op4_token_id_output,
        op5_ngram_jaccard_join,
        op6_benchmark_decontamination,
        op7_language_id,
        op8_bpe_encode_decode,
        op9_substring_dedup,
        op10_document_fingerprints,
        op11_nearest_neighbours,
        op12_spelling_variants,
        op13_cross_tokenizer_alignment,
    )
}

#: Words as the operators split them, in DuckDB: A-Z lower-cased, runs without space and the controls 9 to 13.
_WORDS = r"""
words AS (SELECT {id}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table}),
"""
_SHINGLES = """list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)"""

ORACLE_SQL = {
    "op6_benchmark_decontamination": f"""
WITH d{_WORDS.format(id="doc_id", table="documents").strip()} i{_WORDS.format(id="item_id", table="benchmark").strip()}
ds AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM dwords),
its AS (SELECT item_id, len({_SHINGLES}) AS n_item, unnest({_SHINGLES}) AS s FROM iwords)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN its USING (s) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item""",
}
