"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.substring_dedup import dedup_substrings

    return dedup_substrings(_table(spark, sf_dir, "documents"), 35).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.simhash_dedup import near_components

    return near_components(_table(spark, sf_dir, "documents"), 3, 3).select("doc_id", "fingerprint", "component_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.decontaminate import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.quality_rules import quality

    return quality(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.chat_format import repair

    return repair(_table(spark, sf_dir, "conversations"))


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from equiloom.llm.token_files import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.suffix_dedup import dedup_suffixes

    return dedup_suffixes(_table(spark, sf_dir, "documents"), 200).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.source_mix import mix_sizes

    return mix_sizes(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.toxicity import fit, grade

    docs = _table(spark, sf_dir, "documents")
    return grade(docs, fit(docs, _table(spark, sf_dir, "labels")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from equiloom.llm.hard_negatives import mine

    return mine(_table(spark, sf_dir, "embeddings"), relabel_every=7)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from equiloom.llm.piece_text import tokenize

    return tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {k: f for k, f in globals().items() if k.startswith("op")} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    from equiloom.llm import filter_audit, hard_negatives, license_scan, source_mix, substring_dedup

    return {"op1_substring_dedup": substring_dedup.oracle(), "op7_license_scan": license_scan.oracle(), "op9_source_mix": source_mix.oracle(), "op11_filter_audit": filter_audit.oracle(), "op12_hard_negatives": hard_negatives.oracle()}
