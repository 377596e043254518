"""Queries over the given tables that apply the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chunks, conversations, divergence, hard_negatives, language, licences, near_duplicates, oracles, packing, passages, resampling, rules, set_join, workers

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    workers.prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "labels"), F.col("quality") == 1)


def _near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf, "documents"))


def _roles(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(table(spark, sf, "conversations"))


def _language(spark: SparkSession, sf: str) -> DataFrame:
    rows = language.document_evidence(table(spark, sf, "documents").select("doc_id", "text", "lang", "source"))
    return language.identify(rows, language.fit(rows)).select("doc_id", "language", "posterior", "kept")


def _page_language(spark: SparkSession, sf: str) -> DataFrame:
    rows = language.page_evidence(table(spark, sf, "pages"))
    return language.identify(rows, language.fit(rows)).select("page_id", "language", "posterior", "kept")


def _bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode(coded, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.tokenize(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.pack(pieces, packing.expected_pieces(docs)).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def _packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


def _passages(spark: SparkSession, sf: str) -> DataFrame:
    return passages.repeated(table(spark, sf, "documents"))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = rules.decide(rules.ledger(rules.measure(table(spark, sf, "documents"))))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("kept_base")).alias("base_failed"), F.col("kept_v1").alias("kept"), "n_lines", "n_exclamations", "failed_bits",
    )


def _licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return licences.train(docs).scan(docs)


def _fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.compare_with_edits(table(spark, sf, "documents"))


def _divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.audit(table(spark, sf, "documents"))


def _hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, rows.where("vec_id % 100 = 0"))


def _set_join(spark: SparkSession, sf: str) -> DataFrame:
    return set_join.linked(table(spark, sf, "documents"))


def _pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Query]:
    return {
        "pipeline": _pipeline,
        "op1_importance_resampling": _resampling,
        "op2_order_minhash": _near_duplicates,
        "op3_role_repair": _roles,
        "op4_language_id": _language,
        "page_language": _page_language,
        "op5_bpe": _bpe,
        "op6_packing": _packing,
        "op7_compact_windows": _passages,
        "op8_quality_rules": _rules,
        "op9_licence_scan": _licences,
        "op10_fingerprints": _fingerprints,
        "op11_source_divergence": _divergence,
        "op12_hard_negatives": _hard_negatives,
        "op13_ngram_join": _set_join,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
