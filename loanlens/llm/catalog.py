"""The registered corpus queries and their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from loanlens.llm import (
    classifier, filter_audit, html_extract, jaccard_join, license_scan, mixing, nearest, packing, pii,
    quality_rules, spelling, token_counts, toxicity)
from loanlens.llm.common import read_table, whole_text, word_count
from loanlens.session import ensure_checkpoint_dir, materialize

PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTING_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", "source", word_count(whole_text()).alias("size"))
    return mixing.mix(materialize(docs, "mix-sizes")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, threshold = classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return classifier.classify(docs, weights, threshold).select(
        "doc_id", "held_out", "score", "predicted", "strength")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, PACKING_TOKENIZER, pattern=public_tokenizers.PATTERN)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.similarity_classes(docs).select("doc_id", "class_id", "n_links", "n_copies")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache of its own, so every distinct text is encoded."""
    cache = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/token-cache-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, COUNTING_TOKENIZER, cache, drops_space=True).select(
        "doc_id", "n_bytes", "n_tokens", "over_limit")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract(pages)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", *license_scan.RESULTS)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, F.col("id") % 50 == 0, k=5)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).select("doc_id", "held_out", "score", "predicted")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spelling.variants(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_mixing": op2_mixing,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_personal_data": op5_personal_data,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_token_counts": op7_token_counts,
        "op8_html_extraction": op8_html_extraction,
        "op9_license_scan": op9_license_scan,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_filter_audit": op11_filter_audit,
        "op12_toxicity": op12_toxicity,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules.SQL, "op2_mixing": mixing.sql(),
            "op6_jaccard_join": jaccard_join.SQL, "op11_filter_audit": filter_audit.SQL}
