"""The queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chunked_bpe, clustering, hard_negatives, language_id, language_model, order_minhash, packing, quality_classifier, quality_rules, rules_sql, simhash, suffix_dedup, toxicity, vector_sql
from .common import documents, embeddings, labels


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(documents(spark, sf_dir))


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.train(docs, labels(spark, sf_dir)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_documents(documents(spark, sf_dir))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.strip_documents(documents(spark, sf_dir))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprint_documents(documents(spark, sf_dir))


def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.encode_documents(documents(spark, sf_dir))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(embeddings(spark, sf_dir))


def op13_exponion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_vectors(embeddings(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_language_model": op2_language_model,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_quality_rules": op4_quality_rules,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_toxicity": op6_toxicity,
        "op7_simhash": op7_simhash,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_order_minhash": op10_order_minhash,
        "op11_chunked_bpe": op11_chunked_bpe,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_exponion": op13_exponion,
    }


def oracle_sql() -> dict[str, str]:
    """The rules and the operators on vectors can be said in SQL whole: the others need models, tokenisers or hashes that it lacks."""
    return {"op4_quality_rules": rules_sql.SQL, "op12_hard_negatives": vector_sql.MINING, "op13_exponion": vector_sql.clustering()}
