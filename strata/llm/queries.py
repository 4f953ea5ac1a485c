"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import brown, embeddings, html_text, mixing, packing, quadratic, quality_rules, secrets, simhash, sql, warc
from strata.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quadratic.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(table(spark, sf_dir, "documents"))


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_packing, op4_html_text, op5_warc, op6_secrets, op7_embeddings, op8_simhash, op9_mixing, op10_brown_lm)}


def oracle_sql() -> dict[str, str]:
    """The others are beyond SQL: a trained model, a tokenizer, HTML, XXH64. Tests hold them against brute force."""
    return {
        "op1_quality_rules": sql.quality_rules_sql(),
        "op5_warc": sql.warc_sql(),
        "op6_secrets": sql.secrets_sql(),
        "op7_embeddings": sql.embeddings_sql(),
        "op9_mixing": sql.mixing_sql(),
    }
