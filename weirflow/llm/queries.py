"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import alignment, chat, clusters, counting, encoding, html_text, packing, pii, quality, simhash, spotsigs, toxicity, urls
from weirflow.llm.common import table


def op1_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.encode_documents(table(spark, sf_dir, "documents"))


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_temporal_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query(table(spark, sf_dir, "pages"))


def op6_toxicity_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.token_counts(table(spark, sf_dir, "documents"))


def op8_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.formatted(chat.with_control_case(table(spark, sf_dir, "conversations"))))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_deobfuscation": op1_pii_deobfuscation,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_spotsigs": op3_spotsigs,
        "op4_quality_ratio": op4_quality_ratio,
        "op5_url_temporal_join": op5_url_temporal_join,
        "op6_toxicity_channel": op6_toxicity_channel,
        "op7_trie_token_counts": op7_trie_token_counts,
        "op8_chat_masks": op8_chat_masks,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_html_main_text": op11_html_main_text,
        "op12_centroid_clusters": op12_centroid_clusters,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_temporal_join": urls.ORACLE,
    }
