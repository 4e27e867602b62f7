"""The corpus pipeline: each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.llm import packing, pii, quality, simhash, toxicity
from weirflow.llm.common import staged, table
from weirflow.plans.fixpoint import discard, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; the trusted target is the labels' quality 1.

    A null or empty text has too few words and goes. Repeated rows are judged alike; a score equal to the threshold
    stays; an empty table stays empty. All columns pass, whatever their names.
    """
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    A null text is the empty text, whose score is the model's intercept. Repeated rows are judged alike; a score of
    exactly one half goes; an empty table stays empty. All columns pass, whatever their names.
    """
    return toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that of the smallest doc_id, null ids last.

    Null and empty texts are one group. A repeated row stays once; of rows equal in id and text the other columns
    decide by their hash. An empty table stays empty. All columns pass, whatever their names.
    """
    return simhash.keep_one_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers, plain and disguised, give way to their kind's name; n_chars is counted again.

    Of identifiers that overlap the first kind names the whole. A null text stays null. Repeated rows are rewritten
    alike, an empty table stays empty; all other columns pass, whatever their names.
    """
    return pii.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null text is the empty text: one piece of the end id. Repeated rows are packed each for itself; pieces of equal
    length are in order of doc_id and piece. An empty table gives no rows; other columns are not read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_documents),
    ("simhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", sequences),
]

#: SQL can't express the stages (Viterbi decoding, XXH64, tokens); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage wrote on its way is deleted once its result is written, and that once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(staged(stage(spark, docs, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
