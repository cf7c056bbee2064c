"""The corpus pipeline: five stages, each over all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Each
result is written as Parquet and read again, so a stage's work is done once and outlives executors.

Of every stage: texts are read whole, however long they are; an empty table gives an empty one; further columns of docs pass
through all but the last stage as they are, whatever their names, since a stage's own columns avoid names that are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mentionlab.llm import decontaminate, mixing, quality, simhash, tokens
from mentionlab.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; cutoffs from the labelled ones among them. Null and empty texts are short and
    go; rows that repeat an id are judged each; a null language is a stratum; an empty table gives an empty one."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least doc_id, a null id last. Rows are told apart by
    numbers of their own: those that repeat an id, or have none, stay unless their texts are near-duplicates."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items. A text without words is not; repeated rows are judged each."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them, rows that repeat an id or have none each for itself; a null
    source is one of its own, last. Each source's words are what op10's mix takes of it."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; returns doc_id, start, n_tokens, ids_crc32 as read back from them, a row for each document,
    in ascending doc_id, null first, equal ids in order of text."""
    return tokens.read_tokens(tokens.write_tokens(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token output", token_output),
]

#: Fingerprints (XXH64) and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
