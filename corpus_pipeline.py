"""Corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prose_spark.llm import language_id, line_dedup, mixing, packing, simhash
from prose_spark.llm.common import Scratch


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null texts, those without a letter, and those of which no language holds half of the
    probability. Without any labelled document all texts with a letter stay. Repeated rows stay or go alike; an empty table stays empty."""
    return language_id.accepted(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; documents made of nothing else go. A null text stays null; rows equal in
    doc_id and text are one document, and give the same result each; a null doc_id comes first; an empty table stays empty."""
    return line_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, stays of each group linked by 0.8 or more of the five-word shingles. Texts without a word are one
    group; of repeated rows one stays; a null doc_id is the smallest; ties go to the smaller hash of the text; an empty table stays empty."""
    return simhash.near_dedup(docs, shingle=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their weights; a document comes as often as its source is repeated, in the last pass if its block is drawn. Texts without
    a word are never drawn; a null source is one of its own; repeated rows are drawn each; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens. A null or empty text is the end token alone; repeated rows are packed each; an empty table gives none."""
    return packing.pack(docs)


STAGES = [
    ("language_id", tell_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Networks, fingerprints, draws and tokenizers aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
