"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat as _chat
from . import exact_dedup as _exact
from . import html_text as _html
from . import language_id as _language
from . import line_dedup as _lines
from . import mixing as _mixing
from . import packing as _packing
from . import quality as _quality
from . import simhash as _simhash
from . import token_rollup as _rollup
from .common import documents


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mix_report(documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.identify(documents(spark, sf_dir))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup.rollup_report(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(documents(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.line_report(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _simhash.near_groups(documents(spark, sf_dir), shingle=3, radius=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quality.fitted_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat.recover_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_rollup": op4_token_rollup,
    "op5_packing": op5_packing,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_quality": op8_quality,
    "op9_html_text": op9_html_text,
    "op10_chat": op10_chat,
}

ORACLES = {
    "op2_exact_dedup": _exact.ORACLE,
}
