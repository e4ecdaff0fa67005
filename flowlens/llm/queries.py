"""Queries of this subpackage: one per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from flowlens.llm import (
    byte_cnn, lexical, mixing, near_dup, neighbours, packing, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity,
    value_codes, warc_revisit,
)
from flowlens.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    work_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


@_query("op1_quality_cnn")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.op1_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op2_suffix_dedup(_table(spark, sf_dir, "documents"))


@_query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op3_packing(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query("op4_mixing", mixing.oracle())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4_mixing(_table(spark, sf_dir, "documents"))


@_query("op5_warc_revisit", warc_revisit.oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisit.op5_warc_revisit(_table(spark, sf_dir, "pages"))


@_query("op6_near_dup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.op6_near_dup(_table(spark, sf_dir, "documents"))


@_query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.op7_substring_dedup(_table(spark, sf_dir, "documents"))


@_query("op8_quality_rules", quality_rules.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op8_quality_rules(_table(spark, sf_dir, "documents"))


@_query("op9_toxicity_fm")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op10_neighbours")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op10_neighbours(_table(spark, sf_dir, "embeddings"))


@_query("op11_value_codes", value_codes.oracle())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_codes.op11_value_codes(_table(spark, sf_dir, "embeddings"))


@_query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op12_simhash(_table(spark, sf_dir, "documents"))


@_query("op13_lexical", lexical.oracle())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op13_lexical(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
