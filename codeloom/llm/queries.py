"""The thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontam, line_dedup, quality, secrets_scan, simhash, suffix_dedup, tiff, toxicity
from .common import documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.round_trip_digests(documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(documents(spark, sf_dir))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(documents(spark, sf_dir))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.report(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_tiff_media, op3_suffix_dedup, op4_chat_format, op5_toxicity, op6_line_dedup, op7_decontamination, op8_quality, op9_simhash, op10_secrets)}

ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": suffix_dedup.SQL, "op6_line_dedup": line_dedup.SQL, "op7_decontamination": decontam.SQL}
