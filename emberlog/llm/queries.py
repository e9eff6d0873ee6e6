"""The registered queries of the corpus operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    fingerprints,
    language,
    line_dedup,
    merkle,
    mixing,
    ngram_join,
    oracles,
    packing,
    quality,
    resampling,
    secrets,
    suffix_dedup,
    token_counts,
    token_files,
)
from .common import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_documents(spark, sf_dir))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_documents(spark, sf_dir))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_strings(read_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(read_documents(spark, sf_dir)))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_documents(spark, sf_dir))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(read_documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(read_documents(spark, sf_dir), least_words=1)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return resampling.resample(read_documents(spark, sf_dir), benchmark)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(read_documents(spark, sf_dir))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language,
        op2_token_counts,
        op3_suffix_dedup,
        op4_mixing,
        op5_secrets,
        op6_packing,
        op7_fingerprints,
        op8_quality,
        op9_ngram_join,
        op10_line_dedup,
        op11_resampling,
        op12_merkle_manifest,
        op13_token_files,
    )
}
#: DuckDB twins, where SQL can express the operator on whole tables.
ORACLES: dict[str, str] = {
    "op11_resampling": oracles.RESAMPLING,
    "op12_merkle_manifest": oracles.MERKLE,
}
