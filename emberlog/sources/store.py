"""The result store: two parquet tables, ``analyses`` and ``triages``, one-to-many."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name
from ..functions.times import span_text
from ..operators.counts import span_micros
from ..runtime import broadcast_if_small, materialize

TABLES = ("analyses", "triages")


def _table_path(root: str, table: str) -> str:
    if table not in TABLES:
        raise ValueError(f"unknown table: {table}")
    return f"{root.rstrip('/')}/{table}"


def read_store(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(_table_path(root, table))


def analysis_rows(summary: DataFrame) -> DataFrame:
    """SUMMARY -> rows of ``analyses``."""
    return summary.select(
        F.uuid().alias("id"),
        base_name(F.col("source_path")).alias("filename"),
        F.col("source_path").alias("file_path"),
        "detected_format",
        "total_lines",
        "parsed_lines",
        "failed_lines",
        "parse_success_rate",
        "error_rate",
        "level_counts",
        "top_errors",
        "top_sources",
        "status_codes",
        "earliest_ts",
        "latest_ts",
        span_text(span_micros(F.col("earliest_ts"), F.col("latest_ts"))).alias("time_span"),
        F.current_timestamp().alias("created_at"),
    )


def triage_rows(triages: DataFrame) -> DataFrame:
    """Parsed triage results with ``analysis_id`` -> rows of ``triages``."""
    return triages.select(
        F.uuid().alias("id"),
        "analysis_id",
        "summary",
        "overall_severity",
        "confidence",
        "issues",
        "provider_used",
        F.col("analysis_time_ms").cast("double").alias("analysis_time_ms"),
        "raw_analysis",
        F.current_timestamp().alias("created_at"),
    )


def _append(rows: DataFrame, root: str, table: str) -> None:
    dated = rows.withColumn("created_date", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("created_date").parquet(_table_path(root, table))


def append_analyses(summary: DataFrame, root: str) -> None:
    _append(analysis_rows(summary), root, "analyses")


def append_triages(triages: DataFrame, root: str) -> None:
    _append(triage_rows(triages), root, "triages")


def by_format(analyses: DataFrame, fmt: str | None) -> DataFrame:
    return analyses.where(F.col("detected_format") == fmt) if fmt else analyses


def by_filename(analyses: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of the file name; a blank text keeps all."""
    return analyses.where(F.lower("filename").contains(text.lower())) if text.strip() else analyses


def with_errors(analyses: DataFrame) -> DataFrame:
    return analyses.where(F.col("error_rate") > 0)


def by_id(df: DataFrame, id: str) -> DataFrame:
    return df.where(F.col("id") == id)


def analyses_count(analyses: DataFrame, fmt: str | None = None) -> DataFrame:
    return by_format(analyses, fmt).agg(F.count(F.lit(1)).alias("n"))


def distinct_formats(analyses: DataFrame) -> DataFrame:
    return analyses.select("detected_format").distinct().orderBy("detected_format")


def triages_of(analyses: DataFrame, triages: DataFrame) -> DataFrame:
    """Triages of the given analyses, newest first per analysis."""
    ids = analyses.select(F.col("id").alias("analysis_id"))
    return triages.join(ids, "analysis_id").orderBy("analysis_id", F.col("created_at").desc(), "id")


def latest_triage(analyses: DataFrame, triages: DataFrame) -> DataFrame:
    """Every analysis with its newest triage in ``triage``, null when it has none.

    The pick is an aggregation, so an analysis with very many triages is reduced before the join.
    """
    columns = F.struct(*[c for c in triages.columns if c != "analysis_id"])
    newest = triages.groupBy(F.col("analysis_id").alias("_id")).agg(
        F.max_by(columns, F.struct("created_at", "id")).alias("triage")
    )
    return analyses.join(newest, analyses["id"] == newest["_id"], "left").drop("_id")


def cascade_delete(analyses: DataFrame, triages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the listed analyses and their triages; write them to a new root."""
    gone = broadcast_if_small(materialize(ids.select(F.col("id").alias("_gone")).distinct()))
    kept_analyses = analyses.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    kept_triages = triages.join(gone, F.col("analysis_id") == F.col("_gone"), "left_anti")
    return kept_analyses, kept_triages


def delete_triages(triages: DataFrame, ids: DataFrame) -> DataFrame:
    gone = broadcast_if_small(materialize(ids.select(F.col("id").alias("_gone")).distinct()))
    return triages.join(gone, F.col("id") == F.col("_gone"), "left_anti")
