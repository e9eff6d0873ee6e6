"""Counts, ranges, samples and rankings per source.

All of them are keyed by ``source_path`` plus a value, so Spark aggregates on the map side first and one
huge source spreads over its values. Parsed entries only: lines that failed do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import is_error, is_warning
from ..functions.rates import error_rate, parse_success_rate
from ..functions.text import is_blank
from ..runtime import settle
from ..schema import DEFAULT_SAMPLES, MAX_SAMPLES, TOP_K
from .ranking import first_k, top_k

SAMPLE_FIELDS = ("line_id", "event_ts", "event_ts_local", "level", "message", "source", "raw")


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))


def line_counts(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Per source: total, blank, parsed and failed lines, total = blank + parsed + failed."""
    totals = lines.groupBy("source_path").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(is_blank(F.col("raw"))).alias("blank_lines")
    )
    parsed = entries.groupBy("source_path").agg(F.count_if(F.col("parsed")).alias("parsed_lines"))
    joined = totals.join(parsed, "source_path", "left")
    done = F.coalesce(F.col("parsed_lines"), F.lit(0))
    return joined.select(
        "source_path",
        "total_lines",
        "blank_lines",
        done.alias("parsed_lines"),
        (F.col("total_lines") - F.col("blank_lines") - done).alias("failed_lines"),
    )


def level_counts(entries: DataFrame) -> DataFrame:
    named = entries.where(F.col("parsed") & (F.col("level") != ""))
    return named.groupBy("source_path", "level").agg(F.count(F.lit(1)).alias("n"))


def status_counts(entries: DataFrame) -> DataFrame:
    coded = settle(entries.select("source_path", "line_id", "parsed", "status"), "status").where(
        F.col("parsed") & F.col("status").isNotNull()
    )
    return coded.groupBy("source_path", "status").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line")
    )


def _ranked_values(rows: DataFrame, value: str, k: int) -> DataFrame:
    counted = rows.groupBy("source_path", value).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line")
    )
    return top_k(counted, [F.col("n").desc(), F.col("first_line")], k, per="source_path", rank="position")


def top_sources(entries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Most frequent sources per file, ties to the one seen first."""
    named = settle(entries.select("source_path", "line_id", "parsed", "source"), "source")
    return _ranked_values(named.where(F.col("parsed") & (F.col("source") != "")), "source", k)


def top_errors(entries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Most frequent messages of error entries per file, ties to the one seen first."""
    return _ranked_values(entries.where(F.col("parsed") & is_error(F.col("level"))), "message", k)


def time_range(entries: DataFrame) -> DataFrame:
    return (
        entries.where("parsed")
        .groupBy("source_path")
        .agg(F.min("event_ts").alias("earliest_ts"), F.max("event_ts").alias("latest_ts"))
    )


def span_micros(earliest: Column, latest: Column) -> Column:
    return F.unix_micros(latest) - F.unix_micros(earliest)


def time_span(ranges: DataFrame) -> DataFrame:
    """Add ``span`` (interval) and ``span_seconds``; null when an end is missing."""
    return ranges.withColumn("span", F.col("latest_ts") - F.col("earliest_ts")).withColumn(
        "span_seconds",
        F.floor(span_micros(F.col("earliest_ts"), F.col("latest_ts")) / 1_000_000).cast("bigint"),
    )


def rates(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """Error rate over parsed lines and parse success over all lines, in percent."""
    counts = line_counts(lines, entries)
    errors = (
        entries.where(F.col("parsed") & is_error(F.col("level")))
        .groupBy("source_path")
        .agg(F.count(F.lit(1)).alias("error_lines"))
    )
    joined = counts.join(errors, "source_path", "left")
    return joined.select(
        "source_path",
        error_rate(F.coalesce(F.col("error_lines"), F.lit(0)), F.col("parsed_lines")).alias("error_rate"),
        parse_success_rate(F.col("parsed_lines"), F.col("total_lines")).alias("parse_success_rate"),
    )


def _samples(rows: DataFrame, per: list[str], k: int) -> DataFrame:
    if not 1 <= k <= MAX_SAMPLES:
        raise ValueError(f"sample size must be within 1..{MAX_SAMPLES}")
    return first_k(rows, per, [F.col("line_id")], k, rank="position")


def error_samples(entries: DataFrame, k: int = DEFAULT_SAMPLES) -> DataFrame:
    """First ``k`` error entries per source, in file order."""
    return _samples(entries.where(F.col("parsed") & is_error(F.col("level"))), ["source_path"], k)


def warning_samples(entries: DataFrame, k: int = DEFAULT_SAMPLES) -> DataFrame:
    return _samples(entries.where(F.col("parsed") & is_warning(F.col("level"))), ["source_path"], k)


def severity_samples(entries: DataFrame, k: int = DEFAULT_SAMPLES) -> DataFrame:
    """Error and warning samples in one pass; ``kind`` is ``error`` or ``warning``."""
    level = F.col("level")
    kind = F.when(is_error(level), "error").when(is_warning(level), "warning")
    rows = entries.where(F.col("parsed") & (is_error(level) | is_warning(level))).withColumn("kind", kind)
    return _samples(rows.select("source_path", "kind", *SAMPLE_FIELDS), ["source_path", "kind"], k)


def errors_and_warnings(errors: DataFrame, warnings: DataFrame) -> DataFrame:
    return errors.unionByName(warnings)


def warning_messages(entries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Messages of the first 50 warnings, cut to 100 characters, by frequency."""
    sample = warning_samples(entries, 50).select(
        "source_path", "line_id", F.left(F.col("message"), F.lit(100)).alias("message"), F.lit(True).alias("parsed")
    )
    return _ranked_values(sample, "message", k)


def approx_top(entries: DataFrame, col: str, k: int = TOP_K, max_items: int = 10_000) -> DataFrame:
    """Bounded-memory estimate of the most frequent values per source; exact below ``max_items`` values."""
    picked = entries.where(F.col("parsed") & F.col(col).isNotNull()).groupBy("source_path")
    found = picked.agg(F.expr(f"approx_top_k(`{col}`, {int(k)}, {int(max_items)})").alias("top"))
    return found.select("source_path", F.posexplode("top").alias("place", "pair")).select(
        "source_path", (F.col("place") + 1).alias("position"), F.col("pair.item").alias(col), F.col("pair.count").alias("n")
    )
