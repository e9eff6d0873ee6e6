"""SUMMARY -> CSV sections, JSON documents, Markdown reports.

Each source becomes one document, put together from its own arrays and maps, so writing stays
distributed over sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_rank, status_category
from ..functions.rates import pct
from ..functions.text import base_name, escape_text
from ..functions.times import iso_text, span_text, utc_wall_clock
from ..operators.counts import span_micros
from ..operators.tables import clock_text, percent_text, thousands

_BAR = 20


def _span(summary_span: str = "time_span") -> Column:
    return span_text(span_micros(F.col("earliest_ts"), F.col("latest_ts"))).alias(summary_span)


def _has(summary: DataFrame, name: str) -> bool:
    return name in summary.columns


# --- CSV -----------------------------------------------------------------------------------------


def csv_sections(summary: DataFrame) -> dict[str, DataFrame]:
    """One frame per section of the CSV export, each keyed by ``source_path``."""
    sections = {
        "metadata": summary.select(
            "source_path",
            "detected_format",
            "total_lines",
            "parsed_lines",
            "failed_lines",
            percent_text(F.col("parse_success_rate"), 2).alias("parse_success_rate"),
            percent_text(F.col("error_rate"), 2).alias("error_rate"),
            _span(),
        ),
        "severity": summary.select(
            "source_path", "parsed_lines", F.explode("level_counts").alias("level", "count")
        ).select(
            "source_path",
            "level",
            "count",
            F.format_string("%.2f", pct(F.col("count"), F.col("parsed_lines"))).alias("percentage"),
        ),
        "status": summary.select("source_path", F.explode("status_codes").alias("code", "count")),
        "top_errors": summary.select("source_path", F.posexplode("top_errors").alias("at", "item")).select(
            "source_path", (F.col("at") + 1).alias("position"), "item.count", "item.message"
        ),
        "top_sources": summary.select("source_path", F.posexplode("top_sources").alias("at", "item")).select(
            "source_path", (F.col("at") + 1).alias("position"), "item.source", F.col("item.count").alias("requests")
        ),
    }
    if _has(summary, "temporal"):
        sections["analytics"] = summary.select(
            "source_path",
            "trend_direction",
            F.coalesce(iso_text(F.col("peak_period")), F.lit("N/A")).alias("peak_period"),
        )
        sections["hourly"] = summary.select("source_path", F.inline("hourly")).select(
            "source_path", F.format_string("%02d:00", F.col("hour")).alias("hour"), F.col("n").alias("count")
        )
        sections["temporal"] = summary.select("source_path", F.inline("temporal")).select(
            "source_path", iso_text(F.col("bucket")).alias("timestamp"), F.col("n").alias("count")
        )
    return sections


def write_csv_sections(summary: DataFrame, path: str) -> None:
    for name, frame in csv_sections(summary).items():
        frame.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


# --- JSON ----------------------------------------------------------------------------------------


def summary_json(summary: DataFrame) -> DataFrame:
    """(source_path, json): one nested document per source."""
    parts = [
        F.struct(
            F.col("source_path").alias("filepath"),
            F.col("detected_format").alias("format"),
            "total_lines",
            "parsed_lines",
            "failed_lines",
            "parse_success_rate",
            "error_rate",
            _span(),
            iso_text(utc_wall_clock(F.col("earliest_ts"))).alias("earliest_timestamp"),
            iso_text(utc_wall_clock(F.col("latest_ts"))).alias("latest_timestamp"),
        ).alias("metadata"),
        F.col("level_counts").alias("severity"),
        "top_errors",
        "top_sources",
        F.when(F.size("status_codes") > 0, F.col("status_codes")).alias("status_codes"),
    ]
    if _has(summary, "temporal"):
        parts.append(
            F.struct(
                F.map_from_entries(
                    F.transform("temporal", lambda x: F.struct(iso_text(x["bucket"]), x["n"]))
                ).alias("temporal_distribution"),
                F.map_from_entries(
                    F.transform("hourly", lambda x: F.struct(x["hour"].cast("string"), x["n"]))
                ).alias("hourly_distribution"),
                "trend_direction",
                iso_text(F.col("peak_period")).alias("peak_period"),
            ).alias("analytics")
        )
    return summary.select("source_path", F.to_json(F.struct(*parts)).alias("json"))


def export_json(analyses: DataFrame, triages: DataFrame) -> DataFrame:
    """(id, json): stored analysis with its latest triage, as the detail page exports it."""
    from .store import latest_triage

    joined = latest_triage(analyses, triages)
    document = F.struct(
        "filename",
        "detected_format",
        iso_text(utc_wall_clock(F.col("created_at"))).alias("analyzed_at"),
        F.struct("total_lines", "parsed_lines", "failed_lines", "parse_success_rate", "error_rate").alias("statistics"),
        "level_counts",
        "top_errors",
        "top_sources",
        "status_codes",
        F.struct(
            iso_text(utc_wall_clock(F.col("earliest_ts"))).alias("earliest"),
            iso_text(utc_wall_clock(F.col("latest_ts"))).alias("latest"),
            F.col("time_span").alias("span"),
        ).alias("time_range"),
        "triage",
    )
    return joined.select("id", F.to_json(document).alias("json"))


# --- Markdown ------------------------------------------------------------------------------------


def _section(title: str, head: list[str], rows: Column, shown: Column) -> Column:
    """Title, table head and rows as text; null (skipped) when the section is not shown."""
    top = "\n".join([title, "", *head])
    return F.when(shown, F.concat(F.lit(top + "\n"), F.array_join(rows, "\n"), F.lit("\n")))


def _by_severity(entries: Column) -> Column:
    """Map entries of the five levels, most severe first."""
    known = F.filter(entries, lambda e: level_rank(e["key"]).isNotNull() & (e["value"] > 0))
    keyed = F.transform(known, lambda e: F.struct(-level_rank(e["key"]), e["key"].alias("key"), e["value"].alias("value")))
    return F.array_sort(keyed)


# Marks in front of levels and status categories.
LEVEL_MARKS = {"CRITICAL": "🔴", "ERROR": "🟠", "WARNING": "🟡", "INFO": "🟢", "DEBUG": "⚪"}
CATEGORY_MARKS = {"Success": "✅ ", "Redirect": "↪️ ", "Client Error": "⚠️ ", "Server Error": "❌ "}


def _mark(value: Column, marks: dict[str, str]) -> Column:
    chain = F.lit("")
    for key, mark in marks.items():
        chain = F.when(value == key, mark).otherwise(chain)
    return chain


def _lines_of(*parts: Column) -> Column:
    """Join the parts that are not null with line breaks."""
    return F.concat_ws("\n", *parts)


def markdown_reports(summary: DataFrame, generated_at: Column | None = None) -> DataFrame:
    """(source_path, text): one Markdown report per source."""
    stamp = F.date_format(F.current_timestamp() if generated_at is None else generated_at, "yyyy-MM-dd HH:mm:ss")
    head = F.format_string(
        "# Log Analysis Report\n\n**File:** `%s`  \n**Format:** %s  \n**Generated:** %s\n",
        base_name(F.col("source_path")),
        F.col("detected_format"),
        stamp,
    )

    def metric(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"| {name} | "), value, F.lit(" |"))

    overview = _lines_of(
        F.lit("## Overview\n\n| Metric | Value |\n|--------|-------|"),
        metric("Total Lines", thousands(F.col("total_lines"))),
        metric("Parsed Lines", thousands(F.col("parsed_lines"))),
        metric("Failed Lines", thousands(F.col("failed_lines"))),
        metric("Parse Success Rate", percent_text(F.col("parse_success_rate"))),
        metric("Error Rate", percent_text(F.col("error_rate"))),
        metric("First Entry", clock_text(F.col("earliest_ts"))),
        metric("Last Entry", clock_text(F.col("latest_ts"))),
        metric("Time Span", span_text(span_micros(F.col("earliest_ts"), F.col("latest_ts")))),
        F.lit(""),
    )
    parsed = F.col("parsed_lines")
    severity = _section(
        "## Severity Breakdown",
        ["| Level | Count | Percentage |", "|-------|-------|------------|"],
        F.transform(
            _by_severity(F.map_entries("level_counts")),
            lambda e: F.format_string(
                "| %s %s | %s | %s |",
                _mark(e["key"], LEVEL_MARKS),
                e["key"],
                thousands(e["value"]),
                percent_text(pct(e["value"], parsed)),
            ),
        ),
        F.size("level_counts") > 0,
    )
    codes = F.array_sort(
        F.transform(
            F.map_entries("status_codes"),
            lambda e: F.struct(e["key"].try_cast("bigint"), e["key"].alias("key"), e["value"].alias("value")),
        )
    )
    status = _section(
        "## HTTP Status Codes",
        ["| Code | Count | Category |", "|------|-------|----------|"],
        F.transform(
            codes,
            lambda e: F.format_string(
                "| %s | %s | %s%s |",
                e["key"],
                thousands(e["value"]),
                _mark(status_category(e["key"]), CATEGORY_MARKS),
                status_category(e["key"]),
            ),
        ),
        F.size("status_codes") > 0,
    )
    errors = _section(
        "## Top Error Messages",
        ["| Count | Message |", "|-------|---------|"],
        F.transform(
            "top_errors",
            lambda e: F.format_string(
                "| %d | %s |", e["count"], F.left(escape_text(e["message"], "markdown"), F.lit(80))
            ),
        ),
        F.size("top_errors") > 0,
    )
    sources = _section(
        "## Top Sources",
        ["| Source | Requests |", "|--------|----------|"],
        F.transform("top_sources", lambda e: F.format_string("| %s | %s |", e["source"], thousands(e["count"]))),
        F.size("top_sources") > 0,
    )
    analytics = _analytics_sections() if _has(summary, "temporal") else [F.lit(None).cast("string")]
    foot = F.lit("---\n*Generated by emberlog*")
    return summary.select(
        "source_path", _lines_of(head, overview, severity, status, errors, sources, *analytics, foot).alias("text")
    )


def _analytics_sections() -> list[Column]:
    hours = F.coalesce(F.size("hourly"), F.lit(0))
    title = F.format_string(
        "## 📈 Time-Series Analytics\n\n**Trend:** %s  \n**Peak Period:** %s  \n**Active Hours:** %d\n",
        F.col("trend_direction"),
        F.coalesce(iso_text(F.col("peak_period")), F.lit("N/A")),
        F.greatest(hours, F.lit(0)),
    )
    busiest = F.array_max(F.transform("hourly", lambda x: x["n"]))
    hourly = _section(
        "### Hourly Distribution",
        ["| Hour | Count | Activity |", "|------|-------|----------|"],
        F.transform(
            "hourly",
            lambda x: F.format_string(
                "| %02d:00 | %s | %s |",
                x["hour"],
                thousands(x["n"]),
                F.repeat(F.lit("█"), F.floor(x["n"] / busiest * _BAR).cast("int")),
            ),
        ),
        hours > 0,
    )
    buckets = F.coalesce(F.size("temporal"), F.lit(0))
    last_ten = F.slice(F.col("temporal"), F.greatest(buckets - 9, F.lit(1)), F.lit(10))
    recent = _section(
        "### Recent Activity",
        ["| Time Period | Count |", "|-------------|-------|"],
        F.transform(
            last_ten,
            lambda x: F.format_string(
                "| %s | %s |", F.date_format(x["bucket"], "yyyy-MM-dd HH:mm"), thousands(x["n"])
            ),
        ),
        buckets > 0,
    )
    return [title, hourly, recent]


def write_report(summary: DataFrame, path: str, fmt: str = "markdown") -> None:
    """Write reports of all sources. ``csv`` gives one dataset per section, ``json`` one document per
    line, ``markdown`` (also for unknown names) one Markdown text for each source, in a folder
    ``report=<base name>-<hash of the path>``. HTML is not offered."""
    if fmt == "html":
        raise ValueError("HTML reports are not offered; the frames in operators.tables hold their data")
    if fmt == "csv":
        write_csv_sections(summary, path)
    elif fmt == "json":
        summary_json(summary).select("json").write.mode("overwrite").text(path)
    else:
        name = F.concat_ws("-", base_name(F.col("source_path")), F.lower(F.hex(F.xxhash64("source_path"))))
        texts = markdown_reports(summary).select(name.alias("report"), F.col("text").alias("value"))
        texts.repartition("report").write.mode("overwrite").partitionBy("report").text(path)
