"""Text contexts for incident triage, and triage responses back into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import level_rank
from ..functions.privacy import MAX_LENGTH, cap_length, redact_pii, wrap_markers
from ..functions.rates import pct
from ..functions.text import ellipsize, strip
from ..functions.times import iso_text, span_text, utc_wall_clock
from ..functions.variants import has, is_object, is_string, member, parse_json, text_at, text_of
from ..schema import ISSUE, OTHER_KEYS
from .counts import span_micros
from .tables import percent_text, thousands

# Severities of a triage result.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "HEALTHY")


def _bullets(items: Column, empty: str) -> Column:
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, "\n")).otherwise(empty)


def _ranked(pairs: Column, key: str, value: str, k: int) -> Column:
    """The ``k`` entries with the largest value; earlier entries win ties."""
    keyed = F.transform(
        pairs, lambda e, i: F.struct((-e[value]).alias("rank"), i.alias("at"), e[key].alias("key"), e[value].alias("n"))
    )
    return F.slice(F.array_sort(keyed), 1, k)


def _sample_lines(column: str) -> Column:
    def line(e: Column) -> Column:
        when = F.coalesce(F.date_format(e["event_ts_local"], "yyyy-MM-dd HH:mm:ss"), F.lit("---"))
        origin = F.when(F.coalesce(e["source"], F.lit("")) != "", F.concat(F.lit(" ("), e["source"], F.lit(")"))).otherwise("")
        return F.concat(F.lit("["), when, F.lit("] "), e["level"], origin, F.lit(": "), ellipsize(e["message"], 200))

    return F.transform(F.slice(column, 1, 5), line)


def _message_counts(column: str) -> Column:
    """Messages of the first 50 samples, cut to 100 characters, with their count, top ten."""
    cut = F.transform(F.slice(column, 1, 50), lambda e: F.left(e["message"], F.lit(100)))
    counted = F.transform(
        F.array_distinct(cut),
        lambda m: F.struct(m.alias("message"), F.size(F.filter(cut, lambda x: x == m)).alias("count")),
    )
    return _ranked(counted, "message", "count", 10)


def triage_context(summary: DataFrame, analytics: DataFrame | None = None) -> DataFrame:
    """(source_path, context): the facts of one source as text, ready for a reader or a model.

    ``analytics`` is (source_path, temporal, hourly); without it the temporal part says so.
    """
    frame = summary
    if analytics is not None:
        extra = analytics.select("source_path", "temporal", "hourly")
        frame = summary.drop("temporal", "hourly").join(extra, "source_path", "left")
    has_analytics = "temporal" in frame.columns
    parsed = F.col("parsed_lines")
    known = F.filter(F.map_entries("level_counts"), lambda e: level_rank(e["key"]).isNotNull() & (e["value"] > 0))
    severity = F.transform(
        F.array_sort(
            F.transform(known, lambda e: F.struct(-level_rank(e["key"]), e["key"].alias("key"), e["value"].alias("n")))
        ),
        lambda e: F.format_string("- %s: %s (%s)", e["key"], thousands(e["n"]), percent_text(pct(e["n"], parsed))),
    )
    errors = F.transform(
        "top_errors", lambda e: F.format_string("- [%dx] %s", e["count"], ellipsize(e["message"], 100))
    )
    warnings = F.transform(_message_counts("warnings"), lambda e: F.format_string("- [%dx] %s", e["n"], e["key"]))
    sources = F.transform(
        "top_sources", lambda e: F.format_string("- %s: %s entries", e["source"], thousands(e["count"]))
    )
    by_code = F.array_sort(F.filter(F.map_entries("status_codes"), lambda e: e["key"] != OTHER_KEYS))
    status = F.transform(
        _ranked(by_code, "key", "value", 10),
        lambda e: F.format_string(
            "- %s HTTP %s: %s", F.when(e["key"].rlike("^[45]"), "⚠️").otherwise("✓"), e["key"], thousands(e["n"])
        ),
    )
    if has_analytics:
        buckets = F.transform(
            _ranked(F.col("temporal"), "bucket", "n", 5),
            lambda e: F.format_string("- %s: %s entries", iso_text(e["key"]), thousands(e["n"])),
        )
        hours = F.transform(
            _ranked(F.col("hourly"), "hour", "n", 3),
            lambda e: F.format_string("- Peak hour %d:00: %s entries", e["key"], thousands(e["n"])),
        )
        none = F.array().cast("array<string>")
        temporal = F.concat(F.coalesce(buckets, none), F.coalesce(hours, none))
    else:
        temporal = F.array().cast("array<string>")
    span = span_text(span_micros(F.col("earliest_ts"), F.col("latest_ts")))
    both_ends = F.concat(
        utc_wall_clock(F.col("earliest_ts")).cast("string"), F.lit(" to "), utc_wall_clock(F.col("latest_ts")).cast("string")
    )
    parts = [
        F.concat(
            F.lit("## Log File Information\n- **File**: "),
            F.col("source_path"),
            F.lit("\n- **Format**: "),
            F.coalesce(F.col("detected_format"), F.lit("unknown")),
            F.lit("\n- **Total Lines**: "),
            thousands(F.col("total_lines")),
            F.lit("\n- **Parsed Lines**: "),
            thousands(parsed),
            F.lit("\n- **Time Range**: "),
            F.coalesce(span, both_ends, F.lit("Unknown")),
        ),
        _titled("## Severity Breakdown", _bullets(severity, "- No severity levels detected")),
        _titled(
            F.format_string("## Top Errors (%d total)", F.size("errors")), _bullets(errors, "- No errors detected")
        ),
        _titled(
            F.format_string("## Top Warnings (%d total)", F.size("warnings")),
            _bullets(warnings, "- No warnings detected"),
        ),
        _titled("## Error Sources (components generating errors)", _bullets(sources, "- No source data available")),
        _titled("## HTTP Status Codes", _bullets(status, "- No HTTP status code data")),
        _titled("## Temporal Patterns", _bullets(temporal, "- No temporal data available")),
        _titled("## Sample Error Entries", _bullets(_sample_lines("errors"), "No error samples available")),
        _titled("## Sample Warning Entries", _bullets(_sample_lines("warnings"), "No warning samples available")),
    ]
    return frame.select("source_path", F.concat_ws("\n\n", *parts).alias("context"))


def _titled(title: str | Column, body: Column) -> Column:
    return F.concat(F.lit(title) if isinstance(title, str) else title, F.lit("\n"), body)


def redact(df: DataFrame, column: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """Redact, then cap, then frame, in that order. A null or empty text gives an empty text."""
    cleaned = wrap_markers(cap_length(redact_pii(F.coalesce(F.col(column), F.lit(""))), max_length))
    return df.withColumn(column, cleaned)


def sanitize_context(contexts: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    return redact(contexts, "context", max_length)


def _json_part(content: Column) -> Column:
    """Body of the first fenced block if any, then first ``{`` to last ``}`` if any."""
    text = strip(content)
    fence = r"```(?:json)?\s*([\s\S]*?)\s*```"
    body = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    braces = r"\{[\s\S]*\}"
    return F.when(body.rlike(braces), F.regexp_extract(body, braces, 0)).otherwise(body)


def _severity(value: Column) -> Column:
    word = F.upper(F.coalesce(text_of(value), F.lit("MEDIUM")))
    return F.when(word.isin(*SEVERITIES), word).otherwise("MEDIUM")


def _texts(value: Column) -> Column:
    """Array of texts; a single text becomes a one-element array."""
    alone = F.when(is_string(value), F.array(text_of(value)))
    return F.coalesce(F.try_variant_get(value, "$", "array<string>"), alone, F.array().cast("array<string>"))


def _issue(item: Column) -> Column:
    def text(key: str, default: str) -> Column:
        return F.coalesce(text_at(item, f"$.{key}"), F.lit(default))

    actions = member(item, "git_actions")
    return F.struct(
        text("title", "Unknown Issue").alias("title"),
        _severity(member(item, "severity")).alias("severity"),
        F.when(has(item, "confidence"), text_at(item, "$.confidence").try_cast("double")).otherwise(0.5).alias("confidence"),
        text("description", "").alias("description"),
        _texts(member(item, "affected_components")).alias("affected_components"),
        _texts(member(item, "sample_logs")).alias("sample_logs"),
        text("recommendation", "").alias("recommendation"),
        F.when(is_object(actions), F.to_json(actions)).alias("git_actions"),
        text("root_cause_analysis", "").alias("root_cause_analysis"),
        text("category", "unknown").alias("category"),
        _texts(member(item, "evidence")).alias("evidence"),
    )


def parse_responses(responses: DataFrame) -> DataFrame:
    """(id, content, ...) -> triage results: summary, overall_severity, confidence, issues, raw_analysis.

    Text that holds no JSON object gives severity MEDIUM, confidence 0.3 and no issues. An issue whose
    confidence is not a number within 0..1 is dropped. Other input columns are kept.
    """
    read = responses.withColumn("_part", _json_part(F.col("content"))).withColumn("_doc", parse_json(F.col("_part")))
    ok = is_object(F.col("_doc"))
    items = F.try_variant_get(F.col("_doc"), "$.issues", "array<variant>")
    issues = F.filter(F.transform(items, _issue), lambda i: i["confidence"].between(0.0, 1.0))
    confidence = F.when(
        has(F.col("_doc"), "confidence"), text_at(F.col("_doc"), "$.confidence").try_cast("double")
    ).otherwise(0.5)
    kept = [c for c in responses.columns if c != "content"]
    return read.select(
        *kept,
        F.when(ok, F.coalesce(text_at(F.col("_doc"), "$.summary"), F.lit("Analysis completed")))
        .otherwise("AI analysis completed but response parsing failed")
        .alias("summary"),
        F.when(ok, _severity(member(F.col("_doc"), "overall_severity"))).otherwise("MEDIUM").alias("overall_severity"),
        F.when(ok, confidence).otherwise(0.3).alias("confidence"),
        F.coalesce(F.when(ok, issues), F.array()).cast(f"array<{ISSUE.simpleString()}>").alias("issues"),
        F.col("content").alias("raw_analysis"),
    )


def explode_issues(triages: DataFrame) -> DataFrame:
    """One row per issue, with the triage id and the place in its list."""
    placed = triages.select("id", F.posexplode("issues").alias("at", "issue"))
    return placed.select("id", (F.col("at") + 1).alias("position"), "issue.*")
