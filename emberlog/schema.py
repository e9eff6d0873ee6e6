"""Shared column contracts.

LINES    source_path STRING, block_start BIGINT, line_id BIGINT, raw STRING
ENTRIES  LINES + format STRING, parsed BOOLEAN, event_ts TIMESTAMP, event_ts_local TIMESTAMP_NTZ,
         level STRING, message STRING, source STRING, status STRING, metadata MAP<STRING,STRING>

``line_id`` is the position of a line in its source: unique and increasing in file order, so
"first", "last" and every tie rule is an ORDER BY on (source_path, line_id).
``event_ts`` is the instant (ordering, span); ``event_ts_local`` is the wall clock as written
(buckets and hours).
"""

from __future__ import annotations

from pyspark.sql import types as T

LINES = T.StructType(
    [
        T.StructField("source_path", T.StringType()),
        T.StructField("block_start", T.LongType()),
        T.StructField("line_id", T.LongType()),
        T.StructField("raw", T.StringType()),
    ]
)

ENTRY_FIELDS = ("event_ts", "event_ts_local", "level", "message", "source", "status", "metadata")

ENTRIES = T.StructType(
    LINES.fields
    + [
        T.StructField("format", T.StringType()),
        T.StructField("parsed", T.BooleanType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event_ts_local", T.TimestampNTZType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

ISSUE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("affected_components", T.ArrayType(T.StringType())),
        T.StructField("sample_logs", T.ArrayType(T.StringType())),
        T.StructField("recommendation", T.StringType()),
        T.StructField("git_actions", T.StringType()),
        T.StructField("root_cause_analysis", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)

# Severity order, low to high.
LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")

# Defaults and limits.
DETECT_SAMPLE = 100
DEFAULT_SAMPLES = 50
MAX_SAMPLES = 1000
TOP_K = 10
FALLBACK_FORMAT = "universal"

#: Most keys of a map in a summary row; the counts of further keys are added up under OTHER_KEYS.
MAP_KEYS = 1000
OTHER_KEYS = "(other)"
