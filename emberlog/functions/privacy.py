"""Clean-up of text before it leaves the platform."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (pattern, replacement), applied in this order.
PII_PATTERNS = (
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "[EMAIL_REDACTED]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP_REDACTED]"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b", "[IP_REDACTED]"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b", "[IP_REDACTED]"),
    (r"\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", "[IP_REDACTED]"),
)

# Phrases that mark an attempt to steer a reader of the text.
STEERING_PHRASES = (
    "ignore previous instructions",
    "disregard all prior",
    "forget everything",
    "new instructions:",
    "system prompt:",
)

MAX_LENGTH = 50_000
CHARS_PER_TOKEN = 4


def redact_pii(text: Column) -> Column:
    for pattern, replacement in PII_PATTERNS:
        text = F.regexp_replace(text, F.lit(f"(?U){pattern}"), F.lit(replacement))
    return text


def cap_length(text: Column, n: int = MAX_LENGTH) -> Column:
    """First ``n`` characters with a notice of how many were left out."""
    over = F.length(text) - n
    notice = F.format_string("\n\n[... truncated, %d more characters ...]", over)
    return F.when(over > 0, F.concat(F.left(text, F.lit(n)), notice)).otherwise(text)


def wrap_markers(text: Column) -> Column:
    """Frame the whole text as data when it holds a steering phrase."""
    lowered = F.lower(text)
    found = lowered.contains(STEERING_PHRASES[0])
    for phrase in STEERING_PHRASES[1:]:
        found = found | lowered.contains(phrase)
    return F.when(found, F.concat(F.lit("[LOG DATA START]\n"), text, F.lit("\n[LOG DATA END]"))).otherwise(text)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / CHARS_PER_TOKEN).cast("bigint")
