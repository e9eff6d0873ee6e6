"""Heuristic fallback for lines of no known format."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.levels import infer_level, map_level
from ..functions.text import Shape, is_blank, strip
from .base import Line, LogFormat, text_map

# Timestamp layouts searched in this order.
TIMESTAMP_SHAPES = (
    ("iso", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"),
    ("clf", r"\d{2}/\w{3}/\d{4}:\d{2}:\d{2}:\d{2}"),
    ("us_date", r"\d{2}/\d{2}/\d{4}\s+\d{2}:\d{2}:\d{2}"),
    ("syslog", r"\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"),
    ("epoch", r"\b\d{10}\b"),
    ("short", r"\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"),
)
_LEVEL_WORD = r"(?iU)\b(FATAL|CRITICAL|CRIT|ERROR|ERR|WARNING|WARN|INFO|DEBUG|DBG|TRACE|NOTICE)\b"


def _without_lead(text: Column, marks: tuple[str, ...]) -> Column:
    """Drop one leading mark and the whitespace behind it."""
    marked = F.left(text, F.lit(1)).isin(*marks)
    return F.when(marked, strip(F.substring(text, F.lit(2), F.length(text)))).otherwise(text)


def _found(line: Line) -> dict[str, Column]:
    return {
        "tail": strip(line.group("rest")),
        "word": F.upper(F.regexp_extract(line.raw, _LEVEL_WORD, 1)),
    }


def _body(line: Line) -> dict[str, Column]:
    """Text behind the timestamp, or the whole line."""
    body = F.when(line.matched, _without_lead(line.word("tail"), ("-", ":"))).otherwise(line.raw)
    return {"body": body, "folded": F.when(line.word("word") == "", F.lower(line.raw))}


def _cut(line: Line) -> dict[str, Column]:
    """Text behind a leading level word, null when the text does not start with one."""
    word, body = line.word("word"), line.word("body")
    leads = (word != "") & F.upper(body).startswith(word)
    return {"cut": F.when(leads, strip(F.substring(body, F.length(word) + 1, F.length(body))))}


def _message(line: Line) -> dict[str, Column]:
    return {"message": F.coalesce(_without_lead(line.word("cut"), ("-", ":", "|")), line.word("body"))}


def _fields(line: Line) -> dict[str, Column]:
    word = line.word("word")
    return {
        "level": F.when(word != "", map_level(word, "universal", "INFO")).otherwise(
            infer_level(line.word("folded"), "universal", folded=True)
        ),
        "message": F.when(line.word("message") == "", line.raw).otherwise(line.word("message")),
        "metadata": text_map(
            parser_type="fallback",
            timestamp_raw=line.group("ts"),
            timestamp_format=line.tag,
        ),
    }


UNIVERSAL = LogFormat(
    name="universal",
    description="Universal fallback parser for unknown formats",
    shapes=tuple(Shape(kind, rf".*?({pattern})(.*)$", ("ts", "rest")) for kind, pattern in TIMESTAMP_SHAPES),
    steps=(_found, _body, _cut, _message),
    parsed=lambda x: ~is_blank(x.raw),
    fields=_fields,
)
