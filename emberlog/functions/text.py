"""String helpers and the one-pass regex capture."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters str.strip() removes in Python.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A code point that is never a character; marks group borders inside a captured line.
_BORDER = "\uffff"
_REPLACEMENT = "\ufffd"


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any Unicode kind."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """Only whitespace. Trimming the left side stops at the first other character."""
    return F.ltrim(text, F.lit(WHITESPACE)) == F.lit("")


def ellipsize(text: Column, n: int) -> Column:
    """First ``n`` characters plus ``...`` when the text is longer."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def escape_text(text: Column, mode: str) -> Column:
    """Make a value safe inside a Markdown table cell or an HTML table cell."""
    if mode == "markdown":
        return F.replace(text, F.lit("|"), F.lit("\\|"))
    if mode == "html":
        return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    raise ValueError(f"unknown escape mode: {mode}")


def request_id(text: Column) -> Column:
    """First lower-case hex UUID in the text, null when there is none."""
    pattern = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    return F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))


def category_title(text: Column) -> Column:
    """``error_spike`` -> ``Error Spike``; null becomes an empty string."""
    return F.coalesce(F.initcap(F.replace(text, F.lit("_"), F.lit(" "))), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def as_array(text: Column) -> Column:
    """A JSON array of strings as an array, any other text as a one-element array."""
    listed = F.from_json(text, "array<string>")
    return (
        F.when(text.isNull(), F.array().cast("array<string>"))
        .when(strip(text).startswith("["), F.coalesce(listed, F.array(text)))
        .otherwise(F.array(text))
    )


@dataclass(frozen=True)
class Shape:
    """One line layout: a regex whose capture groups carry ``names`` in order."""

    tag: str
    regex: str
    names: tuple[str, ...]


def _without_borders(text: Column) -> Column:
    return F.replace(text, F.lit(_BORDER), F.lit(_REPLACEMENT))


def fits(text: Column, shapes: tuple[Shape, ...]) -> Column:
    """Whether :func:`capture` finds a shape; nothing is captured or rewritten."""
    clean = _without_borders(text)
    found = reduce(lambda a, b: a | b, [clean.rlike(f"(?Ud)^(?:{shape.regex})") for shape in shapes])
    return F.coalesce(found, F.lit(False))


def capture(text: Column, shapes: tuple[Shape, ...]) -> Column:
    """All groups of the first matching shape from one regex pass per shape.

    Result: ``['', tag, group 1, ..., group n, rest]`` on a match, a one-element array otherwise.
    A group that took no part gives ``''``. Reading every group from one replacement costs one
    regex run per line, where one ``regexp_extract`` per field would cost one run per field.
    Later shapes skip a line that an earlier shape already rewrote.
    """
    result = _without_borders(text)
    for position, shape in enumerate(shapes):
        unseen = f"(?!{_BORDER})" if position else ""
        groups = _BORDER.join(f"${i}" for i in range(1, len(shape.names) + 1))
        result = F.regexp_replace(
            result,
            F.lit(f"(?Ud)^{unseen}(?:{shape.regex})"),
            F.lit(f"{_BORDER}{shape.tag}{_BORDER}{groups}{_BORDER}"),
        )
    return F.split(result, _BORDER)
