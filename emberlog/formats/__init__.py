"""Format registry: 22 named formats, one fallback, and the seam for custom ones."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fits
from ..functions.times import stamp_instant, stamp_wall_clock
from ..functions.variants import opens_with, read_marked, whole_value
from ..schema import FALLBACK_FORMAT
from . import cloud, container, structured, system, universal, web
from .base import Line, LogFormat, pick_stamp
from .structured import json_format  # noqa: F401

_BUILT_IN = (
    *cloud.FORMATS,
    *container.FORMATS,
    *web.EARLY,
    *structured.FORMATS,
    *system.FORMATS,
    *web.LATE,
)


class FormatRegistry:
    """Ordered set of formats. A lower priority number wins ties in detection."""

    def __init__(self, formats: tuple[LogFormat, ...] = _BUILT_IN):
        self._formats = {f.name: replace(f, priority=i) for i, f in enumerate(formats)}
        self._fallback = replace(universal.UNIVERSAL, priority=10_000)

    def register(self, fmt: LogFormat, priority: int | None = None) -> LogFormat:
        rank = len(self._formats) if priority is None else priority
        placed = replace(fmt, priority=rank)
        self._formats[fmt.name] = placed
        return placed

    def get(self, name: str) -> LogFormat:
        if name == FALLBACK_FORMAT:
            return self._fallback
        if name not in self._formats:
            raise ValueError(f"unknown format: {name}")
        return self._formats[name]

    def detectable(self) -> list[LogFormat]:
        return sorted(self._formats.values(), key=lambda f: f.priority)

    def all(self) -> list[LogFormat]:
        return [*self.detectable(), self._fallback]


DEFAULT_REGISTRY = FormatRegistry()


def register_format(
    name: str,
    match: Column | Callable[[Column], Column],
    fields: dict[str, Column] | Callable[[Column], dict[str, Column]],
    priority: int | None = None,
    description: str = "custom format",
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> LogFormat:
    """Add a format made of column expressions over the column ``raw``.

    ``fields`` needs ``level`` and ``message``; it may add ``source``, ``status``, ``metadata`` and ``stamp``,
    a timestamp text that ends in an offset such as ``+00:00``, or ``@`` and epoch microseconds.
    The format takes part in detection and parsing like a built-in one.
    """
    def found(line: Line) -> dict[str, Column]:
        return fields(line.raw) if callable(fields) else fields

    fmt = LogFormat(
        name=name,
        description=description,
        parsed=lambda line: match(line.raw) if callable(match) else match,
        fields=found,
        stamps=lambda line: [found(line)["stamp"]] if "stamp" in found(line) else [],
    )
    return registry.register(fmt, priority)


def matches(name: str, raw: Column, registry: FormatRegistry = DEFAULT_REGISTRY, **pieces: Column) -> Column:
    """TRUE where a line counts as this format. ``pieces`` are stored columns, see :func:`with_pieces`."""
    fmt = registry.get(name)
    return fmt.matches(Line(fmt, raw, **pieces))


def with_pieces(name: str, lines: DataFrame, registry: FormatRegistry = DEFAULT_REGISTRY) -> tuple[DataFrame, dict[str, Column]]:
    """LINES with what a format looks at (text, groups, JSON value, cells) and these columns for :func:`matches`.

    As columns of earlier steps they are computed once per line, and only if the match needs them; a plain expression
    repeats them wherever it refers to them.
    """
    fmt, raw = registry.get(name), F.col("raw")
    pieces: dict[str, Column] = {}

    def store(frame: DataFrame, made: dict[str, Column]) -> DataFrame:
        pieces.update({piece: F.col(f"_{piece}") for piece in made})
        return frame.withColumns({f"_{piece}": value for piece, value in made.items()})

    if fmt.trims:
        lines = store(lines, {"text": fmt.text_of(raw)})
    text = Line(fmt, raw, **pieces).text
    if fmt.shapes:
        lines = store(lines, {"groups": fmt.groups_of(text), "matched": fits(text, fmt.shapes)})
    if fmt.openers:
        lines = lines.withColumn("_read", F.when(opens_with(text, fmt.openers), read_marked(text)))
        lines = store(lines, {"doc": whole_value(F.col("_read"))})
    cells = {f"cell_{i}": cell for i, cell in enumerate(fmt.cells_of(Line(fmt, raw, **pieces)))}
    return (store(lines, cells) if cells else lines), pieces


def fields(name: str, raw: Column, registry: FormatRegistry = DEFAULT_REGISTRY) -> dict[str, Column]:
    """The entry fields of a line read as this format, as plain expressions of the line."""
    fmt = registry.get(name)
    line = Line(fmt, raw)
    stamp = pick_stamp(fmt.stamps_of(line))
    return {
        "event_ts": stamp_instant(stamp),
        "event_ts_local": stamp_wall_clock(stamp),
        **fmt.columns(line),
    }


def parse(name: str, lines: DataFrame, registry: FormatRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """LINES -> ENTRIES of one format; lines that do not parse are left out."""
    from ..operators.entries import parse_entries

    return parse_entries(lines, fmt=name, keep_failed=False, registry=registry)


# parse_<fmt>(lines), matches_<fmt>(raw) and fields_<fmt>(raw) of every built-in format.
for _fmt in DEFAULT_REGISTRY.all():
    globals()[f"parse_{_fmt.name}"] = partial(parse, _fmt.name)
    globals()[f"matches_{_fmt.name}"] = partial(matches, _fmt.name)
    globals()[f"fields_{_fmt.name}"] = partial(fields, _fmt.name)

__all__ = [
    "DEFAULT_REGISTRY",
    "FormatRegistry",
    "Line",
    "LogFormat",
    "fields",
    "json_format",
    "matches",
    "parse",
    "register_format",
    "with_pieces",
]
