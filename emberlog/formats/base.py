"""What a log format is: lazy column expressions over one line, in steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import Shape, capture, strip
from ..functions.times import stamp_instant
from ..functions.variants import parse_object


class Line:
    """The pieces of one line that a format's expressions refer to.

    ``raw`` the line, ``text`` the line as the format looks at it, ``groups`` captured groups, ``doc`` the
    line as VARIANT, ``cells`` some VARIANT values in it, and named words: texts that several fields use. Where no
    group is needed, ``matched`` may be a column of its own.
    A piece is either a stored column of an earlier step or the expression itself.
    """

    def __init__(self, fmt: LogFormat, raw: Column, **pieces: Column):
        self._fmt = fmt
        self.raw = raw
        self.text = pieces.get("text", fmt.text_of(raw))
        self.groups = pieces.get("groups", fmt.groups_of(self.text))
        self.doc = pieces.get("doc", fmt.doc_of(self.text))
        self._matched = pieces.get("matched")
        self._words: dict[str, Column] = {}
        self._cells = [pieces.get(f"cell_{i}", cell) for i, cell in enumerate(fmt.cells_of(self))]
        for step in fmt.steps:
            self._words.update({name: pieces.get(f"word_{name}", word) for name, word in step(self).items()})

    @property
    def tag(self) -> Column:
        """Tag of the shape that matched, null when none did."""
        return F.get(self.groups, F.lit(1))

    @property
    def matched(self) -> Column:
        return self.tag.isNotNull() if self._matched is None else self._matched

    def group(self, name: str) -> Column:
        """Captured text; null when no shape with this group matched."""
        shapes = self._fmt.shapes
        spots = {s.tag: s.names.index(name) + 2 for s in shapes if name in s.names}
        if len(spots) == len(shapes) and len(set(spots.values())) == 1:
            return F.get(self.groups, F.lit(next(iter(spots.values()))))
        chain = None
        for tag, spot in spots.items():
            value = F.get(self.groups, F.lit(spot))
            chain = F.when(self.tag == tag, value) if chain is None else chain.when(self.tag == tag, value)
        return chain

    def optional(self, name: str) -> Column:
        """Captured text of an optional group; null when it is empty."""
        return F.nullif(self.group(name), F.lit(""))

    def cell(self, position: int) -> Column:
        return self._cells[position]

    def word(self, name: str) -> Column:
        return self._words[name]


@dataclass(frozen=True)
class LogFormat:
    """A format is a set of lazy column expressions.

    ``parsed``   the line yields an entry
    ``fields``   level, message and, where known, source, status, metadata
    ``accepts``  the look at a line that lets detection count it, when it is stricter than ``parsed``
    ``stamps``   candidate timestamps as stamp texts; the first real date wins
    ``shapes``   line layouts, ``openers`` first characters of JSON lines, ``strips`` trims the line first
    ``cells``    JSON values that several expressions use, ``steps`` the same for texts, in order
    """

    name: str
    description: str
    parsed: Callable[[Line], Column]
    fields: Callable[[Line], dict[str, Column]]
    accepts: Callable[[Line], Column] | None = None
    stamps: Callable[[Line], list[Column]] | None = None
    shapes: tuple[Shape, ...] = ()
    strips: bool = False
    openers: str = ""
    cells: Callable[[Line], list[Column]] | None = None
    steps: tuple[Callable[[Line], dict[str, Column]], ...] = ()
    priority: int = 0

    @property
    def trims(self) -> bool:
        return self.strips or bool(self.openers)

    def text_of(self, raw: Column) -> Column:
        return strip(raw) if self.trims else raw

    def groups_of(self, text: Column) -> Column:
        return capture(text, self.shapes) if self.shapes else F.lit(None).cast("array<string>")

    def doc_of(self, text: Column) -> Column:
        return parse_object(text, self.openers) if self.openers else F.lit(None).cast("variant")

    def cells_of(self, line: Line) -> list[Column]:
        return self.cells(line) if self.cells else []

    def words_of(self, line: Line, step: int) -> dict[str, Column]:
        return self.steps[step](line) if step < len(self.steps) else {}

    def matches(self, line: Line) -> Column:
        """Counts for detection: accepted and parsed."""
        parsed = F.coalesce(self.parsed(line), F.lit(False))
        if self.accepts is None:
            return parsed
        return F.coalesce(self.accepts(line), F.lit(False)) & parsed

    def columns(self, line: Line) -> dict[str, Column]:
        """Entry fields other than the timestamps, with their final types; missing ones are null."""
        found = self.fields(line)
        no_text = F.lit(None).cast("string")
        return {
            "level": found["level"].cast("string"),
            "message": found["message"].cast("string"),
            "source": found.get("source", no_text).cast("string"),
            "status": found.get("status", no_text).cast("string"),
            "metadata": found.get("metadata", F.create_map().cast("map<string,string>")),
        }

    def stamps_of(self, line: Line) -> list[Column]:
        return [stamp.cast("string") for stamp in self.stamps(line)] if self.stamps else []


def pick_stamp(stamps: list[Column]) -> Column:
    """First candidate that is a real timestamp."""
    if not stamps:
        return F.lit(None).cast("string")
    if len(stamps) == 1:
        return stamps[0]
    return F.coalesce(*[F.when(stamp_instant(stamp).isNotNull(), stamp) for stamp in stamps])


def text_map(**values: Column | str) -> Column:
    """MAP<STRING,STRING> from keyword values; plain strings are literals."""
    parts: list[Column] = []
    for key, value in values.items():
        parts += [F.lit(key), F.lit(value) if isinstance(value, str) else value.cast("string")]
    return F.create_map(*parts)
