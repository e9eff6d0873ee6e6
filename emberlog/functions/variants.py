"""Reading parsed JSON values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: stands after the text in a list of two, and shows where the reader stopped.
_END = "\u241e end of the value \u241e"


def parse_json(text: Column) -> Column:
    """JSON text -> VARIANT, null when it is not exactly one JSON value.

    The variant reader stops after the first value and ignores what follows. The text is therefore read once as
    the first element of a list whose second element is a fixed end mark: after one whole value the mark must come
    second, whatever closing brackets the text has left over.
    """
    return F.element_at(F.transform(F.array(read_marked(text)), whole_value), 1)


def read_marked(text: Column) -> Column:
    """The first step of :func:`parse_json`: a list of the first value and what follows it."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))


def whole_value(read: Column) -> Column:
    """The second step: the value, when the end mark follows it."""
    ended = F.coalesce(F.try_variant_get(read, "$[1]", "string") == _END, F.lit(False))
    return F.when(ended, F.try_variant_get(read, "$[0]", "variant"))


def opens_with(text: Column, openers: str) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(o) for o in openers])


def parse_object(text: Column, openers: str = "{") -> Column:
    """As :func:`parse_json`, for trimmed text that opens with one of ``openers``."""
    return F.when(opens_with(text, openers), parse_json(text))


def member(doc: Column, key: str) -> Column:
    """Value under a top-level key. JSON null is a value; a missing key gives SQL null."""
    return F.try_variant_get(doc, f'$["{key}"]', "variant")


def has(doc: Column, key: str) -> Column:
    return member(doc, key).isNotNull()


def text_at(doc: Column, path: str) -> Column:
    """Value at a path as text; objects and arrays as JSON text; JSON null as SQL null."""
    return F.try_variant_get(doc, path, "string")


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def printed(value: Column) -> Column:
    """Text form with ``None``, ``True`` and ``False`` spelled as Python prints them."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(kind == "VOID", "None")
        .when(kind == "BOOLEAN", F.initcap(text_of(value)))
        .otherwise(text_of(value))
    )


def first_present(doc: Column, names: list[str]) -> Column:
    """Value of the first key that exists, even if it is JSON null."""
    return F.coalesce(*[member(doc, name) for name in names])


def truthy_text(value: Column) -> Column:
    """Text of a value that counts as set: null, false, zero and empty give null."""
    text = text_of(value)
    empty = F.when(is_string(value), text == "").otherwise(text.isin("0", "false", "[]", "{}"))
    return F.when(~empty, text)
