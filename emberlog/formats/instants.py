"""Instants for formats that carry a full date in a spelling which their plain form leaves unread; opt-in."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.times import MONTH_PATTERN, epoch_stamp, month_number, stamp_text
from . import FormatRegistry
from .base import Line

#: Two-digit years from this one on are of the 20th century, as POSIX has it.
PIVOT = 69
_MOST_SECONDS = 253402300799  # 9999-12-31T23:59:59Z


def full_year(two_digits: Column, pivot: int = PIVOT) -> Column:
    """``98`` -> ``1998``, ``05`` -> ``2005``; null for what is not two digits."""
    century = F.when(two_digits.try_cast("int") >= pivot, "19").otherwise("20")
    return F.when(two_digits.rlike(r"^[0-9]{2}$"), F.concat(century, two_digits))


def epoch_seconds(text: Column) -> Column:
    """Stamp text of whole seconds since 1970; null beyond the year 9999."""
    seconds = F.when(text.rlike("^[0-9]{1,12}$"), text.try_cast("bigint"))
    return F.when(seconds <= _MOST_SECONDS, epoch_stamp(seconds * 1_000_000))


def weekday_date(text: Column) -> Column:
    """Stamp text of ``Sun Dec 04 04:47:44[.fraction] 2005``. The weekday may be missing and is not checked."""
    shape = rf"^(?:[A-Za-z]{{3}}\s+)?({MONTH_PATTERN})\s+(\d{{1,2}})\s+(\d{{1,2}}:\d{{2}}:\d{{2}}(?:\.\d{{1,6}})?)\d*\s+(\d{{4}})$"
    text = strip(text)
    part = lambda i: F.regexp_extract(text, shape, i)
    day = F.concat_ws("-", part(4), F.lpad(month_number(part(1)), 2, "0"), F.lpad(part(2), 2, "0"))
    clock = F.when(F.position(F.lit(":"), part(3)) == 2, F.concat(F.lit("0"), part(3))).otherwise(part(3))
    return F.when(text.rlike(shape), stamp_text(F.concat_ws(" ", day, clock)))


def _apache_error(line: Line) -> list[Column]:
    return [weekday_date(line.group("ts"))]


def _java_log(line: Line) -> list[Column]:
    text = F.regexp_replace(line.group("ts"), r"\s+", " ")
    short = F.concat(full_year(F.substring(text, 1, 2)), F.lit("-"), F.replace(F.substring(text, 4, 5), F.lit("/"), F.lit("-")))
    short = F.concat(short, F.lit(" "), F.substring(text, 10, 8))
    return [stamp_text(F.when(line.tag == "full", F.replace(text, F.lit(","), F.lit("."))).otherwise(short))]


def _hdfs(line: Line) -> list[Column]:
    date, clock = line.group("date"), line.group("clock")
    two = lambda text, at: F.substring(text, at, 2)
    day = F.concat(full_year(two(date, 1)), F.lit("-"), two(date, 3), F.lit("-"), two(date, 5))
    time = F.concat_ws(":", two(clock, 1), two(clock, 3), two(clock, 5))
    return [stamp_text(F.concat(day, F.lit(" "), time))]


def _epoch(line: Line) -> list[Column]:
    return [epoch_seconds(line.group("ts"))]


DERIVED = {"apache_error": _apache_error, "java_log": _java_log, "hdfs": _hdfs, "supercomputer": _epoch, "hpc": _epoch}


def with_derived_instants(registry: FormatRegistry | None = None, names: tuple[str, ...] = tuple(DERIVED)) -> FormatRegistry:
    """A copy of the registry whose ``names`` also give timestamps; pass it as ``registry`` to any parsing function.

    Weekday dates (apache_error), ``yy/MM/dd`` or a comma before the fraction (java_log), ``yyMMdd HHmmss`` (hdfs) and
    epoch seconds (supercomputer, hpc). All are read as UTC, two-digit years from 69 on as 19xx. A date that does
    not exist gives null and the entry stays parsed. Level, message and detection are as before, and the given
    registry is not changed. Formats that give timestamps already keep theirs.
    """
    if unknown := set(names) - set(DERIVED):
        raise ValueError(f"no derived instants for {sorted(unknown)}")
    made = FormatRegistry()
    for fmt in (registry or FormatRegistry()).all()[:-1]:
        derived = DERIVED[fmt.name] if fmt.name in names and fmt.stamps is None else fmt.stamps
        made.register(replace(fmt, stamps=derived), fmt.priority)
    return made
