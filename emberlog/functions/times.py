"""Timestamps: text -> (instant, wall clock), independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_PATTERN = "(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"
_MAX_MILLIS = 253402300799999  # 9999-12-31T23:59:59.999Z


def month_number(name: Column) -> Column:
    """``Jan`` .. ``Dec`` in any case -> ``1`` .. ``12`` as text."""
    return ((F.position(F.lower(name), F.lit(_MONTHS)) + 2) / 3).cast("int").cast("string")


def utc_wall_clock(ts: Column) -> Column:
    """TIMESTAMP -> TIMESTAMP_NTZ holding the UTC wall clock."""
    return ntz_from_micros(F.unix_micros(ts))


def ntz_from_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.expr(_EPOCH))


def stamp_text(iso: Column, offset: Column | str = "+00:00") -> Column:
    """Wall clock text plus a six-character offset: one text that holds both readings of a timestamp."""
    return F.concat(iso, F.lit(offset) if isinstance(offset, str) else offset)


def epoch_stamp(micros: Column) -> Column:
    """Stamp text of microseconds since the epoch: ``@`` and the number."""
    return F.concat(F.lit("@"), micros.cast("string"))


def _epoch_micros(stamp: Column) -> Column:
    return F.substring(stamp, 2, 20).try_cast("bigint")


def stamp_instant(stamp: Column) -> Column:
    return F.when(stamp.startswith("@"), F.timestamp_micros(_epoch_micros(stamp))).otherwise(stamp.try_cast("timestamp"))


def stamp_wall_clock(stamp: Column) -> Column:
    """The clock as written; for an epoch number the UTC clock."""
    written = F.left(stamp, F.length(stamp) - 6).try_cast("timestamp_ntz")
    return F.when(stamp.startswith("@"), ntz_from_micros(_epoch_micros(stamp))).otherwise(written)


def cloud_stamp(text: Column) -> Column:
    """Stamp text of a cloud timestamp, null when the shape is not accepted.

    Accepted: digits as epoch milliseconds; ``...Z`` with or without fraction (cut to microseconds);
    an offset, but then without fraction.
    """
    zulu = r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d+)?Z$"
    shifted = r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}[+-]\d{2}):?(\d{2})$"
    millis = text.try_cast("bigint")
    return (
        F.when(text.rlike(zulu), stamp_text(F.rtrim(text, F.lit("Z"))))
        .when(text.rlike(r"^\d{1,15}$") & (millis <= _MAX_MILLIS), epoch_stamp(millis * 1000))
        .when(text.rlike(shifted), F.regexp_replace(text, shifted, "$1:$2"))
    )


def offset_text(zone: Column) -> Column:
    """``+0100``, ``+01:00`` or ``Z`` -> ``+01:00``; an empty text means UTC."""
    return F.when(zone.isin("", "Z"), F.lit("+00:00")).otherwise(
        F.concat(F.left(zone, F.lit(3)), F.lit(":"), F.right(zone, F.lit(2)))
    )


def cloud_ts(text: Column) -> Column:
    return stamp_instant(cloud_stamp(text))


def bucket_label(bucket: Column) -> Column:
    """``MM-DD HH:MM``."""
    return F.date_format(bucket, "MM-dd HH:mm")


def iso_text(ts: Column) -> Column:
    """ISO text with ``T``; the fraction shows only when there is one."""
    return F.replace(ts.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))


def span_text(micros: Column) -> Column:
    """``[D day[s], ]H:MM:SS[.ffffff]``; null for a zero or missing span."""
    seconds = F.floor(micros / 1_000_000).cast("bigint")
    days = F.floor(seconds / 86400).cast("bigint")
    fraction = F.pmod(micros, F.lit(1_000_000))
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("bigint"),
        F.floor(F.pmod(seconds, F.lit(3600)) / 60).cast("bigint"),
        F.pmod(seconds, F.lit(60)),
    )
    day_part = F.when(days == 0, "").when(F.abs(days) == 1, F.format_string("%d day, ", days)).otherwise(
        F.format_string("%d days, ", days)
    )
    tail = F.when(fraction == 0, "").otherwise(F.format_string(".%06d", fraction))
    return F.when(micros != 0, F.concat(day_part, clock, tail))
