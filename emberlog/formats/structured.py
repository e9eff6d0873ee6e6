"""Generic JSON lines and syslog."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.levels import infer_level, map_level, syslog_priority
from ..functions.text import Shape
from ..functions.times import epoch_stamp, offset_text, stamp_text
from ..functions.variants import first_present, is_string, member, printed, text_of, truthy_text
from .base import Line, LogFormat, text_map

# Keys tried in this order.
TIMESTAMP_KEYS = ["timestamp", "time", "@timestamp", "ts", "datetime"]
LEVEL_KEYS = ["level", "severity", "lvl", "log_level", "loglevel"]
MESSAGE_KEYS = ["message", "msg", "text", "log"]
SOURCE_KEYS = ["source", "host", "hostname", "server", "ip"]

_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_ZULU = rf"^{_DATE}T{_CLOCK}(?:\.\d{{1,6}})?Z$"
_SHIFTED = rf"^{_DATE}T{_CLOCK}[+-]\d{{2}}:?\d{{2}}$"
_PLAIN = rf"^{_DATE}\s+{_CLOCK}(?:\.\d{{1,6}})?$"
_LENIENT = rf"^{_DATE}T{_CLOCK}(?:\.\d+)?$"


def _json_stamp(text: Column, lenient: bool) -> Column:
    """Stamp text of one candidate: a known date layout, or ``#`` and a number of epoch seconds."""
    plain = rf"{_PLAIN}|{_LENIENT}" if lenient else _PLAIN
    seconds = F.substring(text, 2, 40).try_cast("double")
    in_range = text.startswith("#") & (F.abs(seconds) < 253402300800)
    return (
        F.when(text.rlike(_ZULU), stamp_text(F.rtrim(text, F.lit("Z"))))
        .when(in_range, epoch_stamp(F.floor(seconds * 1_000_000 + 0.5)))
        .when(text.rlike(plain), stamp_text(F.regexp_replace(text, r"\s+", " ")))
        .when(text.rlike(_SHIFTED), F.regexp_replace(text, r"([+-]\d{2}):?(\d{2})$", "$1:$2"))
    )


def _marked_number(doc: Column, key: str) -> Column:
    """Text under a key as it is; any other value behind a ``#``."""
    value = member(doc, key)
    return F.when(is_string(value), text_of(value)).otherwise(F.concat(F.lit("#"), text_of(value)))


def _json_words(line: Line):
    word = F.upper(printed(line.cell(0)))
    return {
        "level": F.coalesce(F.nullif(word, F.lit("")), F.lit("INFO")),
        "message": F.coalesce(printed(line.cell(1)), F.lit("")),
        "source": printed(line.cell(2)),
        "status": truthy_text(line.cell(3)),
        **{f"stamp_{key}": _marked_number(line.doc, key) for key in TIMESTAMP_KEYS},
    }


def _json_fields(line: Line):
    return {
        "level": map_level(line.word("level"), "json"),
        "message": line.word("message"),
        "source": line.word("source"),
        "status": line.word("status"),
        "metadata": F.try_variant_get(line.doc, "$", "map<string,string>"),
    }


def json_format(lenient_ts: bool = False) -> LogFormat:
    """Generic JSON lines. ``lenient_ts`` also takes ISO timestamps without zone suffix."""
    return LogFormat(
        name="json",
        description="JSON structured logging with common key names",
        openers="{",
        cells=lambda x: [first_present(x.doc, keys) for keys in (LEVEL_KEYS, MESSAGE_KEYS, SOURCE_KEYS, ["status"])],
        steps=(_json_words,),
        parsed=lambda x: x.doc.isNotNull(),
        fields=_json_fields,
        stamps=lambda x: [_json_stamp(x.word(f"stamp_{key}"), lenient_ts) for key in TIMESTAMP_KEYS],
    )


JSON = json_format()

_BSD_TIME = r"(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})"
_TAGGED = r"(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
_ISO_5424 = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:[+-]\d{2}:?\d{2}|Z)?)?$"


def _syslog_words(line: Line):
    stamp = F.replace(line.group("ts5424"), F.lit(","), F.lit("."))
    priority = line.group("priority").try_cast("bigint")
    return {
        "priority": priority.cast("string"),
        "folded": F.when(line.tag == "bsd", F.lower(line.group("message"))),
        "stamp": F.when(stamp.rlike(_ISO_5424), stamp),
    }


def _syslog_zone(line: Line):
    return {"zone": F.regexp_extract(line.word("stamp"), r"[T ].*?([+-]\d{2}:?\d{2}|Z)$", 1)}


def _syslog_fields(line: Line):
    priority = syslog_priority(line.word("priority"))
    numbered = line.tag != "bsd"
    return {
        "level": F.when(numbered, map_level(priority["severity"].cast("string"), "syslog", "INFO")).otherwise(
            infer_level(line.word("folded"), "bsd", folded=True)
        ),
        "message": line.group("message"),
        "source": line.group("hostname"),
        "metadata": text_map(
            facility=F.when(numbered, priority["facility"]),
            severity=F.when(numbered, priority["severity"]),
            tag=line.group("tag"),
            pid=line.optional("pid"),
            appname=line.group("appname"),
            procid=line.group("procid"),
            msgid=line.group("msgid"),
            structured_data=line.group("structured_data"),
        ),
    }


def _syslog_stamps(line: Line):
    """A date alone means midnight."""
    stamp, zone = line.word("stamp"), line.word("zone")
    wall = F.left(stamp, F.length(stamp) - F.length(zone))
    midnight = F.concat(stamp, F.lit(" 00:00"))
    return [stamp_text(F.when(F.length(stamp) <= 10, midnight).otherwise(wall), offset_text(zone))]


SYSLOG = LogFormat(
    name="syslog",
    description="Syslog, RFC 5424, RFC 3164 and BSD lines",
    shapes=(
        Shape(
            "rfc5424",
            r"<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(-|(?:\[.+?\])+)\s+(.*)$",
            ("priority", "version", "ts5424", "hostname", "appname", "procid", "msgid", "structured_data", "message"),
        ),
        Shape("rfc3164", rf"<(\d+)>{_BSD_TIME}\s+{_TAGGED}", ("priority", "ts", "hostname", "tag", "pid", "message")),
        Shape("bsd", rf"{_BSD_TIME}\s+{_TAGGED}", ("ts", "hostname", "tag", "pid", "message")),
    ),
    accepts=lambda x: x.raw.rlike("^<[^>]{0,3}>")
    | (
        (F.length(x.raw) > 15)
        & F.left(x.raw, F.lit(3)).isin(
            "Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"
        )
    ),
    parsed=lambda x: x.matched,
    steps=(_syslog_words, _syslog_zone),
    fields=_syslog_fields,
    stamps=_syslog_stamps,
)

FORMATS = (JSON, SYSLOG)
