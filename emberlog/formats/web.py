"""Web server and proxy logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import infer_level, level_from_status, map_level
from ..functions.text import Shape
from ..functions.times import MONTH_PATTERN, epoch_stamp, month_number, offset_text, stamp_text
from .base import Line, LogFormat, text_map

# The bracketed time splits into its parts when it has the common-log shape; any other text
# between the brackets still matches and leaves the parts empty.
_CLF_PARTS = rf"(\d{{1,2}})/({MONTH_PATTERN})/(\d{{4}}):(\d{{1,2}}:\d{{1,2}}:\d{{1,2}})"
_CLF_NAMES = ("day", "month", "year", "clock", "zone")
_CLF_ZONED = rf"\[(?:{_CLF_PARTS}\s+([+-]\d{{2}}:?\d{{2}}|Z)|[^\]]+)\]"
_CLF_LOOSE = rf"\[(?:{_CLF_PARTS}(?:\s+([+-]\d{{2}}:?\d{{2}}|Z)|\s[^\]]*)?|[^\]]+)\]"


def _clf_stamps(line: Line):
    date = F.concat_ws("-", line.group("year"), month_number(line.group("month")), line.group("day"))
    wall = F.concat(date, F.lit(" "), line.group("clock"))
    return [F.when(line.group("year") != "", stamp_text(wall, offset_text(line.group("zone"))))]


def _access_words(line: Line):
    """Status without leading zeros; ``0`` for zero."""
    code = F.ltrim(line.group("status"), F.lit("0"))
    return {"status": F.when(code == "", "0").otherwise(code)}


def _access_fields(policy: str, client: str, extra: tuple[str, ...]):
    def fields(line: Line):
        return {
            "level": level_from_status(line.word("code"), policy),
            "message": line.group("request"),
            "source": line.group(client),
            "status": F.nullif(line.word("status"), F.lit("0")),
            "metadata": text_map(status=line.word("status"), **{name: line.optional(name) for name in extra}),
        }

    return fields


# A number too long for an INT still counts as a server error.
_ACCESS_STEPS = (
    _access_words,
    lambda x: {"code": F.when(F.length(x.word("status")) > 9, "999999999").otherwise(x.word("status"))},
)


APACHE_ACCESS = LogFormat(
    name="apache_access",
    description="Apache access log, common or combined",
    shapes=(
        Shape(
            "access",
            rf'([\d.]+)\s+(\S+)\s+(\S+)\s+{_CLF_ZONED}\s+"([^"]*)"\s+(\d+)\s+(\S+)'
            r'(?:\s+"([^"]*)"\s+"([^"]*)")?',
            ("ip", "ident", "user", *_CLF_NAMES, "request", "status", "size", "referer", "user_agent"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=_access_fields("plain", "ip", ("size", "user", "referer", "user_agent")),
    steps=_ACCESS_STEPS,
    stamps=_clf_stamps,
)

NGINX_ACCESS = LogFormat(
    name="nginx_access",
    description="nginx access log, IPv4 or IPv6 clients, optional forwarded address",
    shapes=(
        Shape(
            "access",
            rf'([\d.:a-fA-F]+)\s+(\S+)\s+(\S+)\s+{_CLF_ZONED}\s+"([^"]*)"\s+(\d+)\s+(\S+)'
            r'(?:\s+"([^"]*)"\s+"([^"]*)")?(?:\s+"([^"]*)")?',
            ("ip", "ident", "user", *_CLF_NAMES, "request", "status", "size", "referer", "user_agent", "forwarded"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=_access_fields("verbose", "ip", ("size", "user", "referer", "user_agent", "forwarded")),
    steps=_ACCESS_STEPS,
    stamps=_clf_stamps,
)

NGINX = LogFormat(
    name="nginx",
    description="nginx combined log with optional extra fields",
    shapes=(
        Shape(
            "access",
            rf'(\S+)\s+-\s+(\S+)\s+{_CLF_LOOSE}\s+"([^"]*)"\s+(\d+)\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"(?:\s+(.*))?$',
            ("client_ip", "user", *_CLF_NAMES, "request", "status", "bytes", "referer", "user_agent", "extra"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=_access_fields("plain", "client_ip", ("bytes", "user_agent", "referer")),
    steps=_ACCESS_STEPS,
    stamps=_clf_stamps,
)


def _apache_error_fields(line: Line):
    return {
        "level": map_level(line.word("level"), "apache", "INFO"),
        "message": line.group("message"),
        "source": line.optional("client"),
        "metadata": F.when(
            line.tag == "modern", text_map(module=line.group("module"), pid=line.optional("pid"))
        ).otherwise(F.create_map().cast("map<string,string>")),
    }


APACHE_ERROR = LogFormat(
    name="apache_error",
    description="Apache error log, modern or legacy",
    shapes=(
        Shape(
            "modern",
            r"\[([^\]]+)\]\s+\[(\w+):(\w+)\]\s+(?:\[pid\s+(\d+)\]\s+)?(?:\[client\s+([^\]]+)\]\s+)?(.+)$",
            ("ts", "module", "level", "pid", "client", "message"),
        ),
        Shape("legacy", r"\[([^\]]+)\]\s+\[(\w+)\]\s+(.+)$", ("ts", "level", "message")),
    ),
    parsed=lambda x: x.matched,
    steps=(lambda x: {"level": F.lower(x.group("level"))},),
    fields=_apache_error_fields,
)


def _squid_fields(line: Line):
    return {
        "level": infer_level(line.group("result_code"), "squid"),
        "message": F.concat(line.group("method"), F.lit(" "), line.group("url")),
        "source": line.group("client_ip"),
        "metadata": text_map(
            duration_ms=line.group("duration"),
            bytes=line.group("bytes"),
            result_code=line.group("result_code"),
            user=line.group("user"),
            hierarchy=line.group("hierarchy"),
        ),
    }


def _squid_stamps(line: Line):
    epoch = line.group("ts").try_cast("decimal(30,6)")
    return [F.when(epoch < 253402300800, epoch_stamp((epoch * 1_000_000).cast("bigint")))]


SQUID = LogFormat(
    name="squid",
    description="Squid proxy access log",
    shapes=(
        Shape(
            "squid",
            r"(\d+(?:\.\d+)?)\s+(-?\d+)\s+(\S+)\s+(\S+)\s+(-?\d+)\s+(\w+)\s+(\S+)\s+(\S+)\s+(\S+)\s*(\S*)$",
            ("ts", "duration", "client_ip", "result_code", "bytes", "method", "url", "user", "hierarchy", "content"),
        ),
    ),
    accepts=lambda x: x.raw.rlike(r"(?U)^\d{10}(?:\.\d+)?\s+-?\d+\s+\S+\s+\w+[_/]"),
    parsed=lambda x: x.matched,
    fields=_squid_fields,
    stamps=_squid_stamps,
)

EARLY = (APACHE_ACCESS, APACHE_ERROR, NGINX_ACCESS, NGINX)
LATE = (SQUID,)
