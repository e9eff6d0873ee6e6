"""Device, platform and application logs with fixed layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import infer_level, map_level
from ..functions.text import Shape
from ..functions.times import stamp_text
from .base import Line, LogFormat, text_map

_LEVEL_WORDS = "INFO|WARN|ERROR|DEBUG|TRACE|FATAL"

ANDROID = LogFormat(
    name="android",
    description="Android logcat",
    shapes=(
        Shape(
            "logcat",
            r"(\d{2})-(\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d{3})\s+(\d+)\s+(\d+)\s+([VDIWEF])\s+(\S+?):\s*(.*)$",
            ("month", "day", "clock", "pid", "tid", "level", "tag", "message"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": map_level(x.group("level"), "android", "INFO"),
        "message": x.group("message"),
        "source": x.group("tag"),
        "metadata": text_map(pid=x.group("pid"), tid=x.group("tid"), tag=x.group("tag")),
    },
)

JAVA_LOG = LogFormat(
    name="java_log",
    description="Java log4j lines, full or short date",
    shapes=(
        Shape(
            "full",
            rf"(\d{{4}}-\d{{2}}-\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}}[,.]\d{{3}})\s*-?\s*({_LEVEL_WORDS})\s+"
            r"(?:\[([^\]]+)\]\s+)?(\S+?):\s*(.*)$",
            ("ts", "level", "thread", "class", "message"),
        ),
        Shape(
            "short",
            rf"(\d{{2}}/\d{{2}}/\d{{2}}\s+\d{{2}}:\d{{2}}:\d{{2}})\s+({_LEVEL_WORDS})\s+(\S+?):\s*(.*)$",
            ("ts", "level", "class", "message"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": map_level(x.group("level"), "java"),
        "message": x.group("message"),
        "source": x.group("class"),
        "metadata": text_map(thread=F.nullif(x.group("thread"), F.lit("")), **{"class": x.group("class")}),
    },
)

HDFS = LogFormat(
    name="hdfs",
    description="HDFS compact logs",
    shapes=(
        Shape(
            "hdfs",
            rf"(\d{{6}})\s+(\d{{6}})\s+(\d+)\s+({_LEVEL_WORDS})\s+(\S+?):\s*(.*)$",
            ("date", "clock", "id", "level", "class", "message"),
        ),
    ),
    accepts=lambda x: x.group("level").isin("INFO", "WARN", "ERROR", "DEBUG"),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": map_level(x.group("level"), "hdfs"),
        "message": x.group("message"),
        "source": x.group("class"),
        "metadata": text_map(id=x.group("id"), **{"class": x.group("class")}),
    },
)


def _supercomputer_fields(line: Line):
    bgl = line.tag == "bgl"
    return {
        "level": F.when(bgl, map_level(F.upper(line.group("level")), "supercomputer", "INFO")).otherwise(
            infer_level(line.group("rest"), "thunderbird")
        ),
        "message": F.when(bgl, line.group("message")).otherwise(line.group("rest")),
        "source": line.group("node"),
        "metadata": F.when(bgl, text_map(type=line.group("type"), component=line.group("component"))).otherwise(
            F.create_map().cast("map<string,string>")
        ),
    }


SUPERCOMPUTER = LogFormat(
    name="supercomputer",
    description="Supercomputer logs, BGL or Thunderbird",
    shapes=(
        Shape(
            "bgl",
            r"-\s+(\d+)\s+(\d{4}\.\d{2}\.\d{2})\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)$",
            ("ts", "date", "node", "datetime", "node2", "type", "component", "level", "message"),
        ),
        Shape(
            "thunderbird",
            r"-\s+(\d+)\s+(\d{4}\.\d{2}\.\d{2})\s+(\S+)\s+(.*)$",
            ("ts", "date", "node", "rest"),
        ),
    ),
    accepts=lambda x: x.raw.startswith("- "),
    parsed=lambda x: x.matched,
    fields=_supercomputer_fields,
)

WINDOWS = LogFormat(
    name="windows",
    description="Windows servicing logs (CBS, CSI)",
    shapes=(
        Shape(
            "windows",
            r"(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}),\s*(\w+)\s+(\w+)\s+(.*)$",
            ("ts", "level", "component", "message"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": map_level(F.upper(x.group("level")), "windows", "INFO"),
        "message": x.group("message"),
        "source": x.group("component"),
        "metadata": text_map(component=x.group("component")),
    },
)

PROXIFIER = LogFormat(
    name="proxifier",
    description="Proxifier connection logs",
    shapes=(
        Shape(
            "proxifier",
            r"\[(\d+\.\d+)\s+(\d{2}:\d{2}:\d{2})\]\s+(\S+)(?:\s+\*\d+)?\s+-\s+(.*)$",
            ("date", "clock", "process", "message"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": infer_level(x.group("message"), "proxifier"),
        "message": x.group("message"),
        "source": x.group("process"),
        "metadata": text_map(process=x.group("process")),
    },
)

HPC = LogFormat(
    name="hpc",
    description="High performance computing event logs",
    shapes=(
        Shape(
            "hpc",
            r"(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(\d+)\s+(.*)$",
            ("id", "node", "category", "event", "ts", "flag", "message"),
        ),
    ),
    accepts=lambda x: x.raw.rlike(r"(?U)^\d+\s+(?:node-\d+|gige\d+)\s+\w+(?:\.\w+)?"),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": infer_level(x.group("event"), "hpc"),
        "message": x.group("message"),
        "source": x.group("node"),
        "metadata": text_map(id=x.group("id"), category=x.group("category"), event=x.group("event")),
    },
)

HEALTHAPP = LogFormat(
    name="healthapp",
    description="Health application logs, pipe separated",
    shapes=(
        Shape(
            "health",
            r"(\d{4})(\d{2})(\d{2})-(\d{1,2}:\d{1,2}:\d{1,2}):(\d{1,3})\|([^|]+)\|(\d+)\|(.*)$",
            ("year", "month", "day", "clock", "fraction", "component", "id", "message"),
        ),
    ),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": F.lit("INFO"),
        "message": x.group("message"),
        "source": x.group("component"),
        "metadata": text_map(component=x.group("component"), id=x.group("id")),
    },
    stamps=lambda x: [
        stamp_text(
            F.concat(
                F.concat_ws("-", x.group("year"), x.group("month"), x.group("day")),
                F.lit(" "),
                F.concat_ws(".", x.group("clock"), x.group("fraction")),
            )
        )
    ],
)

OPENSTACK = LogFormat(
    name="openstack",
    description="OpenStack service logs",
    shapes=(
        Shape(
            "openstack",
            r"(\S+)\s+(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}\.\d+)\s+(\d+)\s+(\w+)\s+(\S+)\s+\[([^\]]+)\]\s+(.*)$",
            ("filename", "date", "clock", "pid", "level", "component", "request_id", "message"),
        ),
    ),
    accepts=lambda x: x.raw.rlike(r"(?Ud)^\S+\s+\d{4}-\d{2}-\d{2}.*\[req-"),
    parsed=lambda x: x.matched,
    fields=lambda x: {
        "level": F.upper(x.group("level")),
        "message": x.group("message"),
        "source": x.group("component"),
        "metadata": text_map(
            filename=x.group("filename"), pid=x.group("pid"), request_id=x.group("request_id")
        ),
    },
    stamps=lambda x: [
        F.when(
            F.length(x.group("clock")) <= 15, stamp_text(F.concat(x.group("date"), F.lit(" "), x.group("clock")))
        )
    ],
)

FORMATS = (ANDROID, JAVA_LOG, HDFS, SUPERCOMPUTER, WINDOWS, PROXIFIER, HPC, HEALTHAPP, OPENSTACK)
