"""Container runtime logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import level_from_message, map_level
from ..functions.text import Shape, strip
from ..functions.times import cloud_stamp
from ..functions.variants import has, parse_object, text_at, text_of
from .base import Line, LogFormat, text_map

_CRI = Shape(
    "cri",
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z)\s+(stdout|stderr)\s+([FP])\s+(.*)$",
    ("ts", "stream", "flag", "message"),
)


def _stream_level(line: Line):
    """Level named in the message, else WARNING for stderr and INFO for stdout."""
    default = F.when(line.word("stream") == "stderr", "WARNING").otherwise("INFO")
    return F.coalesce(level_from_message(line.word("folded"), folded=True), default)


def _fold(line: Line):
    return {"folded": F.lower(line.word("message"))}


def _has_docker_keys(line: Line):
    return has(line.doc, "log") & has(line.doc, "stream") & has(line.doc, "time")


def _docker_words(line: Line):
    return {
        "message": F.rtrim(F.coalesce(text_at(line.doc, "$.log"), F.lit("")), F.lit("\n")),
        "stream": F.coalesce(text_at(line.doc, "$.stream"), F.lit("stdout")),
        "stamp": text_at(line.doc, "$.time"),
    }


DOCKER_JSON = LogFormat(
    name="docker_json",
    description="Docker container logs, one JSON object per line",
    openers="{",
    steps=(_docker_words, _fold),
    accepts=_has_docker_keys,
    parsed=lambda x: x.doc.isNotNull(),
    fields=lambda x: {
        "level": _stream_level(x),
        "message": x.word("message"),
        "source": x.word("stream"),
        "metadata": text_map(parser_type="docker_json", stream=x.word("stream")),
    },
    stamps=lambda x: [cloud_stamp(x.word("stamp"))],
)


def _kubernetes_words(line: Line):
    """The CRI groups, or the Docker keys when the line is no CRI line."""
    docker = _docker_words(line)
    names = {"message": "message", "stream": "stream", "stamp": "ts"}
    return {word: F.when(line.matched, line.group(group)).otherwise(docker[word]) for word, group in names.items()}


def _kubernetes_fields(line: Line):
    stream = line.word("stream")
    return {
        "level": _stream_level(line),
        "message": line.word("message"),
        "source": stream,
        "metadata": F.when(
            line.matched, text_map(parser_type="kubernetes_cri", stream=stream, flag=line.group("flag"))
        ).otherwise(text_map(parser_type="kubernetes_json", stream=stream)),
    }


KUBERNETES = LogFormat(
    name="kubernetes",
    description="Kubernetes pod logs, CRI lines or Docker JSON",
    shapes=(_CRI,),
    strips=True,
    openers="{",
    steps=(_kubernetes_words, _fold),
    parsed=lambda x: x.matched | _has_docker_keys(x),
    fields=_kubernetes_fields,
    stamps=lambda x: [cloud_stamp(x.word("stamp"))],
)


def _containerd_words(line: Line):
    body = line.cell(0)
    text = line.group("message")
    return {
        "message": F.when(has(body, "msg"), F.coalesce(text_at(body, "$.msg"), F.lit(""))).otherwise(text),
        "stream": line.group("stream"),
        "component": text_at(body, "$.component"),
        "level": F.upper(text_at(body, "$.level")),
        "stamp": line.group("ts"),
    }


def _containerd_fields(line: Line):
    known = F.nullif(map_level(line.word("level"), "containerd", ""), F.lit(""))
    return {
        "level": F.coalesce(known, _stream_level(line)),
        "message": strip(line.word("message")),
        "source": F.coalesce(F.nullif(line.word("component"), F.lit("")), line.word("stream")),
        "metadata": text_map(
            parser_type="containerd_cri",
            stream=line.word("stream"),
            flag=line.group("flag"),
            component=line.word("component"),
            json_data=text_of(line.cell(0)),
        ),
    }


def _containerd_accepts(line: Line):
    message = line.group("message")
    body = line.cell(0)
    return line.matched & (
        has(body, "component")
        | has(body, "level")
        | has(body, "msg")
        | message.contains("[INFO]")
        | message.contains("plugin/")
        | message.contains("component")
    )


CONTAINERD = LogFormat(
    name="containerd",
    description="containerd CRI logs, text or JSON messages",
    shapes=(_CRI,),
    strips=True,
    cells=lambda x: [parse_object(strip(x.group("message")))],
    steps=(_containerd_words, _fold),
    accepts=_containerd_accepts,
    parsed=lambda x: x.matched,
    fields=_containerd_fields,
    stamps=lambda x: [cloud_stamp(x.word("stamp"))],
)

FORMATS = (DOCKER_JSON, KUBERNETES, CONTAINERD)
