"""Cloud provider logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.levels import level_from_message, map_level
from ..functions.text import Shape, request_id, strip
from ..functions.times import cloud_stamp
from ..functions.variants import has, is_object, is_string, member, text_at, text_of, truthy_text
from .base import Line, LogFormat, text_map

_CLOUDWATCH_TEXT = Shape(
    "text",
    r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z)\s+(?:\[(\w+)\]\s+)?(.+)$",
    ("ts", "level", "message"),
)


def _cloudwatch_cells(line: Line):
    """Events of a batch, and the event the line stands for: first of a batch, else the object itself."""
    batch = member(line.doc, "logEvents")
    first = F.try_variant_get(line.doc, "$.logEvents[0]", "variant")
    return [batch, F.when(batch.isNotNull(), first).when(has(line.doc, "message"), line.doc)]


def _cloudwatch_words(line: Line):
    body = F.coalesce(text_at(line.cell(1), "$.message"), F.lit(""))
    return {
        "body": F.when(line.cell(1).isNotNull(), body).otherwise(line.group("message")),
        "stamp": F.coalesce(line.group("ts"), truthy_text(member(line.cell(1), "timestamp"))),
    }


def _cloudwatch_fields(line: Line):
    from_json = line.cell(1).isNotNull()
    batch = line.cell(0).isNotNull()
    body = line.word("body")
    group = F.when(batch, F.nullif(text_at(line.doc, "$.logGroup"), F.lit("")))
    stream = F.when(batch, F.nullif(text_at(line.doc, "$.logStream"), F.lit("")))
    named = F.when(line.matched, F.upper(line.optional("level")))
    return {
        "level": F.coalesce(named, level_from_message(line.word("folded"), folded=True), F.lit("INFO")),
        "message": F.when(from_json, strip(body)).otherwise(body),
        "source": F.when(from_json, group),
        "metadata": F.when(
            from_json,
            text_map(
                parser_type="aws_cloudwatch_json", log_group=group, log_stream=stream, request_id=request_id(body)
            ),
        ).otherwise(text_map(parser_type="aws_cloudwatch_text")),
    }


AWS_CLOUDWATCH = LogFormat(
    name="aws_cloudwatch",
    description="AWS CloudWatch Logs, JSON batches and text exports",
    shapes=(_CLOUDWATCH_TEXT,),
    strips=True,
    openers="{",
    cells=_cloudwatch_cells,
    steps=(_cloudwatch_words, lambda x: {"folded": F.lower(x.word("body"))}),
    accepts=lambda x: x.matched | x.cell(0).isNotNull() | has(x.doc, "logGroup") | has(x.doc, "logStream"),
    parsed=lambda x: x.matched | x.cell(1).isNotNull(),
    fields=_cloudwatch_fields,
    stamps=lambda x: [cloud_stamp(x.word("stamp"))],
)


def _gcp_cells(line: Line):
    doc = line.doc
    payload = member(doc, "jsonPayload")
    return [
        payload,
        member(doc, "labels"),
        F.try_variant_get(doc, "$.resource.labels", "variant"),
        member(payload, "message"),
        member(payload, "msg"),
        member(doc, "textPayload"),
    ]


def _gcp_words(line: Line):
    doc = line.doc
    payload = line.cell(0)
    from_payload = F.coalesce(truthy_text(line.cell(3)), truthy_text(line.cell(4)), text_of(payload))
    return {
        "severity": F.upper(F.coalesce(text_at(doc, "$.severity"), F.lit("INFO"))),
        "message": F.when(line.cell(5).isNotNull(), text_of(line.cell(5))).otherwise(from_payload),
        "stamp": text_at(doc, "$.timestamp"),
    }


def _gcp_fields(line: Line):
    doc = line.doc
    labels, resource_labels = line.cell(1), line.cell(2)
    return {
        "level": map_level(line.word("severity"), "gcp"),
        "message": strip(F.coalesce(line.word("message"), F.lit(""))),
        "source": text_at(doc, "$.resource.type"),
        "metadata": text_map(
            parser_type="gcp_logging",
            resource_labels=F.when(is_object(resource_labels), F.to_json(resource_labels)),
            pod_name=text_at(doc, "$.resource.labels.pod_name"),
            namespace=text_at(doc, "$.resource.labels.namespace_name"),
            instance_id=text_at(doc, "$.resource.labels.instance_id"),
            labels=F.when(is_object(labels), F.to_json(labels)),
            log_name=text_at(doc, "$.logName"),
            trace=text_at(doc, "$.trace"),
            span_id=text_at(doc, "$.spanId"),
        ),
    }


GCP_LOGGING = LogFormat(
    name="gcp_logging",
    description="Google Cloud Logging JSON entries",
    openers="{",
    parsed=lambda x: has(x.doc, "severity") & has(x.doc, "timestamp"),
    cells=_gcp_cells,
    steps=(_gcp_words,),
    fields=_gcp_fields,
    stamps=lambda x: [cloud_stamp(x.word("stamp"))],
)


def _azure_cells(line: Line):
    """The item: first element of an array, else the object."""
    first = F.try_variant_get(line.doc, "$[0]", "variant")
    item = F.when(line.text.startswith("["), F.when(text_of(first).startswith("{"), first)).otherwise(line.doc)
    return [item]


def _azure_words(line: Line):
    item = line.cell(0)
    level, number = member(item, "level"), member(item, "SeverityLevel")
    return {
        "word": F.when(is_string(level), F.upper(text_of(level))),
        "number": F.when(level.isNull() & (F.schema_of_variant(number) == "BIGINT"), text_of(number)),
        "stamp": F.coalesce(truthy_text(member(item, "time")), truthy_text(member(item, "TimeGenerated"))),
        "properties": text_at(item, "$.properties"),
        "context": text_at(item, "$.AdditionalContext"),
    }


def _azure_fields(line: Line):
    item = line.cell(0)
    by_number = map_level(line.word("number"), "azure_number", "INFO")
    return {
        "level": F.when(line.word("word").isNotNull(), map_level(line.word("word"), "azure", "INFO")).otherwise(by_number),
        "message": strip(
            F.coalesce(truthy_text(member(item, "message")), truthy_text(member(item, "Message")), F.lit(""))
        ),
        "source": F.coalesce(truthy_text(member(item, "Computer")), text_at(item, "$.category")),
        "metadata": text_map(
            parser_type="azure_monitor",
            operation=text_at(item, "$.operationName"),
            category=text_at(item, "$.category"),
            properties=F.when(line.word("properties").startswith("{"), line.word("properties")),
            additional_context=F.when(line.word("context").startswith("{"), line.word("context")),
        ),
    }


AZURE_MONITOR = LogFormat(
    name="azure_monitor",
    description="Azure Monitor and Application Insights records",
    openers="{[",
    cells=_azure_cells,
    steps=(_azure_words,),
    accepts=lambda x: (has(x.cell(0), "time") | has(x.cell(0), "TimeGenerated"))
    & (has(x.cell(0), "level") | has(x.cell(0), "SeverityLevel")),
    parsed=lambda x: x.cell(0).isNotNull(),
    fields=_azure_fields,
    stamps=lambda x: [cloud_stamp(x.word("stamp"))],
)

FORMATS = (AWS_CLOUDWATCH, GCP_LOGGING, AZURE_MONITOR)
