"""Text functions and triage jobs over documents, pages, conversations and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import (
    as_array,
    base_name,
    cap_length,
    category_title,
    escape_text,
    first_present,
    infer_level,
    level_from_message,
    pct,
    redact_pii,
    request_id,
    strip,
    syslog_priority,
    token_estimate,
    wrap_markers,
)
from emberlog.functions.variants import parse_object, text_of
from emberlog.operators import triage
from emberlog.plans import summary as plans
from emberlog.runtime import scratch_path
from emberlog.sources import store

from .registry import query, table
from .render import EV, LOG, access_log, document_lines, events_frame

_DOC_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


@query(
    "redact_pii",
    r"""SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL_REDACTED]', 'g'),
  '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '[IP_REDACTED]', 'g') AS text FROM documents""",
)
def redact_pii_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact_pii(F.col("text")).alias("text"))


@query(
    "cap_length",
    """SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '[... truncated, ' || (length(text) - 500)
  || ' more characters ...]' ELSE text END AS text FROM documents""",
)
def cap_length_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cap_length(F.col("text"), 500).alias("text"))


@query(
    "wrap_markers",
    """SELECT conv_id, turn, CASE WHEN contains(lower(marked), 'system prompt:') THEN '[LOG DATA START]' || chr(10) || marked || chr(10) || '[LOG DATA END]'
  ELSE marked END AS text FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'System Prompt: ' || text ELSE text END AS marked FROM conversations)""",
)
def wrap_markers_query(spark, sf_dir):
    marked = F.when(F.col("role") == "user", F.concat(F.lit("System Prompt: "), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", wrap_markers(marked).alias("text"))


@query("token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def token_estimate_query(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@query("escape_markdown", "SELECT page_id, replace(html, '|', chr(92) || '|') AS text FROM pages")
def escape_markdown(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", escape_text(F.col("html"), "markdown").alias("text"))


@query("escape_html", "SELECT page_id, replace(replace(html, '<', '&lt;'), '>', '&gt;') AS text FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", escape_text(F.col("html"), "html").alias("text"))


@query("base_name", "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages")
def base_name_query(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", base_name(F.col("url")).alias("name"))


@query(
    "strip",
    f"WITH {_DOC_LINES} SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(13) || chr(160) || chr(8195) || chr(12288)) AS text FROM l",
)
def strip_query(spark, sf_dir):
    """Lines framed in Unicode white space, then stripped."""
    lines = document_lines(spark, sf_dir)
    framed = F.concat(F.lit("  \t"), F.col("raw"), F.lit(" 　\r"))
    return lines.select(
        F.substring("source_path", 5, 20).cast("bigint").alias("doc_id"),
        F.col("line_id").alias("line_no"),
        strip(framed).alias("text"),
    )


@query(
    "level_from_message",
    f"""WITH {_DOC_LINES}, u AS (SELECT doc_id, line_no, lower(raw) AS t FROM l)
SELECT doc_id, line_no, CASE WHEN contains(t, 'fatal') OR contains(t, 'crit') THEN 'CRITICAL' WHEN contains(t, 'err') THEN 'ERROR'
  WHEN contains(t, 'warn') THEN 'WARNING' WHEN contains(t, 'info') THEN 'INFO' WHEN contains(t, 'debug') THEN 'DEBUG' END AS level FROM u""",
)
def level_from_message_query(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        F.substring("source_path", 5, 20).cast("bigint").alias("doc_id"),
        F.col("line_id").alias("line_no"),
        level_from_message(F.col("raw")).alias("level"),
    )


@query(
    "infer_level",
    f"""WITH {_DOC_LINES}, u AS (SELECT doc_id, line_no, lower(raw) AS t FROM l)
SELECT doc_id, line_no, CASE WHEN contains(t, 'error') OR contains(t, 'fail') OR contains(t, 'exception') THEN 'ERROR'
  WHEN contains(t, 'warn') THEN 'WARNING' WHEN contains(t, 'debug') THEN 'DEBUG' ELSE 'INFO' END AS level FROM u""",
)
def infer_level_query(spark, sf_dir):
    return document_lines(spark, sf_dir).select(
        F.substring("source_path", 5, 20).cast("bigint").alias("doc_id"),
        F.col("line_id").alias("line_no"),
        infer_level(F.col("raw"), "universal").alias("level"),
    )


@query(
    "request_id",
    """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] END AS request_id
FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events)""",
)
def request_id_query(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    uuid = F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12))
    text = F.when(F.pmod("event_id", F.lit(3)) > 0, F.concat(F.lit("START "), uuid, F.lit(" done"))).otherwise(F.lit("no id"))
    return table(spark, sf_dir, "events").select("event_id", request_id(text).alias("request_id"))


@query(
    "category_title",
    """SELECT event_id, CASE event_type WHEN 'view' THEN 'View Spike' WHEN 'click' THEN 'Click Spike' WHEN 'signup' THEN 'Signup Spike'
  WHEN 'purchase' THEN 'Purchase Spike' ELSE 'Error Spike' END AS title FROM events""",
)
def category_title_query(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", category_title(F.concat(F.col("event_type"), F.lit("_spike"))).alias("title")
    )


@query(
    "as_array",
    f"""WITH {EV} SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n,
  CASE event_id % 3 WHEN 2 THEN NULL ELSE msg END AS first FROM ev""",
)
def as_array_query(spark, sf_dir):
    kind = F.pmod("event_id", F.lit(3))
    text = F.when(kind == 0, F.to_json(F.array("msg", "ip"))).when(kind == 1, F.col("msg"))
    items = as_array(text)
    return events_frame(spark, sf_dir).select(
        "event_id", F.size(items).cast("bigint").alias("n"), F.get(items, F.lit(0)).alias("first")
    )


@query(
    "first_present",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') ELSE event_type END AS value FROM events",
)
def first_present_query(spark, sf_dir):
    """The first key that exists wins: props.k, else the type."""
    events = table(spark, sf_dir, "events")
    text = F.when(F.pmod("event_id", F.lit(2)) == 0, F.col("props")).otherwise(
        F.to_json(F.struct(F.col("event_type").alias("kind"), F.lit("x").alias("other")))
    )
    return events.select("event_id", text_of(first_present(parse_object(text), ["k", "kind", "other"])).alias("value"))


@query(
    "syslog_priority",
    "SELECT event_id, CAST(event_id % 192 // 8 AS BIGINT) AS facility, CAST(event_id % 192 % 8 AS BIGINT) AS severity FROM events",
)
def syslog_priority_query(spark, sf_dir):
    number = syslog_priority(F.pmod("event_id", F.lit(192)).cast("string"))
    return table(spark, sf_dir, "events").select(
        "event_id", number["facility"].alias("facility"), number["severity"].alias("severity")
    )


@query(
    "pct",
    "SELECT l_orderkey, round(100.0 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / count(*), 6) AS share FROM lineitem GROUP BY ALL",
)
def pct_query(spark, sf_dir):
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("r"), F.count(F.lit(1)).alias("n")
    )
    return grouped.select("l_orderkey", F.round(pct(F.col("r"), F.col("n")), 6).alias("share"))


# --- triage --------------------------------------------------------------------------------------


@query(
    "triage_context",
    f"""WITH {LOG} SELECT source_path, format('{{:,}}', count(*)) AS total_lines, format('{{:,}}', count(*) FILTER (outcome = 'parsed')) AS parsed_lines,
  least(50, count(*) FILTER (outcome = 'parsed' AND level = 'ERROR')) AS errors,
  least(50, count(*) FILTER (outcome = 'parsed' AND level = 'WARNING')) AS warnings FROM log GROUP BY ALL""",
)
def triage_context(spark, sf_dir):
    """Numbers picked back out of the context text."""
    frame = plans.summarize(access_log(spark, sf_dir), fmt="apache_access", analytics=True)
    contexts = triage.sanitize_context(triage.triage_context(frame))
    def pick(pattern):
        return F.regexp_extract("context", pattern, 1)
    return contexts.select(
        "source_path",
        pick(r"\*\*Total Lines\*\*: ([0-9,]+)").alias("total_lines"),
        pick(r"\*\*Parsed Lines\*\*: ([0-9,]+)").alias("parsed_lines"),
        pick(r"Top Errors \((\d+) total\)").cast("bigint").alias("errors"),
        pick(r"Top Warnings \((\d+) total\)").cast("bigint").alias("warnings"),
    )


@query(
    "sanitize_context",
    r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b', '[EMAIL_REDACTED]', 'g'),
  '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '[IP_REDACTED]', 'g') AS clean FROM documents)
SELECT doc_id, CASE WHEN length(clean) > 2000 THEN left(clean, 2000) || chr(10) || chr(10) || '[... truncated, ' || (length(clean) - 2000)
  || ' more characters ...]' ELSE clean END AS context FROM c""",
)
def sanitize_context(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return triage.sanitize_context(documents.select("doc_id", F.col("text").alias("context")), 2000)


# Responses made from labels: valid, fenced, broken, and with bad issues, by doc_id.
R = """r AS (SELECT doc_id, quality, toxic, doc_id % 4 AS kind FROM labels)"""


def responses(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    severity = F.when(F.col("toxic") == 1, "critical").otherwise("odd")
    issue = F.struct(
        F.concat(F.lit("Issue "), F.col("doc_id").cast("string")).alias("title"),
        severity.alias("severity"),
        F.lit(0.75).alias("confidence"),
        F.lit("error_spike").alias("category"),
        F.array(F.lit("api"), F.lit("db")).alias("affected_components"),
        F.lit("one line").alias("evidence"),
    )
    bad = F.struct(
        F.lit("Bad").alias("title"),
        F.lit("LOW").alias("severity"),
        F.lit(1.5).alias("confidence"),
        F.lit("x").alias("category"),
        F.array(F.lit("api")).alias("affected_components"),
        F.lit("-").alias("evidence"),
    )
    body = F.to_json(
        F.struct(
            F.concat(F.lit("Quality "), F.col("quality").cast("string")).alias("summary"),
            F.when(F.col("quality") == 1, "LOW").otherwise("high").alias("overall_severity"),
            F.lit(0.9).alias("confidence"),
            F.array(issue, bad).alias("issues"),
        )
    )
    kind = F.pmod("doc_id", F.lit(4))
    content = (
        F.when(kind == 0, body)
        .when(kind == 1, F.concat(F.lit("<thinking>hm</thinking>\n```json\n"), body, F.lit("\n```\nbye")))
        .when(kind == 2, F.concat(F.lit("Sure: "), body, F.lit(" done")))
        .otherwise(F.lit("no json here"))
    )
    return labels.select(F.col("doc_id").alias("id"), content.alias("content"))


@query(
    "parse_responses",
    f"""WITH {R} SELECT doc_id AS id, CASE WHEN kind = 3 THEN 'AI analysis completed but response parsing failed' ELSE 'Quality ' || quality END AS summary,
  CASE WHEN kind = 3 THEN 'MEDIUM' WHEN quality = 1 THEN 'LOW' ELSE 'HIGH' END AS overall_severity,
  CASE WHEN kind = 3 THEN 0.3::DOUBLE ELSE 0.9::DOUBLE END AS confidence, CASE WHEN kind = 3 THEN 0 ELSE 1 END AS issues FROM r""",
)
def parse_responses(spark, sf_dir):
    parsed = triage.parse_responses(responses(spark, sf_dir))
    return parsed.select("id", "summary", "overall_severity", "confidence", F.size("issues").alias("issues"))


_ISSUES = f"""WITH {R} SELECT doc_id AS id, 1 AS position, 'Issue ' || doc_id AS title, CASE WHEN toxic = 1 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity,
  0.75::DOUBLE AS confidence, 'error_spike' AS category, 2 AS components, 'one line' AS evidence, '' AS recommendation FROM r WHERE kind < 3"""


def _issue_columns(frame):
    return frame.select(
        "id",
        "position",
        "title",
        "severity",
        "confidence",
        "category",
        F.size("affected_components").alias("components"),
        F.array_join("evidence", "|").alias("evidence"),
        "recommendation",
    )


@query("explode_issues", _ISSUES)
def explode_issues(spark, sf_dir):
    return _issue_columns(triage.explode_issues(triage.parse_responses(responses(spark, sf_dir))))


@query(
    "append_triages",
    f"""WITH {R} SELECT CAST(doc_id AS VARCHAR) AS analysis_id, CASE WHEN kind = 3 THEN 'MEDIUM' WHEN quality = 1 THEN 'LOW' ELSE 'HIGH' END AS overall_severity,
  CASE WHEN kind = 3 THEN 0 ELSE 1 END AS issues, 'table' AS provider_used FROM r""",
)
def append_triages(spark, sf_dir):
    """Results written to the store and read back."""
    root = scratch_path(spark, "store")
    parsed = triage.parse_responses(responses(spark, sf_dir))
    rows = parsed.select(
        F.col("id").cast("string").alias("analysis_id"),
        "summary",
        "overall_severity",
        "confidence",
        "issues",
        F.lit("table").alias("provider_used"),
        F.lit(12.5).alias("analysis_time_ms"),
        "raw_analysis",
    )
    store.append_triages(rows, root)
    stored = store.read_store(spark, root, "triages")
    return stored.select("analysis_id", "overall_severity", F.size("issues").alias("issues"), "provider_used")
