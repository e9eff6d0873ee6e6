"""Sources, detection, filters, counts and summaries over the rendered access log."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import (
    ellipsize,
    error_rate,
    is_error,
    is_warning,
    level_from_status,
    level_rank,
    map_level,
    parse_success_rate,
    status_category,
    utc_wall_clock,
)
from emberlog.operators import counts, detect, entries as ops, ranking
from emberlog.plans import summary as plans
from emberlog.runtime import materialize, scratch_path
from emberlog.sources import lines as src

from .registry import query, table
from .render import (
    EV,
    LOG,
    access_entries,
    access_log,
    access_raw,
    as_lines,
    document_lines,
    events_frame,
    mixed_log,
    raw_line,
)

_PARSED = "SELECT * FROM log WHERE outcome = 'parsed'"


# --- sources -------------------------------------------------------------------------------------


def _written_log(spark, sf_dir: str, compressed: bool = False) -> str:
    """The access log as text files, one folder per source, several files each."""
    path = scratch_path(spark, "log")
    frame = events_frame(spark, sf_dir).select("source_path", "event_id", access_raw().alias("value"))
    writer = frame.repartitionByRange("source_path", "event_id").sortWithinPartitions("source_path", "event_id")
    out = writer.drop("event_id").write.partitionBy("source_path")
    (out.option("compression", "gzip") if compressed else out).text(path)
    return path


def _folder(column: str = "source_path"):
    return F.regexp_extract(column, "source_path=([^/]+)", 1)


@query("read_lines", f"WITH {LOG} SELECT source_path, outcome, count(*) AS n FROM log GROUP BY ALL")
def read_lines(spark, sf_dir):
    """Text files back as lines: nothing lost, nothing changed."""
    lines = src.read_lines(spark, _written_log(spark, sf_dir))
    kind = F.when(F.trim("raw") == "", "blank").when(F.col("raw").startswith("noise "), "failed").otherwise("parsed")
    return lines.groupBy(_folder().alias("source_path"), kind.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("read_lines_gzip", f"WITH {LOG} SELECT source_path, count(*) AS n FROM log GROUP BY ALL")
def read_lines_gzip(spark, sf_dir):
    lines = src.read_lines(spark, _written_log(spark, sf_dir, compressed=True))
    return lines.groupBy(_folder().alias("source_path")).agg(F.count(F.lit(1)).alias("n"))


@query("count_lines", f"WITH {LOG} SELECT source_path, count(*) AS n FROM log GROUP BY ALL")
def count_lines(spark, sf_dir):
    return counts.count_lines(access_log(spark, sf_dir))


@query(
    "parse_files",
    f"""WITH {LOG} SELECT source_path, level, count(*) AS n, min(sec) AS first_ts, max(sec) AS last_ts
FROM ({_PARSED}) GROUP BY ALL""",
)
def parse_files(spark, sf_dir):
    entries = src.parse_files(spark, _written_log(spark, sf_dir))
    return entries.groupBy(_folder().alias("source_path"), "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_ts_local").alias("first_ts"), F.max("event_ts_local").alias("last_ts")
    )


_NTH = "row_number() OVER (PARTITION BY source_path ORDER BY event_id {0}) AS position"


@query(
    "head_lines",
    f"WITH {LOG} SELECT source_path, event_id AS line_id, position FROM (SELECT *, {_NTH.format('')} FROM log) WHERE position <= 50",
)
def head_lines(spark, sf_dir):
    return src.head_lines(access_log(spark, sf_dir), 50).select("source_path", "line_id", "position")


@query(
    "tail_lines",
    f"WITH {LOG} SELECT source_path, event_id AS line_id, position FROM (SELECT *, {_NTH.format('DESC')} FROM log) WHERE position <= 50",
)
def tail_lines(spark, sf_dir):
    return src.tail_lines(access_log(spark, sf_dir), 50).select("source_path", "line_id", "position")


# --- detection -----------------------------------------------------------------------------------

_FIRST_100 = "SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY event_id) AS rn FROM {0}"


@query(
    "detect_format",
    f"""WITH {EV}, first AS (SELECT * FROM ({_FIRST_100.format('ev')}) WHERE rn <= 100)
SELECT source_path, CASE source_path WHEN 'app-0' THEN 'apache_access' WHEN 'app-1' THEN 'json'
         WHEN 'app-2' THEN 'syslog' ELSE 'android' END AS format, count(*) AS hits FROM first GROUP BY ALL""",
)
def detect_format(spark, sf_dir):
    return detect.detect_format(mixed_log(spark, sf_dir))


@query(
    "detect_format_physical",
    f"""WITH {LOG}, first AS (SELECT * FROM ({_FIRST_100.format('log')}) WHERE rn <= 100)
SELECT source_path, 'apache_access' AS format, count(*) FILTER (outcome = 'parsed') AS hits FROM first GROUP BY ALL""",
)
def detect_format_physical(spark, sf_dir):
    """Blank and noise lines use up the sample of 100 physical lines."""
    return detect.detect_format(access_log(spark, sf_dir))


@query(
    "detect_format_non_blank",
    f"""WITH {LOG}, text AS (SELECT * FROM log WHERE outcome <> 'blank'),
first AS (SELECT * FROM ({_FIRST_100.format('text')}) WHERE rn <= 100)
SELECT source_path, 'apache_access' AS format, count(*) FILTER (outcome = 'parsed') AS hits FROM first GROUP BY ALL""",
)
def detect_format_non_blank(spark, sf_dir):
    return detect.detect_format(access_log(spark, sf_dir), skip_blank=True)


@query(
    "with_fallback",
    f"""WITH {EV} SELECT DISTINCT source_path, CASE source_path WHEN 'app-0' THEN 'healthapp' ELSE 'universal' END AS format FROM ev""",
)
def with_fallback(spark, sf_dir):
    """Free text in three of the four sources."""
    raw = F.when(F.col("source_path") == "app-0", raw_line("healthapp")).otherwise(F.col("msg"))
    found = detect.detect_format(as_lines(events_frame(spark, sf_dir), raw))
    return detect.with_fallback(found).select("source_path", "format")


@query("force_format", f"WITH {EV} SELECT DISTINCT source_path, 'syslog' AS format FROM ev")
def force_format(spark, sf_dir):
    return detect.force_format(access_log(spark, sf_dir), "syslog")


@query(
    "format_catalogue",
    f"""WITH {EV}, used AS (SELECT CASE source_path WHEN 'app-0' THEN 'apache_access' WHEN 'app-1' THEN 'json'
                          WHEN 'app-2' THEN 'syslog' ELSE 'android' END AS name, count(*) AS lines FROM ev GROUP BY ALL),
names AS (SELECT * FROM (VALUES ('aws_cloudwatch', 0), ('gcp_logging', 1), ('azure_monitor', 2), ('docker_json', 3),
  ('kubernetes', 4), ('containerd', 5), ('apache_access', 6), ('apache_error', 7), ('nginx_access', 8), ('nginx', 9),
  ('json', 10), ('syslog', 11), ('android', 12), ('java_log', 13), ('hdfs', 14), ('supercomputer', 15), ('windows', 16),
  ('proxifier', 17), ('hpc', 18), ('healthapp', 19), ('openstack', 20), ('squid', 21), ('universal', 22)) t(name, priority))
SELECT name, priority, coalesce(lines, 0) AS lines FROM names LEFT JOIN used USING (name)""",
)
def format_catalogue(spark, sf_dir):
    """All formats with the number of log lines in each."""
    lines = mixed_log(spark, sf_dir)
    found = detect.detect_format(lines)
    used = (
        counts.count_lines(lines)
        .join(found, "source_path")
        .groupBy(F.col("format").alias("name"))
        .agg(F.sum("n").alias("lines"))
    )
    catalogue = detect.format_catalogue(spark)
    return catalogue.join(used, "name", "left").select("name", "priority", F.coalesce("lines", F.lit(0)).alias("lines"))


# --- entries and filters -------------------------------------------------------------------------


@query(
    "parse_entries",
    f"""WITH {EV} SELECT event_id AS line_id, source_path, CASE source_path WHEN 'app-0' THEN 'apache_access'
  WHEN 'app-1' THEN 'json' WHEN 'app-2' THEN 'syslog' ELSE 'android' END AS format, true AS parsed,
  CASE source_path WHEN 'app-0' THEN ip WHEN 'app-1' THEN ip WHEN 'app-2' THEN 'host' || user_id ELSE 'Tag' || user_id END AS source,
  CASE source_path WHEN 'app-0' THEN 'GET /' || event_type || '/' || user_id ELSE msg END AS message FROM ev""",
)
def parse_entries(spark, sf_dir):
    """Each source in its own detected format, one pass over the lines."""
    lines = mixed_log(spark, sf_dir)
    formats = materialize(detect.with_fallback(detect.detect_format(lines)))
    entries = ops.parse_entries(lines, formats)
    return entries.select("line_id", "source_path", "format", "parsed", "source", "message")


@query(
    "attach_format",
    f"""WITH {EV} SELECT CASE source_path WHEN 'app-0' THEN 'apache_access' WHEN 'app-1' THEN 'json'
  WHEN 'app-2' THEN 'syslog' ELSE 'android' END AS format, count(*) AS n FROM ev GROUP BY ALL""",
)
def attach_format(spark, sf_dir):
    lines = mixed_log(spark, sf_dir)
    formats = materialize(detect.detect_format(lines))
    return ops.attach_format(lines, formats).groupBy("format").agg(F.count(F.lit(1)).alias("n"))


@query(
    "attach_format_unlisted",
    f"""WITH {EV} SELECT source_path, CASE source_path WHEN 'app-0' THEN 'apache_access' ELSE 'universal' END AS format,
  count(*) AS n FROM ev GROUP BY ALL""",
)
def attach_format_unlisted(spark, sf_dir):
    """Lines of sources without a row in the format table stay, in the fallback format."""
    formats = spark.createDataFrame([("app-0", "apache_access")], "source_path string, format string")
    entries = ops.parse_entries(mixed_log(spark, sf_dir), formats)
    return entries.groupBy("source_path", "format").agg(F.count(F.lit(1)).alias("n"))


@query("drop_blank", f"WITH {LOG} SELECT source_path, count(*) AS n FROM log WHERE outcome <> 'blank' GROUP BY ALL")
def drop_blank(spark, sf_dir):
    return counts.count_lines(ops.drop_blank(access_log(spark, sf_dir)))


@query(
    "failed_lines_kept",
    f"""WITH {LOG} SELECT event_id AS line_id, 'INFO' AS level, 'noise ' || event_id AS message, false AS parsed
FROM log WHERE outcome = 'failed'""",
)
def failed_lines_kept(spark, sf_dir):
    return access_entries(spark, sf_dir).where("not parsed").select("line_id", "level", "message", "parsed")


@query(
    "min_level",
    f"""WITH {LOG} SELECT event_id AS line_id, level FROM ({_PARSED}) WHERE level = 'ERROR'
ORDER BY source_path, event_id LIMIT 20""",
)
def min_level(spark, sf_dir):
    return ops.min_level(access_entries(spark, sf_dir), "ERROR", 20).select("line_id", "level")


@query("level_in", f"WITH {LOG} SELECT event_id AS line_id, level FROM ({_PARSED}) WHERE level IN ('ERROR', 'WARNING')")
def level_in(spark, sf_dir):
    return ops.level_in(access_entries(spark, sf_dir).where("parsed"), ["ERROR", "WARNING"]).select("line_id", "level")


@query(
    "error_warning_flags",
    f"""WITH {LOG} SELECT count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level = 'WARNING') AS warnings
FROM ({_PARSED})""",
)
def error_warning_flags(spark, sf_dir):
    entries = access_entries(spark, sf_dir).where("parsed")
    return entries.agg(
        F.count_if(is_error(F.col("level"))).alias("errors"), F.count_if(is_warning(F.col("level"))).alias("warnings")
    )


@query(
    "regex_filter",
    r"""WITH l AS (SELECT 'doc-' || doc_id AS source_path, unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT source_path, count(*) AS n FROM l WHERE regexp_matches(raw, '[0-9]{2,}\.[0-9]') GROUP BY ALL""",
)
def regex_filter(spark, sf_dir):
    found = ops.regex_filter(document_lines(spark, sf_dir), r"[0-9]{2,}\.[0-9]")
    return counts.count_lines(found)


def _one_source(spark, sf_dir):
    """The access log as one source of many blocks."""
    events = events_frame(spark, sf_dir)
    lines = as_lines(events, access_raw(), F.lit("app"))
    return lines.withColumn("block_start", (F.floor(F.col("line_id") / 512) * 512).cast("bigint"))


_NUMBERED = "SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS line_no FROM log"


@query("number_lines", f"WITH {LOG} SELECT event_id AS line_id, line_no FROM ({_NUMBERED})")
def number_lines(spark, sf_dir):
    return ops.number_lines(_one_source(spark, sf_dir)).select("line_id", "line_no")


@query("from_line", f"WITH {LOG} SELECT event_id AS line_id FROM ({_NUMBERED}) WHERE line_no >= 500")
def from_line(spark, sf_dir):
    return ops.from_line(ops.number_lines(_one_source(spark, sf_dir)), 500).select("line_id")


@query(
    "replay_rows",
    f"""WITH {LOG}, t AS (SELECT count(*) AS total FROM log)
SELECT line_no, CASE WHEN outcome = 'parsed' THEN level ELSE 'INFO' END AS level,
       CASE WHEN outcome = 'parsed' THEN sec END AS ts,
       CASE WHEN outcome = 'parsed' THEN request ELSE 'noise ' || event_id END AS message,
       CASE WHEN outcome = 'parsed' THEN ip END AS source, outcome = 'parsed' AS parsed,
       round(line_no / greatest(total, 1), 6) AS progress
FROM ({_NUMBERED}), t WHERE outcome <> 'blank'""",
)
def replay_rows(spark, sf_dir):
    lines = _one_source(spark, sf_dir)
    numbered = ops.number_lines(lines)
    totals = counts.count_lines(lines).withColumnRenamed("n", "total_lines")
    places = numbered.select("source_path", "line_id", "line_no")
    entries = ops.parse_entries(numbered, fmt="apache_access").join(places, ["source_path", "line_id"])
    rows = ops.replay_rows(entries, materialize(totals))
    return rows.select("line_no", "level", "ts", "message", "source", "parsed", F.round("progress", 6).alias("progress"))


# --- counts --------------------------------------------------------------------------------------


@query(
    "line_counts",
    f"""WITH {LOG} SELECT source_path, count(*) AS total_lines, count(*) FILTER (outcome = 'blank') AS blank_lines,
  count(*) FILTER (outcome = 'parsed') AS parsed_lines, count(*) FILTER (outcome = 'failed') AS failed_lines
FROM log GROUP BY ALL""",
)
def line_counts(spark, sf_dir):
    return counts.line_counts(access_log(spark, sf_dir), access_entries(spark, sf_dir))


@query("level_counts", f"WITH {LOG} SELECT source_path, level, count(*) AS n FROM ({_PARSED}) GROUP BY ALL")
def level_counts(spark, sf_dir):
    return counts.level_counts(access_entries(spark, sf_dir))


@query(
    "status_counts",
    f"WITH {LOG} SELECT source_path, CAST(status AS VARCHAR) AS status, count(*) AS n FROM ({_PARSED}) GROUP BY ALL",
)
def status_counts(spark, sf_dir):
    return counts.status_counts(access_entries(spark, sf_dir)).select("source_path", "status", "n")


def _top(value: str, condition: str, k: int = 10) -> str:
    return f"""WITH {LOG}, c AS (SELECT source_path, {value} AS value, count(*) AS n, min(event_id) AS first
  FROM ({_PARSED}) WHERE {condition} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY n DESC, first) AS position FROM c)
SELECT source_path, position, value, n FROM r WHERE position <= {k}"""


@query("top_sources", _top("ip", "true"))
def top_sources(spark, sf_dir):
    top = counts.top_sources(access_entries(spark, sf_dir))
    return top.select("source_path", "position", F.col("source").alias("value"), "n")


@query("top_errors", _top("request", "level = 'ERROR'"))
def top_errors(spark, sf_dir):
    top = counts.top_errors(access_entries(spark, sf_dir))
    return top.select("source_path", "position", F.col("message").alias("value"), "n")


@query(
    "most_common",
    f"""WITH {LOG} SELECT ip AS source, count(*) AS n FROM ({_PARSED}) GROUP BY ALL
ORDER BY n DESC, min(event_id) LIMIT 10""",
)
def most_common(spark, sf_dir):
    """Top ten over all files together."""
    counted = access_entries(spark, sf_dir).where("parsed").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.min("line_id").alias("first_line")
    )
    return ranking.top_k(counted, [F.col("n").desc(), F.col("first_line")], 10).select("source", "n")


@query(
    "time_range",
    f"WITH {LOG} SELECT source_path, min(sec) AS earliest, max(sec) AS latest FROM ({_PARSED}) GROUP BY ALL",
)
def time_range(spark, sf_dir):
    ranges = counts.time_range(access_entries(spark, sf_dir))
    return ranges.select(
        "source_path",
        utc_wall_clock(F.col("earliest_ts")).alias("earliest"),
        utc_wall_clock(F.col("latest_ts")).alias("latest"),
    )


@query(
    "time_span",
    f"""WITH {LOG} SELECT source_path, CAST(epoch(max(sec)) - epoch(min(sec)) AS BIGINT) AS span_seconds
FROM ({_PARSED}) GROUP BY ALL""",
)
def time_span(spark, sf_dir):
    spans = counts.time_span(counts.time_range(access_entries(spark, sf_dir)))
    return spans.select("source_path", "span_seconds")


@query(
    "rates",
    f"""WITH {LOG} SELECT source_path,
  round(100.0 * count(*) FILTER (outcome = 'parsed' AND level = 'ERROR') / count(*) FILTER (outcome = 'parsed'), 6) AS error_rate,
  round(100.0 * count(*) FILTER (outcome = 'parsed') / count(*), 6) AS parse_success_rate FROM log GROUP BY ALL""",
)
def rates(spark, sf_dir):
    found = counts.rates(access_log(spark, sf_dir), access_entries(spark, sf_dir))
    return found.select("source_path", F.round("error_rate", 6).alias("error_rate"), F.round("parse_success_rate", 6).alias("parse_success_rate"))


def _sample(level: str, k: int) -> str:
    return f"""SELECT source_path, position, event_id AS line_id, level, request AS message FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY event_id) AS position
  FROM ({_PARSED}) WHERE level = '{level}') WHERE position <= {k}"""


_SAMPLE_COLUMNS = ("source_path", "position", "line_id", "level", "message")


@query("error_samples", f"WITH {LOG} {_sample('ERROR', 50)}")
def error_samples(spark, sf_dir):
    return counts.error_samples(access_entries(spark, sf_dir)).select(*_SAMPLE_COLUMNS)


@query("warning_samples", f"WITH {LOG} {_sample('WARNING', 50)}")
def warning_samples(spark, sf_dir):
    return counts.warning_samples(access_entries(spark, sf_dir)).select(*_SAMPLE_COLUMNS)


@query("severity_samples", f"WITH {LOG} {_sample('ERROR', 1000)} UNION ALL {_sample('WARNING', 1000)}")
def severity_samples(spark, sf_dir):
    """The largest sample size that is offered."""
    return counts.severity_samples(access_entries(spark, sf_dir), 1000).select(*_SAMPLE_COLUMNS)


@query("errors_and_warnings", f"WITH {LOG} {_sample('ERROR', 20)} UNION ALL {_sample('WARNING', 20)}")
def errors_and_warnings(spark, sf_dir):
    entries = access_entries(spark, sf_dir)
    both = counts.errors_and_warnings(counts.error_samples(entries, 20), counts.warning_samples(entries, 20))
    return both.select(*_SAMPLE_COLUMNS)


@query(
    "warning_messages",
    f"""WITH {LOG}, s AS ({_sample('WARNING', 50)}),
c AS (SELECT source_path, left(message, 100) AS message, count(*) AS n, min(line_id) AS first FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY n DESC, first) AS position FROM c)
SELECT source_path, position, message, n FROM r WHERE position <= 10""",
)
def warning_messages(spark, sf_dir):
    return counts.warning_messages(access_entries(spark, sf_dir)).select("source_path", "position", "message", "n")


@query(
    "approx_top",
    f"""WITH {LOG}, c AS (SELECT source_path, ip, count(*) AS n FROM ({_PARSED}) GROUP BY ALL)
SELECT source_path, position, n FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY n DESC) AS position FROM c)
WHERE position <= 10""",
)
def approx_top(spark, sf_dir):
    """With room for every value the estimate is exact; which of two equal values comes first is open."""
    return counts.approx_top(access_entries(spark, sf_dir), "source", 10, 100_000).select("source_path", "position", "n")


@query(
    "status_categories",
    f"""WITH {LOG} SELECT CAST(status AS VARCHAR) AS status, CASE status // 100 WHEN 2 THEN 'Success' WHEN 3 THEN 'Redirect'
  WHEN 4 THEN 'Client Error' ELSE 'Server Error' END AS category, count(*) AS n FROM ({_PARSED}) GROUP BY ALL""",
)
def status_categories(spark, sf_dir):
    entries = access_entries(spark, sf_dir).where("parsed")
    return entries.groupBy("status", status_category(F.col("status")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "level_from_status",
    f"""WITH {EV} SELECT event_id, level AS plain, CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARNING'
  WHEN status >= 300 THEN 'INFO' ELSE 'DEBUG' END AS verbose FROM ev""",
)
def level_from_status_query(spark, sf_dir):
    status = F.col("status").cast("string")
    return events_frame(spark, sf_dir).select(
        "event_id",
        level_from_status(status, "plain").alias("plain"),
        level_from_status(status, "verbose").alias("verbose"),
    )


@query(
    "level_rank",
    f"WITH {LOG} SELECT level, CASE level WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END AS rank, count(*) AS n FROM ({_PARSED}) GROUP BY ALL",
)
def level_rank_query(spark, sf_dir):
    entries = access_entries(spark, sf_dir).where("parsed")
    return entries.groupBy("level", level_rank(F.col("level")).alias("rank")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "map_level",
    """SELECT o_orderkey, CASE split_part(o_orderpriority, '-', 2) WHEN 'URGENT' THEN 'URGENT' ELSE 'INFO' END AS level,
       CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'P' THEN 'INFO' ELSE 'INFO' END AS letter FROM orders""",
)
def map_level_query(spark, sf_dir):
    """Known words map, unknown ones stay or take the default."""
    word = F.when(F.split("o_orderpriority", "-")[1] == "URGENT", "URGENT").otherwise("NOTICE")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        map_level(word, "gcp").alias("level"),
        map_level(F.col("o_orderstatus"), "android", "INFO").alias("letter"),
    )


@query(
    "rate_functions",
    """SELECT o_custkey, round(coalesce(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 0.0), 6) AS error_rate,
  round(100.0 * count(*) FILTER (o_orderstatus <> 'P') / count(*), 6) AS parse_success_rate FROM orders GROUP BY ALL""",
)
def rate_functions(spark, sf_dir):
    """Rates with zero denominators among the groups."""
    status = F.col("o_orderstatus")
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_if(status == "F").alias("errors"), F.count_if(status != "P").alias("parsed"), F.count(F.lit(1)).alias("total")
    )
    return grouped.select(
        "o_custkey",
        F.round(error_rate(F.col("errors"), F.col("parsed")), 6).alias("error_rate"),
        F.round(parse_success_rate(F.col("parsed"), F.col("total")), 6).alias("parse_success_rate"),
    )


# --- summaries -----------------------------------------------------------------------------------


def _summary(spark, sf_dir, **options):
    return plans.summarize(access_log(spark, sf_dir), **options)


_SUMMARY_SQL = f"""WITH {LOG} SELECT source_path, 'apache_access' AS detected_format, count(*) AS total_lines,
  count(*) FILTER (outcome = 'blank') AS blank_lines, count(*) FILTER (outcome = 'parsed') AS parsed_lines,
  count(*) FILTER (outcome = 'failed') AS failed_lines,
  round(100.0 * count(*) FILTER (outcome = 'parsed' AND level = 'ERROR') / count(*) FILTER (outcome = 'parsed'), 6) AS error_rate,
  round(100.0 * count(*) FILTER (outcome = 'parsed') / count(*), 6) AS parse_success_rate,
  min(sec) FILTER (outcome = 'parsed') AS earliest, max(sec) FILTER (outcome = 'parsed') AS latest,
  CAST(epoch(max(sec) FILTER (outcome = 'parsed')) - epoch(min(sec) FILTER (outcome = 'parsed')) AS BIGINT) AS span_seconds
FROM log GROUP BY ALL"""


def _summary_scalars(frame):
    return frame.select(
        "source_path",
        "detected_format",
        "total_lines",
        "blank_lines",
        "parsed_lines",
        "failed_lines",
        F.round("error_rate", 6).alias("error_rate"),
        F.round("parse_success_rate", 6).alias("parse_success_rate"),
        utc_wall_clock(F.col("earliest_ts")).alias("earliest"),
        utc_wall_clock(F.col("latest_ts")).alias("latest"),
        "span_seconds",
    )


@query("analyze", _SUMMARY_SQL)
def analyze(spark, sf_dir):
    return _summary_scalars(_summary(spark, sf_dir))


@query(
    "analyze_lists",
    f"""WITH {LOG}, s AS (SELECT source_path, ip AS value, count(*) AS n, min(event_id) AS first, 'source' AS kind FROM ({_PARSED}) GROUP BY ALL
  UNION ALL SELECT source_path, request, count(*), min(event_id), 'error' FROM ({_PARSED}) WHERE level = 'ERROR' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_path, kind ORDER BY n DESC, first) AS position FROM s)
SELECT source_path, kind, position, value, n FROM r WHERE position <= 10
UNION ALL SELECT source_path, 'level', NULL, level, count(*) FROM ({_PARSED}) GROUP BY ALL
UNION ALL SELECT source_path, 'status', NULL, CAST(status AS VARCHAR), count(*) FROM ({_PARSED}) GROUP BY ALL""",
)
def analyze_lists(spark, sf_dir):
    """Maps and lists of the summary in long form."""
    frame = _summary(spark, sf_dir, fmt="apache_access")
    def listed(kind, column, value):
        return frame.select("source_path", F.posexplode(column).alias("at", "x")).select(
            "source_path", F.lit(kind).alias("kind"), (F.col("at") + 1).cast("bigint").alias("position"),
            F.col(f"x.{value}").alias("value"), F.col("x.count").alias("n"),
        )
    def mapped(kind, column):
        return frame.select("source_path", F.explode(column).alias("value", "n")).select(
            "source_path", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("position"), "value", "n"
        )
    parts = [listed("source", "top_sources", "source"), listed("error", "top_errors", "message"),
             mapped("level", "level_counts"), mapped("status", "status_codes")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("analyze_samples", f"WITH {LOG} {_sample('ERROR', 100)} UNION ALL {_sample('WARNING', 100)}")
def analyze_samples(spark, sf_dir):
    frame = _summary(spark, sf_dir, k=100)
    def listed(column):
        return frame.select("source_path", F.posexplode(column).alias("at", "x")).select(
            "source_path", (F.col("at") + 1).cast("bigint").alias("position"), "x.line_id", "x.level", "x.message"
        )
    return listed("errors").unionByName(listed("warnings"))


@query(
    "regex_filter_named_group",
    r"""WITH l AS (SELECT 'doc-' || doc_id AS source_path, unnest(string_split(text, chr(10))) AS raw FROM documents)
SELECT source_path, count(*) AS n FROM l WHERE regexp_matches(raw, '(?P<word>[A-Z]{4})!!') GROUP BY ALL""",
)
def regex_filter_named_group(spark, sf_dir):
    """A pattern in Python's spelling."""
    return counts.count_lines(ops.regex_filter(document_lines(spark, sf_dir), r"(?P<the_word>[A-Z]{4})!!"))


@query(
    "analyze_mixed",
    f"""WITH {EV} SELECT source_path, CASE source_path WHEN 'app-0' THEN 'apache_access' WHEN 'app-1' THEN 'json'
  WHEN 'app-2' THEN 'syslog' ELSE 'android' END AS detected_format, count(*) AS total_lines, count(*) AS parsed_lines,
  min(CASE source_path WHEN 'app-0' THEN CASE WHEN user_id % 2 = 1 THEN sec - INTERVAL 150 MINUTE ELSE sec END WHEN 'app-1' THEN ts
      WHEN 'app-2' THEN CASE WHEN event_id % 3 = 0 THEN ms END END) AS earliest FROM ev GROUP BY ALL""",
)
def analyze_mixed(spark, sf_dir):
    """Four formats in one job."""
    frame = plans.summarize(mixed_log(spark, sf_dir))
    return frame.select(
        "source_path", "detected_format", "total_lines", "parsed_lines", utc_wall_clock(F.col("earliest_ts")).alias("earliest")
    )


@query(
    "analyze_files",
    f"""WITH {LOG} SELECT source_path, sum(1) FILTER (outcome = 'parsed')::BIGINT AS parsed_lines,
  sum(1) FILTER (outcome = 'failed')::BIGINT AS failed_lines, count(*) AS total_lines FROM log GROUP BY ALL""",
)
def analyze_files(spark, sf_dir):
    """The whole path from text files on disk."""
    frame = plans.analyze(spark, _written_log(spark, sf_dir))
    return frame.groupBy(_folder().alias("source_path")).agg(
        F.sum("parsed_lines").alias("parsed_lines"), F.sum("failed_lines").alias("failed_lines"), F.sum("total_lines").alias("total_lines")
    )


@query(
    "merge_summaries",
    f"""WITH {LOG}, p AS (SELECT * FROM log WHERE outcome = 'parsed'),
c AS (SELECT source_path, count(*) AS total_lines, count(*) FILTER (outcome = 'parsed') AS parsed_lines,
  count(*) FILTER (outcome = 'parsed' AND level = 'ERROR') AS errors, min(sec) FILTER (outcome = 'parsed') AS earliest,
  max(sec) FILTER (outcome = 'parsed') AS latest FROM log GROUP BY ALL),
s AS (SELECT source_path, list(ip || '=' || n ORDER BY n DESC, part, seen)[:10] AS top_sources FROM (
  SELECT source_path, ip, count(*) AS n, min(h) AS part, min(event_id) FILTER (h = first_h) AS seen FROM (
    SELECT *, (event_id // 64) % 2 AS h, min((event_id // 64) % 2) OVER (PARTITION BY source_path, ip) AS first_h FROM p)
  GROUP BY ALL) GROUP BY ALL),
e AS (SELECT source_path, list(event_id ORDER BY (event_id // 64) % 2, event_id)[:50] AS samples FROM p WHERE level = 'ERROR' GROUP BY ALL)
SELECT c.*, array_to_string(top_sources, ',') AS top_sources, coalesce(array_to_string(samples, ','), '') AS samples
FROM c LEFT JOIN s USING (source_path) LEFT JOIN e USING (source_path)""",
)
def merge_summaries(spark, sf_dir):
    """Two runs over alternate blocks of lines merged into one: counters, rankings and samples."""
    lines = access_log(spark, sf_dir)
    early = F.pmod(F.floor(F.col("line_id") / 64), F.lit(2)) == 0
    parts = [plans.summary_parts(lines.where(cut), fmt="apache_access") for cut in (early, ~early)]
    merged = plans.merge_summaries(parts)
    return merged.select(
        "source_path",
        "total_lines",
        "parsed_lines",
        F.coalesce(F.col("level_counts")["ERROR"], F.lit(0)).alias("errors"),
        utc_wall_clock(F.col("earliest_ts")).alias("earliest"),
        utc_wall_clock(F.col("latest_ts")).alias("latest"),
        F.array_join(F.transform("top_sources", lambda x: F.concat(x["source"], F.lit("="), x["count"])), ",").alias("top_sources"),
        F.array_join(F.transform("errors", lambda x: x["line_id"].cast("string")), ",").alias("samples"),
    )


@query("merge_tallies", _top("ip", "true"))
def merge_tallies(spark, sf_dir):
    """Exact rankings from tallies of two halves."""
    marked = access_log(spark, sf_dir).withColumn("format", F.lit("apache_access"))
    early = F.pmod(F.floor(F.col("line_id") / 64), F.lit(2)) == 0
    parts = [plans.tally(marked.where(cut), ["apache_access"]) for cut in (early, ~early)]
    sources = plans.merge_tallies(parts).where(F.col("kind") == "source")
    top = ranking.top_k(sources, [F.col("n").desc(), F.col("first_line")], 10, per="source_path", rank="position")
    return top.select("source_path", "position", F.col("key").alias("value"), "n")


@query(
    "universal_documents",
    """SELECT 'doc-' || doc_id AS source_path, count(*) FILTER (trim(l, E' \\t\\r\\n') <> '') AS n FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY ALL""",
)
def universal_documents(spark, sf_dir):
    """The fallback takes every line that is not blank."""
    from emberlog import formats as fm

    entries = fm.parse_universal(document_lines(spark, sf_dir))
    counted = entries.groupBy("source_path").agg(F.count(F.lit(1)).alias("n"))
    sources = document_lines(spark, sf_dir).select("source_path").distinct()
    return sources.join(counted, "source_path", "left").select("source_path", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "custom_format",
    f"WITH {EV} SELECT event_id AS line_id, upper(event_type) AS level, ip AS source, CAST(size AS VARCHAR) AS message, sec AS ts FROM ev",
)
def custom_format(spark, sf_dir):
    """A registered format wins detection and parses like a built-in one."""
    from emberlog import formats as fm

    registry = fm.FormatRegistry()
    raw = F.col("raw")
    fm.register_format(
        "kv",
        match=raw.rlike("^kind=\\w+ ip="),
        fields={
            "level": F.upper(F.regexp_extract(raw, "kind=(\\w+)", 1)),
            "source": F.regexp_extract(raw, "ip=([0-9.]+)", 1),
            "message": F.regexp_extract(raw, "cost=(\\d+)", 1),
            "stamp": F.concat(F.regexp_extract(raw, "at=(\\S+)", 1), F.lit("+00:00")),
        },
        registry=registry,
    )
    line = F.format_string(
        "kind=%s ip=%s cost=%d at=%s", F.col("event_type"), F.col("ip"), F.col("size"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    )
    lines = as_lines(events_frame(spark, sf_dir), line)
    formats = materialize(detect.detect_format(lines, registry=registry))
    entries = ops.parse_entries(lines, formats, registry=registry)
    return entries.select("line_id", "level", "source", "message", F.col("event_ts_local").alias("ts"))


@query("parse_python", f"WITH {EV} SELECT source_path, level, count(*) AS n FROM ev GROUP BY ALL")
def parse_python(spark, sf_dir):
    """The Python escape hatch over batches."""

    def read(batches):
        for pdf in batches:
            parts = pdf["raw"].str.split("|", n=2, expand=True)
            out = pdf.assign(format="piped", parsed=True, event_ts=None, event_ts_local=None, status=None, metadata=None)
            yield out.assign(level=parts[0], source=parts[1], message=parts[2])[
                ["source_path", "block_start", "line_id", "raw", "format", "parsed", "event_ts", "event_ts_local",
                 "level", "message", "source", "status", "metadata"]
            ]

    events = events_frame(spark, sf_dir)
    word = level_from_status(F.col("status").cast("string"))
    lines = as_lines(events, F.concat_ws("|", word, F.col("ip"), F.col("msg")))
    return ops.parse_python(lines, read).groupBy("source_path", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ellipsize",
    """SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS short FROM conversations""",
)
def ellipsize_query(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", ellipsize(F.col("text"), 100).alias("short"))


