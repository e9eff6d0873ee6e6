"""The result store: orders stand for analyses, line items for triages."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.plans import summary as plans
from emberlog.runtime import scratch_path
from emberlog.sources import reports, store

from .registry import query, table
from .render import LOG, access_log

# The same rows for the SQL twins.
A = """a AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'App-' || o_custkey || '.log' AS filename,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'json' WHEN '2-HIGH' THEN 'syslog' WHEN '3-MEDIUM' THEN 'nginx' ELSE 'apache_access' END AS detected_format,
  CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE round(o_totalprice / 10000, 2) END AS error_rate, o_orderdate AS created_at FROM orders)"""
T = """t AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
  CAST(l_orderkey AS VARCHAR) AS analysis_id, l_returnflag AS overall_severity, l_shipdate AS created_at FROM lineitem)"""


def analyses(spark, sf_dir):
    priority = F.col("o_orderpriority")
    fmt = (
        F.when(priority == "1-URGENT", "json")
        .when(priority == "2-HIGH", "syslog")
        .when(priority == "3-MEDIUM", "nginx")
        .otherwise("apache_access")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("App-"), F.col("o_custkey").cast("string"), F.lit(".log")).alias("filename"),
        fmt.alias("detected_format"),
        F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.round(F.col("o_totalprice") / 10000, 2)).alias("error_rate"),
        F.col("o_orderdate").alias("created_at"),
    )


def triages(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").cast("string").alias("analysis_id"),
        F.col("l_returnflag").alias("overall_severity"),
        F.col("l_shipdate").alias("created_at"),
    )


@query("by_format", f"WITH {A} SELECT * FROM a WHERE detected_format = 'json'")
def by_format(spark, sf_dir):
    return store.by_format(analyses(spark, sf_dir), "json")


@query("by_filename", f"WITH {A} SELECT * FROM a WHERE contains(lower(filename), 'pp-1')")
def by_filename(spark, sf_dir):
    return store.by_filename(analyses(spark, sf_dir), "PP-1")


@query("with_errors", f"WITH {A} SELECT * FROM a WHERE error_rate > 0")
def with_errors(spark, sf_dir):
    return store.with_errors(analyses(spark, sf_dir))


@query("by_id", f"WITH {A} SELECT * FROM a WHERE id = '42'")
def by_id(spark, sf_dir):
    return store.by_id(analyses(spark, sf_dir), "42")


@query("analyses_count", f"WITH {A} SELECT count(*) AS n FROM a WHERE detected_format = 'syslog'")
def analyses_count(spark, sf_dir):
    return store.analyses_count(analyses(spark, sf_dir), "syslog")


@query("distinct_formats", f"WITH {A} SELECT DISTINCT detected_format FROM a")
def distinct_formats(spark, sf_dir):
    return store.distinct_formats(analyses(spark, sf_dir))


@query("page", f"WITH {A} SELECT * FROM a ORDER BY created_at DESC, id LIMIT 20 OFFSET 40")
def page(spark, sf_dir):
    from emberlog.operators.ranking import page as page_of

    return page_of(analyses(spark, sf_dir), 40, 20)


@query("recent", f"WITH {A} SELECT * FROM a ORDER BY created_at DESC, id LIMIT 3")
def recent(spark, sf_dir):
    from emberlog.operators.ranking import recent as recent_of

    return recent_of(analyses(spark, sf_dir))


@query(
    "triages_of",
    f"""WITH {A}, {T} SELECT t.* FROM t WHERE analysis_id IN (SELECT id FROM a WHERE detected_format = 'json')""",
)
def triages_of(spark, sf_dir):
    chosen = store.by_format(analyses(spark, sf_dir), "json")
    return store.triages_of(chosen, triages(spark, sf_dir)).select("id", "analysis_id", "overall_severity", "created_at")


@query(
    "latest_triage",
    f"""WITH {A}, {T}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC, id DESC) AS r FROM t) WHERE r = 1)
SELECT a.id, a.filename, l.id AS triage_id, l.overall_severity FROM a LEFT JOIN l ON l.analysis_id = a.id""",
)
def latest_triage(spark, sf_dir):
    joined = store.latest_triage(analyses(spark, sf_dir), triages(spark, sf_dir))
    return joined.select(
        "id", "filename", F.col("triage.id").alias("triage_id"), F.col("triage.overall_severity").alias("overall_severity")
    )


@query(
    "cascade_delete",
    f"""WITH {A}, {T}, gone AS (SELECT id FROM a WHERE detected_format = 'nginx')
SELECT 'analysis' AS kind, count(*) AS n FROM a WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'triage', count(*) FROM t WHERE analysis_id NOT IN (SELECT id FROM gone)""",
)
def cascade_delete(spark, sf_dir):
    a, t = analyses(spark, sf_dir), triages(spark, sf_dir)
    kept_a, kept_t = store.cascade_delete(a, t, store.by_format(a, "nginx").select("id"))
    one = kept_a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("analysis").alias("kind"), "n")
    return one.unionByName(kept_t.agg(F.count(F.lit(1)).alias("n")).select(F.lit("triage").alias("kind"), "n"))


@query(
    "append_analyses",
    f"""WITH {LOG} SELECT source_path AS filename, 'apache_access' AS detected_format, count(*) AS total_lines,
  count(*) FILTER (outcome = 'parsed') AS parsed_lines, count(*) FILTER (outcome = 'parsed' AND level = 'ERROR') AS errors FROM log GROUP BY ALL""",
)
def append_analyses(spark, sf_dir):
    """Write a summary to the store and read it back."""
    root = scratch_path(spark, "store")
    store.append_analyses(plans.summarize(access_log(spark, sf_dir), fmt="apache_access"), root)
    rows = store.read_store(spark, root, "analyses")
    return rows.select(
        "filename",
        "detected_format",
        "total_lines",
        "parsed_lines",
        F.coalesce(F.col("level_counts")["ERROR"], F.lit(0)).alias("errors"),
    )


def _summary(spark, sf_dir, **options):
    return plans.summarize(access_log(spark, sf_dir), fmt="apache_access", **options)


@query(
    "summary_json",
    f"""WITH {LOG} SELECT source_path, count(*) AS total_lines, count(*) FILTER (outcome = 'parsed' AND level = 'ERROR') AS errors,
  strftime(min(sec) FILTER (outcome = 'parsed'), '%Y-%m-%dT%H:%M:%S') AS earliest FROM log GROUP BY ALL""",
)
def summary_json(spark, sf_dir):
    """Fields picked back out of the JSON documents."""
    documents = reports.summary_json(_summary(spark, sf_dir))
    return documents.select(
        "source_path",
        F.get_json_object("json", "$.metadata.total_lines").cast("bigint").alias("total_lines"),
        F.coalesce(F.get_json_object("json", "$.severity.ERROR").cast("bigint"), F.lit(0)).alias("errors"),
        F.get_json_object("json", "$.metadata.earliest_timestamp").alias("earliest"),
    )


@query(
    "csv_sections",
    f"""WITH {LOG}, p AS (SELECT * FROM log WHERE outcome = 'parsed'),
h AS (SELECT source_path, level AS key, count(*) AS n FROM p GROUP BY ALL)
SELECT source_path, 'severity' AS section, key, n FROM h
UNION ALL SELECT source_path, 'status', CAST(status AS VARCHAR), count(*) FROM p GROUP BY ALL""",
)
def csv_sections(spark, sf_dir):
    """Two sections written as CSV and read back."""
    path = scratch_path(spark, "csv")
    reports.write_csv_sections(_summary(spark, sf_dir), path)

    def read(section, key):
        frame = spark.read.option("header", True).csv(f"{path}/{section}")
        return frame.select(
            "source_path", F.lit(section).alias("section"), F.col(key).alias("key"), F.col("count").cast("bigint").alias("n")
        )

    return read("severity", "level").unionByName(read("status", "code"))


@query(
    "markdown_reports",
    f"""WITH {LOG} SELECT source_path, '| Total Lines | ' || format('{{:,}}', count(*)) || ' |' AS total_row,
  '| Failed Lines | ' || format('{{:,}}', count(*) FILTER (outcome = 'failed')) || ' |' AS failed_row,
  '| First Entry | ' || strftime(min(sec) FILTER (outcome = 'parsed'), '%Y-%m-%d %H:%M:%S') || ' |' AS first_row FROM log GROUP BY ALL""",
)
def markdown_reports(spark, sf_dir):
    """Three rows of every report."""
    texts = reports.markdown_reports(_summary(spark, sf_dir, analytics=True))
    return texts.select(
        "source_path",
        F.regexp_extract("text", r"\| Total Lines \| [0-9,]+ \|", 0).alias("total_row"),
        F.regexp_extract("text", r"\| Failed Lines \| [0-9,]+ \|", 0).alias("failed_row"),
        F.regexp_extract("text", r"\| First Entry \| [0-9: -]+ \|", 0).alias("first_row"),
    )


@query(
    "write_report",
    f"""WITH {LOG}, s AS (SELECT source_path, count(*) AS n FROM log GROUP BY ALL)
SELECT count(*) AS reports, count(*) AS overviews, sum(n)::BIGINT AS total_lines FROM s""",
)
def write_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    reports.write_report(_summary(spark, sf_dir), path)
    lines = spark.read.text(path)
    total = F.regexp_extract("value", r"^\W*Total [Ll]ines\W+([0-9,]+)", 1)
    return lines.agg(
        F.count_distinct("report").alias("reports"),
        F.count_if(F.col("value") == "## Overview").alias("overviews"),
        F.sum(F.when(total != "", F.regexp_replace(total, ",", "").cast("bigint"))).alias("total_lines"),
    )


@query(
    "export_json",
    f"""WITH {A}, {T}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY analysis_id ORDER BY created_at DESC, id DESC) AS r FROM t) WHERE r = 1)
SELECT a.id, a.filename, l.id AS triage_id FROM a LEFT JOIN l ON l.analysis_id = a.id""",
)
def export_json(spark, sf_dir):
    """Analyses with their latest triage as JSON documents."""
    none = F.lit(None).cast("string")
    full = analyses(spark, sf_dir)
    for name in ("level_counts", "top_errors", "top_sources", "status_codes", "time_span"):
        full = full.withColumn(name, none)
    for name in ("total_lines", "parsed_lines", "failed_lines", "parse_success_rate"):
        full = full.withColumn(name, F.lit(0))
    full = full.withColumn("created_at", F.col("created_at").cast("timestamp"))
    full = full.withColumn("earliest_ts", F.col("created_at")).withColumn("latest_ts", F.col("created_at"))
    documents = reports.export_json(full, triages(spark, sf_dir))
    return documents.select(
        "id",
        F.get_json_object("json", "$.filename").alias("filename"),
        F.get_json_object("json", "$.triage.id").alias("triage_id"),
    )
