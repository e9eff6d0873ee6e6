"""Time-series, rankings of buckets, and the frames behind reports and charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import activity_class, bucket_label, cloud_ts, rate_class, utc_wall_clock
from emberlog.operators import ranking, tables, timeseries as ts
from emberlog.operators.counts import level_counts, severity_samples, status_counts
from emberlog.plans import summary as plans

from .registry import query, table
from .render import EV, LOG, access_entries, access_log, events_frame, rendered, stamp

_P = "(SELECT * FROM log WHERE outcome = 'parsed')"
_BUCKET = {
    "5min": "time_bucket(INTERVAL 5 MINUTE, sec)",
    "15min": "time_bucket(INTERVAL 15 MINUTE, sec)",
    "1h": "date_trunc('hour', sec)",
    "1day": "date_trunc('day', sec)",
}


def _parsed(spark, sf_dir):
    return access_entries(spark, sf_dir).where("parsed")


def _register_buckets(size: str) -> None:
    @query(
        f"temporal_distribution_{size}",
        f"WITH {LOG} SELECT source_path, CAST({_BUCKET[size]} AS TIMESTAMP) AS bucket, count(*) AS n FROM {_P} GROUP BY ALL",
    )
    def run(spark, sf_dir):
        return ts.temporal_distribution(_parsed(spark, sf_dir), size)


for _size in _BUCKET:
    _register_buckets(_size)


@query(
    "temporal_distribution_unknown_size",
    f"WITH {LOG} SELECT source_path, date_trunc('hour', sec) AS bucket, count(*) AS n FROM {_P} GROUP BY ALL",
)
def temporal_distribution_unknown_size(spark, sf_dir):
    return ts.temporal_distribution(_parsed(spark, sf_dir), "2weeks")


@query(
    "temporal_distribution_written_clock",
    f"WITH {EV} SELECT source_path, date_trunc('hour', sec) AS bucket, count(*) AS n FROM ev GROUP BY ALL",
)
def temporal_distribution_written_clock(spark, sf_dir):
    """Lines with different offsets are bucketed by the clock they show."""
    from emberlog import formats as fm

    return ts.temporal_distribution(fm.parse_nginx(rendered(spark, sf_dir, "nginx")), "1h")


@query(
    "hourly_distribution",
    f"WITH {LOG} SELECT source_path, CAST(hour(sec) AS INTEGER) AS hour, count(*) AS n FROM {_P} GROUP BY ALL",
)
def hourly_distribution(spark, sf_dir):
    return ts.hourly_distribution(_parsed(spark, sf_dir))


_DAYS = f"b AS (SELECT source_path, date_trunc('day', sec) AS bucket, count(*) AS n FROM {_P} GROUP BY ALL)"
_HOURS = f"b AS (SELECT source_path, date_trunc('hour', sec) AS bucket, count(*) AS n FROM {_P} GROUP BY ALL)"
_HOUR_OF_DAY = f"h AS (SELECT source_path, hour(sec) AS hour, count(*) AS n FROM {_P} GROUP BY ALL)"


@query(
    "trend",
    f"""WITH {LOG}, {_DAYS}, x AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY bucket) AS i FROM b),
s AS (SELECT source_path, coalesce(regr_slope(n, i), 0) AS slope FROM x GROUP BY ALL)
SELECT source_path, round(slope, 6) AS slope,
  CASE WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS direction FROM s""",
)
def trend(spark, sf_dir):
    found = ts.trend(ts.temporal_distribution(_parsed(spark, sf_dir), "1day"))
    return found.select("source_path", F.round("slope", 6).alias("slope"), "direction")


@query(
    "trend_orders",
    """WITH b AS (SELECT o_orderpriority AS source_path, o_orderdate AS bucket, count(*) AS n FROM orders GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY bucket) AS i FROM b)
SELECT source_path, round(regr_slope(n, i), 8) AS slope FROM x GROUP BY ALL""",
)
def trend_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source_path"), F.col("o_orderdate").alias("event_ts_local")
    )
    return ts.trend(ts.temporal_distribution(orders, "1day")).select("source_path", F.round("slope", 8).alias("slope"))


@query(
    "peak_period",
    f"""WITH {LOG}, {_HOURS} SELECT source_path, bucket, n FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY n DESC, bucket) AS r FROM b) WHERE r = 1""",
)
def peak_period(spark, sf_dir):
    return ts.peak_period(ts.temporal_distribution(_parsed(spark, sf_dir), "1h"))


@query(
    "active_hours",
    f"WITH {LOG} SELECT source_path, count(DISTINCT hour(sec)) AS active_hours FROM {_P} GROUP BY ALL",
)
def active_hours(spark, sf_dir):
    return ts.active_hours(ts.hourly_distribution(_parsed(spark, sf_dir)))


def _analytics_sql(rows: str) -> str:
    return f"""WITH {LOG}, p AS ({rows}),
b AS (SELECT source_path, date_trunc('hour', sec) AS bucket, count(*) AS n FROM p GROUP BY ALL),
x AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY bucket) AS i FROM b),
s AS (SELECT source_path, coalesce(regr_slope(n, i), 0) AS slope, arg_max(bucket, n * 1000000 - i) AS peak_period,
        count(*) AS buckets, sum(n)::BIGINT AS stamped FROM x GROUP BY ALL),
h AS (SELECT source_path, count(DISTINCT hour(sec)) AS hours FROM p GROUP BY ALL)
SELECT source_path, CASE WHEN slope > 0.1 THEN 'increasing' WHEN slope < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend_direction,
  peak_period, buckets, stamped, hours FROM s JOIN h USING (source_path)"""


def _analytics_columns(frame):
    return frame.select(
        "source_path",
        "trend_direction",
        "peak_period",
        F.size("temporal").cast("bigint").alias("buckets"),
        F.aggregate("temporal", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("stamped"),
        F.size("hourly").cast("bigint").alias("hours"),
    )


_SAMPLED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path, level ORDER BY event_id) AS r
  FROM log WHERE outcome = 'parsed' AND level IN ('ERROR', 'WARNING')) WHERE r <= 50"""


@query("analytics", _analytics_sql(_SAMPLED))
def analytics(spark, sf_dir):
    """Over the collected errors and warnings."""
    return _analytics_columns(ts.analytics(access_entries(spark, sf_dir)))


@query("analytics_all", _analytics_sql(f"SELECT * FROM {_P}"))
def analytics_all(spark, sf_dir):
    return _analytics_columns(ts.analytics(access_entries(spark, sf_dir), scope="all"))


@query("analyze_with_analytics", _analytics_sql(f"SELECT * FROM {_P} WHERE level IN ('ERROR', 'WARNING')"))
def analyze_with_analytics(spark, sf_dir):
    """Over all errors and warnings."""
    return _analytics_columns(plans.summarize(access_log(spark, sf_dir), fmt="apache_access", analytics=True))


# --- rankings ------------------------------------------------------------------------------------


def _last(k: int) -> str:
    return f"""WITH {LOG}, {_HOURS}, l AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY bucket DESC) AS r FROM b) WHERE r <= {k})
SELECT source_path, bucket, n, row_number() OVER (PARTITION BY source_path ORDER BY bucket) AS position FROM l"""


@query("last_buckets", _last(10))
def last_buckets(spark, sf_dir):
    return ranking.last_buckets(ts.temporal_distribution(_parsed(spark, sf_dir)), 10)


@query("last_buckets_chart", _last(50))
def last_buckets_chart(spark, sf_dir):
    return ranking.last_buckets(ts.temporal_distribution(_parsed(spark, sf_dir)), 50)


@query(
    "busiest_buckets",
    f"""WITH {LOG}, {_HOURS} SELECT * FROM (SELECT source_path, bucket, n,
  row_number() OVER (PARTITION BY source_path ORDER BY n DESC, bucket) AS position FROM b) WHERE position <= 5""",
)
def busiest_buckets(spark, sf_dir):
    return ranking.busiest(ts.temporal_distribution(_parsed(spark, sf_dir)), 5, "bucket")


@query(
    "busiest_hours",
    f"""WITH {LOG}, {_HOUR_OF_DAY} SELECT * FROM (SELECT source_path, CAST(hour AS INTEGER) AS hour, n,
  row_number() OVER (PARTITION BY source_path ORDER BY n DESC, hour) AS position FROM h) WHERE position <= 3""",
)
def busiest_hours(spark, sf_dir):
    return ranking.busiest(ts.hourly_distribution(_parsed(spark, sf_dir)), 3, "hour")


@query(
    "top_status",
    f"""WITH {LOG}, c AS (SELECT source_path, CAST(status AS VARCHAR) AS status, count(*) AS n, min(event_id) AS first FROM {_P} GROUP BY ALL)
SELECT source_path, status, n, position FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY n DESC, first, status) AS position
  FROM c) WHERE position <= 10""",
)
def top_status(spark, sf_dir):
    top = ranking.top_status(status_counts(access_entries(spark, sf_dir)))
    return top.select("source_path", "status", "n", "position")


@query(
    "severity_order",
    f"""WITH {LOG} SELECT source_path, level, count(*) AS n, CASE level WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END AS severity
FROM {_P} GROUP BY ALL""",
)
def severity_order(spark, sf_dir):
    return ranking.severity_order(level_counts(access_entries(spark, sf_dir)))


# --- report and chart frames ---------------------------------------------------------------------


def _summary(spark, sf_dir, **options):
    return plans.summarize(access_log(spark, sf_dir), fmt="apache_access", **options)


_SPAN = "CAST(epoch(max(sec) FILTER (outcome = 'parsed')) - epoch(min(sec) FILTER (outcome = 'parsed')) AS BIGINT)"


@query(
    "overview",
    f"""WITH {LOG}, s AS (SELECT source_path, count(*) AS total, count(*) FILTER (outcome = 'parsed') AS parsed,
  count(*) FILTER (outcome = 'failed') AS failed, min(sec) FILTER (outcome = 'parsed') AS lo, max(sec) FILTER (outcome = 'parsed') AS hi,
  {_SPAN} AS span FROM log GROUP BY ALL)
SELECT source_path, 1 AS position, 'Total Lines' AS metric, format('{{:,}}', total) AS value FROM s
UNION ALL SELECT source_path, 2, 'Parsed Lines', format('{{:,}}', parsed) FROM s
UNION ALL SELECT source_path, 3, 'Failed Lines', format('{{:,}}', failed) FROM s
UNION ALL SELECT source_path, 6, 'First Entry', strftime(lo, '%Y-%m-%d %H:%M:%S') FROM s
UNION ALL SELECT source_path, 7, 'Last Entry', strftime(hi, '%Y-%m-%d %H:%M:%S') FROM s
UNION ALL SELECT source_path, 8, 'Time Span', CASE WHEN span // 86400 = 0 THEN '' WHEN span // 86400 = 1 THEN '1 day, '
    ELSE (span // 86400) || ' days, ' END || (span % 86400 // 3600) || ':' || lpad(CAST(span % 3600 // 60 AS VARCHAR), 2, '0')
    || ':' || lpad(CAST(span % 60 AS VARCHAR), 2, '0') FROM s""",
)
def overview(spark, sf_dir):
    """The two rates are compared as numbers in ``analyze``; here the other rows."""
    rows = tables.overview(_summary(spark, sf_dir))
    return rows.where(~F.col("metric").endswith("Rate"))


@query(
    "severity_table",
    f"""WITH {LOG}, c AS (SELECT source_path, level, count(*) AS n FROM {_P} GROUP BY ALL)
SELECT source_path, CASE level WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 3 ELSE 4 END AS position, level, n,
  round(100.0 * n / sum(n) OVER (PARTITION BY source_path), 6) AS pct FROM c""",
)
def severity_table(spark, sf_dir):
    rows = tables.severity_table(_summary(spark, sf_dir))
    return rows.withColumn("pct", F.round("pct", 6))


@query(
    "status_table",
    f"""WITH {LOG} SELECT source_path, CAST(status AS VARCHAR) AS code, count(*) AS n, CASE status // 100 WHEN 2 THEN 'Success'
  WHEN 3 THEN 'Redirect' WHEN 4 THEN 'Client Error' ELSE 'Server Error' END AS category FROM {_P} GROUP BY ALL""",
)
def status_table(spark, sf_dir):
    return tables.status_table(_summary(spark, sf_dir))


_RANKED = f"""c AS (SELECT source_path, 'source' AS kind, ip AS value, count(*) AS n, min(event_id) AS first FROM {_P} GROUP BY ALL
  UNION ALL SELECT source_path, 'error', request, count(*), min(event_id) FROM {_P} WHERE level = 'ERROR' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_path, kind ORDER BY n DESC, first) AS position FROM c)"""


@query("top_tables", f"WITH {LOG}, {_RANKED} SELECT source_path, kind, position, left(value, 80) AS value, n FROM r WHERE position <= 10")
def top_tables(spark, sf_dir):
    return tables.top_tables(_summary(spark, sf_dir))


@query(
    "top_display",
    f"WITH {LOG}, {_RANKED} SELECT source_path, position, value AS message, n FROM r WHERE kind = 'error' AND position <= 5",
)
def top_display(spark, sf_dir):
    return tables.top_display(_summary(spark, sf_dir))


@query(
    "hourly_table",
    f"""WITH {LOG}, {_HOUR_OF_DAY} SELECT source_path, CAST(hour AS INTEGER) AS hour, n,
  round(n / max(n) OVER (PARTITION BY source_path), 6) AS share FROM h""",
)
def hourly_table(spark, sf_dir):
    rows = tables.hourly_table(ts.hourly_distribution(_parsed(spark, sf_dir)))
    return rows.withColumn("share", F.round("share", 6))


@query(
    "recent_table",
    f"""WITH {LOG}, {_HOURS}, l AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY bucket DESC) AS r FROM b) WHERE r <= 10)
SELECT source_path, row_number() OVER (PARTITION BY source_path ORDER BY bucket) AS position,
  strftime(bucket, '%m-%d %H:%M') AS label, n, round(n / max(n) OVER (PARTITION BY source_path), 6) AS share FROM l""",
)
def recent_table(spark, sf_dir):
    rows = tables.recent_table(ts.temporal_distribution(_parsed(spark, sf_dir)))
    return rows.withColumn("share", F.round("share", 6))


@query(
    "chart_series",
    f"""WITH {LOG}, {_HOURS}, {_HOUR_OF_DAY}, l AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY bucket DESC) AS r FROM b) WHERE r <= 50)
SELECT source_path, 'temporal' AS series, row_number() OVER (PARTITION BY source_path ORDER BY bucket) AS position,
  strftime(bucket, '%m-%d %H:%M') AS label, n, NULL AS activity FROM l
UNION ALL SELECT source_path, 'hourly', row_number() OVER (PARTITION BY source_path ORDER BY hour), lpad(CAST(hour AS VARCHAR), 2, '0') || ':00', n,
  CASE WHEN n / max(n) OVER (PARTITION BY source_path) >= 0.8 THEN 'peak'
       WHEN n / max(n) OVER (PARTITION BY source_path) >= 0.5 THEN 'high' ELSE 'normal' END FROM h""",
)
def chart_series(spark, sf_dir):
    entries = _parsed(spark, sf_dir)
    return tables.chart_series(ts.temporal_distribution(entries), ts.hourly_distribution(entries))


@query(
    "severity_chart",
    f"""WITH {LOG}, c AS (SELECT source_path, level, count(*) AS n FROM {_P} GROUP BY ALL)
SELECT source_path, level, n, round(100.0 * n / sum(n) OVER (PARTITION BY source_path), 6) AS pct,
  CASE level WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END AS severity FROM c""",
)
def severity_chart(spark, sf_dir):
    rows = tables.severity_chart(level_counts(access_entries(spark, sf_dir)))
    return rows.withColumn("pct", F.round("pct", 6))


# --- functions -----------------------------------------------------------------------------------


@query("bucket_label", "SELECT event_id, strftime(ts, '%m-%d %H:%M') AS label FROM events")
def bucket_label_query(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", bucket_label(F.col("ts")).alias("label"))


@query(
    "activity_class",
    """SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.8 THEN 'peak' WHEN o_totalprice / 500000 >= 0.5 THEN 'high' ELSE 'normal' END AS activity
FROM orders""",
)
def activity_class_query(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", activity_class(F.col("o_totalprice") / 500000).alias("activity")
    )


@query(
    "rate_class",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity * 2 >= 90 THEN 'success' WHEN l_quantity * 2 >= 70 THEN 'warning' ELSE 'error' END AS list_class,
  CASE WHEN l_quantity * 2 >= 95 THEN 'success' WHEN l_quantity * 2 >= 80 THEN 'warning' ELSE 'error' END AS detail_class,
  CASE WHEN l_discount * 100 <= 1 THEN 'success' WHEN l_discount * 100 <= 5 THEN 'warning' ELSE 'error' END AS error_class FROM lineitem""",
)
def rate_class_query(spark, sf_dir):
    rate, errors = F.col("l_quantity") * 2, F.col("l_discount") * 100
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        rate_class(rate, "success_list").alias("list_class"),
        rate_class(rate, "success_detail").alias("detail_class"),
        rate_class(errors, "error").alias("error_class"),
    )


@query(
    "cloud_ts",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN date_trunc('millisecond', ts) WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN ts WHEN 3 THEN date_trunc('second', ts) - INTERVAL 90 MINUTE END AS utc FROM events""",
)
def cloud_ts_query(spark, sf_dir):
    """Epoch milliseconds, seconds, nanoseconds, offset; a fraction with an offset is refused."""
    kind = F.pmod("event_id", F.lit(5))
    text = (
        F.when(kind == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string"))
        .when(kind == 1, stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(kind == 2, stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'123Z'"))
        .when(kind == 3, stamp("yyyy-MM-dd'T'HH:mm:ss'+01:30'"))
        .otherwise(stamp("yyyy-MM-dd'T'HH:mm:ss.SSS'+01:30'"))
    )
    return table(spark, sf_dir, "events").select("event_id", utc_wall_clock(cloud_ts(text)).alias("utc"))


@query(
    "severity_sample_totals",
    f"WITH {LOG} SELECT source_path, CASE level WHEN 'ERROR' THEN 'error' ELSE 'warning' END AS kind, count(*) AS n FROM ({_SAMPLED}) GROUP BY ALL",
)
def severity_sample_totals(spark, sf_dir):
    samples = severity_samples(access_entries(spark, sf_dir))
    return samples.groupBy("source_path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("event_messages", f"WITH {EV} SELECT event_id, msg FROM ev")
def event_messages(spark, sf_dir):
    """The rendered message itself equals its SQL form."""
    return events_frame(spark, sf_dir).select("event_id", "msg")
