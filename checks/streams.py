"""Streaming queries run to the end of their input and compared with the batch answer."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.plans.summary import merge_tallies
from emberlog.runtime import materialize, scratch_path
from emberlog.streaming import live
from emberlog.streaming.alerts import sustained_alert as lasting_rate
from emberlog.streaming.growing import growing_lines

from .registry import query, table
from .render import EV, LOG, access_entries, access_raw, events_frame, mixed_log

_P = "(SELECT * FROM log WHERE outcome = 'parsed')"


def _landed(spark, sf_dir: str) -> str:
    """The access log as text files in one directory."""
    path = scratch_path(spark, "landing")
    events_frame(spark, sf_dir).select(access_raw().alias("value")).write.text(path)
    return path


def _entries(spark, sf_dir):
    lines = live.stream_raw(spark, _landed(spark, sf_dir))
    return live.stream_entries(lines, fmt="apache_access")


def _append(stream):
    """Run an append-mode stream into files and read them."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")
    running = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(out), running


def _last_state(stream, mode: str = "complete"):
    """Run an aggregating stream; the last complete result per run is what counts."""
    spark = stream.sparkSession
    out = scratch_path(spark, "stream")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(out)

    running = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_lines",
    f"""WITH {LOG} SELECT source, count(*) AS n FROM (SELECT CASE WHEN outcome = 'failed' THEN 'noise' ELSE ip END AS source FROM log
  WHERE outcome = 'parsed' AND contains(request, 'error') OR outcome = 'failed') GROUP BY ALL""",
)
def stream_lines(spark, sf_dir):
    """Tail with a pattern: error requests and noise lines, blank lines dropped."""
    rows, _ = _append(live.stream_lines(spark, _landed(spark, sf_dir), "/error/|^noise"))
    return rows.groupBy(F.substring_index("raw", " ", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "replay",
    f"""WITH {LOG} SELECT CASE WHEN outcome = 'parsed' THEN level ELSE 'INFO' END AS level, CASE WHEN outcome = 'parsed' THEN sec END AS ts,
  CASE WHEN outcome = 'parsed' THEN request ELSE 'noise ' || event_id END AS message, CASE WHEN outcome = 'parsed' THEN ip END AS source,
  outcome = 'parsed' AS parsed FROM log WHERE outcome <> 'blank'""",
)
def replay(spark, sf_dir):
    rows, _ = _append(live.replay(spark, _landed(spark, sf_dir), fmt="apache_access"))
    return rows.select("level", "ts", "message", "source", "parsed")


@query("stream_level_counts", f"WITH {LOG} SELECT level, count(*) AS n FROM {_P} GROUP BY ALL")
def stream_level_counts(spark, sf_dir):
    return _last_state(live.stream_counts(_entries(spark, sf_dir), "level"))


@query("stream_source_counts", f"WITH {LOG} SELECT ip AS source, count(*) AS n FROM {_P} GROUP BY ALL")
def stream_source_counts(spark, sf_dir):
    return _last_state(live.stream_counts(_entries(spark, sf_dir), "source"))


@query("stream_buckets", f"WITH {LOG} SELECT date_trunc('hour', sec) AS bucket, count(*) AS n FROM {_P} GROUP BY ALL")
def stream_buckets(spark, sf_dir):
    buckets = _last_state(live.stream_buckets(_entries(spark, sf_dir), "1h", "40 days"))
    return buckets.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


@query(
    "burst_alert",
    f"""WITH {LOG} SELECT * FROM (SELECT date_trunc('day', sec) AS bucket, count(*) AS n FROM {_P} WHERE level = 'ERROR' GROUP BY ALL) WHERE n > 5""",
)
def burst_alert(spark, sf_dir):
    """Days with more than five errors."""
    buckets = live.stream_buckets(_entries(spark, sf_dir), "1day", "40 days", errors_only=True)
    alerts = _last_state(live.burst_alert(buckets, 5))
    return alerts.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n")


_RUNS = f"""WITH {LOG}, hours AS (SELECT level, date_trunc('hour', sec) AS h, count(*) AS n FROM {_P} GROUP BY ALL
  HAVING count(*) > (SELECT count(*) FROM events) // 1800),
r AS (SELECT *, h - INTERVAL 1 HOUR * row_number() OVER (PARTITION BY level ORDER BY h) AS run FROM hours),
k AS (SELECT *, row_number() OVER (PARTITION BY level, run ORDER BY h) AS k, lead(h) OVER (PARTITION BY level, run ORDER BY h) AS next,
  sum(n) OVER (PARTITION BY level, run ORDER BY h ROWS 2 PRECEDING) AS last FROM r),
found AS (SELECT level, 'firing' AS state, h + INTERVAL 1 HOUR AS "at", last AS n, h + INTERVAL 1 HOUR AS known FROM k WHERE k = 3
  UNION ALL SELECT level, 'resolved', h + INTERVAL 1 HOUR, last, h + INTERVAL 2 HOUR FROM k WHERE k >= 3 AND next IS NULL)
SELECT level, state, "at", CAST(n AS BIGINT) AS n FROM found"""


@query("sustained_alert", f"{_RUNS} WHERE known <= (SELECT max(sec) - INTERVAL 2 HOUR FROM {_P})")
def sustained_alert(spark, sf_dir):
    """Per level, rates of more than a fixed share of all events an hour that last three hours: start and end."""
    threshold = table(spark, sf_dir, "events").count() // 1800
    alerts = lasting_rate(_entries(spark, sf_dir), threshold, 3, 3600, "2 hours", ("level",), errors_only=False)
    rows, _ = _append(alerts)
    return rows.select("level", "state", F.col("at").cast("timestamp_ntz").alias("at"), "n")


@query("sustained_alert_batch", _RUNS)
def sustained_alert_batch(spark, sf_dir):
    """The same over stored entries, where every run is decided."""
    threshold = table(spark, sf_dir, "events").count() // 1800
    alerts = lasting_rate(access_entries(spark, sf_dir), threshold, 3, 3600, "2 hours", ("level",), errors_only=False)
    return alerts.select("level", "state", F.col("at").cast("timestamp_ntz").alias("at"), "n")


@query(
    "stream_summary",
    f"""WITH {LOG} SELECT 'line' AS kind, outcome AS key, count(*) AS n FROM log GROUP BY ALL
UNION ALL SELECT 'level', level, count(*) FROM {_P} GROUP BY ALL UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM {_P} GROUP BY ALL
UNION ALL SELECT 'source', ip, count(*) FROM {_P} GROUP BY ALL UNION ALL SELECT 'error', request, count(*) FROM {_P} WHERE level = 'ERROR' GROUP BY ALL""",
)
def stream_summary(spark, sf_dir):
    """Tallies written per micro-batch of two files, merged at the end."""
    out = scratch_path(spark, "tallies")
    lines = live.stream_raw(spark, _landed(spark, sf_dir), files_per_trigger=2)
    live.tally_batches(lines, "apache_access", out, scratch_path(spark, "offsets")).awaitTermination()
    one = live.merged_tallies(spark, out).withColumn("source_path", F.lit("all"))
    return merge_tallies([one]).select("kind", "key", "n")


@query("progress_metrics", "SELECT count(*) AS input_rows FROM events")
def progress_metrics(spark, sf_dir):
    """Rows read by a tail over the access log, summed over its micro-batches."""
    log = live.ProgressLog()
    spark.streams.addListener(log)
    try:
        _, running = _append(live.stream_lines(spark, _landed(spark, sf_dir), None))
        return log.metrics(running).agg(F.sum("input_rows").alias("input_rows"))
    finally:
        spark.streams.removeListener(log)


def _append_files(path: str, more: str) -> None:
    """Append the n-th text file of one local folder to the n-th of another, without its last line end."""
    local = fs.LocalFileSystem()
    names = [sorted(f.path for f in local.get_file_info(fs.FileSelector(p)) if f.base_name.startswith("part-")) for p in (path, more)]
    for old, new in zip(*names):
        with local.open_input_stream(new) as source, local.open_append_stream(old) as out:
            out.write(source.read())


def _in_two_parts(spark, sf_dir: str) -> tuple[str, str]:
    """Access log of even and of odd events, four files each."""
    log = events_frame(spark, sf_dir).select("event_id", access_raw().alias("value"))
    paths = scratch_path(spark, "growing"), scratch_path(spark, "more")
    for k, path in enumerate(paths):
        log.where(F.pmod("event_id", F.lit(2)) == k).select("value").repartition(4).write.text(path)
    return paths


@query(
    "tail_growing",
    f"""WITH {LOG} SELECT batch, source, count(*) AS n FROM (
  SELECT event_id % 2 AS batch, CASE WHEN outcome = 'failed' THEN 'noise' ELSE ip END AS source FROM log WHERE outcome <> 'blank') GROUP BY ALL""",
)
def tail_growing(spark, sf_dir):
    """Files that double between two runs of one tail: each run brings its own half."""
    (path, more), out, offsets = _in_two_parts(spark, sf_dir), scratch_path(spark, "tail"), scratch_path(spark, "offsets")

    def run(k: int) -> None:
        def sink(rows, batch_id):
            rows.withColumn("batch", F.lit(k)).write.mode("overwrite").parquet(f"{out}/run={k}/id={batch_id}")

        live.tail_growing(spark, path, sink, offsets, first=-1).awaitTermination()

    run(0)
    _append_files(path, more)
    run(1)
    rows = spark.read.parquet(out)
    return rows.groupBy("batch", F.substring_index("raw", " ", 1).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("folded_growing", f"WITH {LOG} SELECT level AS key, count(*) AS n FROM {_P} GROUP BY ALL")
def folded_growing(spark, sf_dir):
    """Level counts of growing files: tallies of two runs, folded in between and after."""
    (path, more), out, folded = _in_two_parts(spark, sf_dir), scratch_path(spark, "tallies"), scratch_path(spark, "folded")
    offsets = scratch_path(spark, "offsets")
    for k in range(2):
        live.tally_batches(growing_lines(spark, path), "apache_access", out, offsets).awaitTermination()
        live.compact_tallies(spark, out, folded)
        if not k:
            _append_files(path, more)
    rows = live.merged_tallies(spark, out, folded).where("kind = 'level'")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def _mixed_landing(spark, sf_dir: str) -> str:
    """Four folders of one format each, as text files."""
    path = scratch_path(spark, "mixed")
    lines = mixed_log(spark, sf_dir).select("source_path", F.col("raw").alias("value"))
    lines.repartition("source_path").write.partitionBy("source_path").text(path)
    return path


def _source() -> Column:
    return F.regexp_extract("source_path", "source_path=([^/]+)/", 1)


@query(
    "replay_batches",
    f"""WITH {EV}, r AS (SELECT source_path, row_number() OVER (PARTITION BY source_path) AS k, count(*) OVER (PARTITION BY source_path) AS n FROM ev)
SELECT source_path, count(*) AS n, min(k - 1) AS first_line, max(k - 1) AS last_line, true AS parsed FROM r WHERE k > 10 GROUP BY ALL""",
)
def replay_batches(spark, sf_dir):
    """Mixed formats detected as files land, each file from its eleventh line on."""
    out = scratch_path(spark, "replayed")

    def sink(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    path = _mixed_landing(spark, sf_dir)
    live.replay_batches(spark, f"{path}/*", sink, scratch_path(spark, "offsets"), 2, start_line=10).awaitTermination()
    rows = spark.read.parquet(out)
    return rows.groupBy(_source().alias("source_path")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line_no").alias("first_line"),
        F.max("line_no").alias("last_line"),
        F.bool_and("parsed").alias("parsed"),
    )


@query(
    "stream_summary_mixed",
    f"WITH {EV} SELECT source_path, 'parsed' AS key, count(*) AS n FROM ev GROUP BY ALL",
)
def stream_summary_mixed(spark, sf_dir):
    """Tallies of mixed formats per micro-batch, folded once on the way."""
    path, out, folded = _mixed_landing(spark, sf_dir), scratch_path(spark, "tallies"), scratch_path(spark, "folded")
    live.tally_batches(live.stream_raw(spark, f"{path}/*", 1), None, out, scratch_path(spark, "offsets")).awaitTermination()
    live.compact_tallies(spark, out, folded)
    rows = live.merged_tallies(spark, out, folded).where(F.col("kind") == "line")
    return rows.groupBy(_source().alias("source_path"), "key").agg(F.sum("n").alias("n"))


@query(
    "tail_batches",
    f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS k FROM log)
SELECT count(*) AS n FROM r WHERE k <= 50 AND outcome <> 'blank'""",
)
def tail_batches(spark, sf_dir):
    """The last fifty lines of one landed file, blank ones left out."""
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "tail")
    ordered = materialize(events_frame(spark, sf_dir).select("event_id", access_raw().alias("value")).orderBy("event_id"))
    ordered.select("value").coalesce(1).write.text(landing)  # sorted in parts; one task only copies them, in order

    def sink(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    live.tail_batches(spark, landing, sink, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"))
