"""Tail, replay and running counts with Structured Streaming.

:func:`stream_raw` picks up new files in a directory; bytes appended to a file it has read are not seen. For files that
grow, use :func:`emberlog.streaming.growing.growing_lines`; all ``*_batches`` functions take its lines, too.

``stream_*`` and ``replay`` are plain streaming frames for one known format or a fixed table of formats. The
``*_batches`` functions work through each micro-batch as a batch frame: they detect formats of files as they
land, number lines, and take a trigger, so they serve long-running jobs too.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..formats import DEFAULT_REGISTRY, FormatRegistry
from ..functions.levels import is_error
from ..operators.detect import detect_format, with_fallback
from ..operators.entries import (
    attach_format,
    drop_blank,
    formats_in_use,
    from_line,
    number_lines,
    parse_marked,
    regex_filter,
    replay_rows,
)
from ..operators.timeseries import bucket_width
from ..plans.summary import merge_tallies, tally
from ..runtime import materialize
from ..schema import FALLBACK_FORMAT
from ..sources.lines import ordered_ids, tail_lines
from .growing import growing_lines


def stream_raw(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("source_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.make_valid_utf8("value").alias("raw"),
    )


def batch_lines(batch: DataFrame) -> DataFrame:
    """A micro-batch of :func:`stream_raw` or of growing files as LINES; ids grow in file order."""
    if "line_id" in batch.columns:
        return batch.select("source_path", "block_start", "line_id", "raw")
    return batch.select("source_path", "block_start", ordered_ids(F.col("block_start")).alias("line_id"), "raw")


def batch_formats(lines: DataFrame, fmt: str | None, registry: FormatRegistry) -> tuple[DataFrame, list[str]]:
    """Lines with ``format`` and the names that occur, detected for each file of the batch unless ``fmt`` is given."""
    if fmt is not None:
        registry.get(fmt)
        return lines.withColumn("format", F.lit(fmt)), [fmt]
    found = detect_format(lines, registry=registry).select("source_path", "format")
    formats = materialize(with_fallback(found))
    return attach_format(lines, formats), formats_in_use(formats) or [FALLBACK_FORMAT]


def run_batches(
    lines: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``each``.

    ``trigger`` holds the options of ``DataStreamWriter.trigger``; by default what has landed is worked off.
    """
    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def tail_batches(
    spark: SparkSession,
    path: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    first: int = 50,
    pattern: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Tail of a directory that starts with the last ``first`` lines of each file that is there already.

    ``sink`` gets (source_path, line_id, raw, received_at) and the batch id; a repeated batch comes again with the
    same id. Blank lines and lines without the pattern are left out, after the start is cut.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        lines = batch_lines(batch)
        if batch_id == 0:
            lines = tail_lines(lines, first)
        kept = regex_filter(drop_blank(lines.select("source_path", "line_id", "raw")), pattern)
        sink(kept.withColumn("received_at", F.current_timestamp()), batch_id)

    return run_batches(stream_raw(spark, path), each, checkpoint, trigger)


def tail_growing(
    spark: SparkSession,
    path: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    first: int = 50,
    pattern: str | None = None,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Tail of files that grow: the last ``first`` lines of each file, then every line appended, each once.

    ``sink`` and the filters are those of :func:`tail_batches`, options those of
    :func:`emberlog.streaming.growing.growing_lines`.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = regex_filter(drop_blank(batch.select("source_path", "line_id", "raw")), pattern)
        sink(kept.withColumn("received_at", F.current_timestamp()), batch_id)

    return run_batches(growing_lines(spark, path, first, **options), each, checkpoint, trigger)


#: Replay speeds and their lines a second; 0 is without a pause.
SPEEDS = {1: 5, 2: 10, 5: 25, 10: 50, 0: 0}


def replay_paced(
    spark: SparkSession,
    path: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    progress: str,
    fmt: str,
    speed: int = 1,
    seconds: int = 1,
    pattern: str | None = None,
    trigger: dict | None = None,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> StreamingQuery:
    """Stored files as parsed entries at a chosen speed, file after file.

    Every ``seconds`` a micro-batch brings the lines of that time. ``progress`` names the file that keeps the position:
    a stopped replay goes on at the next line, also at another speed. Rows have ``line_id`` for their place.
    """
    if speed not in SPEEDS:
        raise ValueError(f"speed must be one of {sorted(SPEEDS)}")
    lines = growing_lines(spark, path, lines=SPEEDS[speed] * seconds, progress=progress)

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = drop_blank(regex_filter(batch_lines(batch), pattern)).withColumn("format", F.lit(fmt))
        sink(parse_marked(kept, [fmt], registry), batch_id)

    registry.get(fmt)
    return run_batches(lines, each, checkpoint, trigger or {"processingTime": f"{seconds} seconds"})


def replay_batches(
    spark: SparkSession,
    path: str,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    files_per_trigger: int | None = 1,
    pattern: str | None = None,
    start_line: int = 0,
    fmt: str | None = None,
    trigger: dict | None = None,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> StreamingQuery:
    """Stored files as parsed entries with line numbers and progress, a few files per micro-batch.

    Each file's format is detected when it lands. ``start_line`` jumps into every file. ``sink`` gets the rows of
    :func:`emberlog.operators.entries.replay_rows` and the batch id.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        numbered = materialize(number_lines(batch_lines(batch)))
        totals = numbered.groupBy("source_path").agg(F.count(F.lit(1)).alias("total_lines"))
        marked, names = batch_formats(numbered, fmt, registry)
        entries = parse_marked(drop_blank(regex_filter(from_line(marked, start_line), pattern)), names, registry)
        places = numbered.select("source_path", "line_id", "line_no")
        sink(replay_rows(entries.join(places, ["source_path", "line_id"]), totals), batch_id)

    return run_batches(stream_raw(spark, path, files_per_trigger), each, checkpoint, trigger)


def stream_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Tail of a directory: non-blank lines of new files that hold the pattern, stamped on arrival."""
    content = regex_filter(drop_blank(stream_raw(spark, path)), pattern)
    return content.withColumn("received_at", F.current_timestamp())


def stream_entries(
    lines: DataFrame,
    formats: DataFrame | None = None,
    fmt: str | None = None,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> DataFrame:
    """Streaming lines -> entries with the batch expressions; formats are a static lookup.

    Lines of files that the lookup does not list get the fallback format.
    """
    content = drop_blank(lines)
    if fmt is not None:
        return parse_marked(content.withColumn("format", F.lit(fmt)), [fmt], registry)
    names = sorted({*formats_in_use(formats), FALLBACK_FORMAT})
    return parse_marked(attach_format(content, formats), names, registry)


def replay(
    spark: SparkSession,
    path: str,
    formats: DataFrame | None = None,
    files_per_trigger: int = 1,
    pattern: str | None = None,
    fmt: str | None = None,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> DataFrame:
    """Stored files as a stream of parsed entries, a few files per micro-batch."""
    lines = regex_filter(stream_raw(spark, path, files_per_trigger), pattern)
    return stream_entries(lines, formats, fmt, registry).select(
        "source_path",
        F.col("raw").alias("line"),
        "level",
        F.col("event_ts_local").alias("ts"),
        F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("raw")).alias("message"),
        "source",
        "parsed",
    )


_REPORT = "batch_id bigint, input_rows bigint, rows_per_second double, late_rows bigint"


def _report_row(report: dict) -> tuple[int, int, float, int]:
    late = sum(op.get("numRowsDroppedByWatermark", 0) for op in report.get("stateOperators", []))
    return report["batchId"], int(report["numInputRows"]), float(report.get("processedRowsPerSecond") or 0.0), late


def progress_metrics(query: StreamingQuery) -> DataFrame:
    """One row per micro-batch that the query still remembers; :class:`ProgressLog` has all of them."""
    reports = [p if isinstance(p, dict) else json.loads(p.json) for p in query.recentProgress]
    return SparkSession.active().createDataFrame([_report_row(r) for r in reports], _REPORT)


def stream_counts(entries: DataFrame, key: str) -> DataFrame:
    """Running count per level, source or status; use update or complete mode."""
    return entries.where(F.col("parsed") & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def stream_buckets(entries: DataFrame, bucket: str = "1h", delay: str = "10 minutes", errors_only: bool = False) -> DataFrame:
    """Tumbling counts by event time. Rows later than ``delay`` behind the previous batch are dropped."""
    rows = entries.where("parsed")
    if errors_only:
        rows = rows.where(is_error(F.col("level")))
    return (
        rows.withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", bucket_width(bucket)).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket"), "n")
    )


def burst_alert(buckets: DataFrame, threshold: int = 100) -> DataFrame:
    """Buckets whose count exceeds the threshold."""
    return buckets.where(F.col("n") > threshold)


def tally_batches(
    lines: DataFrame,
    fmt: str | None,
    path: str,
    checkpoint: str,
    registry: FormatRegistry = DEFAULT_REGISTRY,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Write the tally of every micro-batch below ``path``; a repeated batch overwrites its own folder.

    Without ``fmt`` each file's format is detected when it lands. Read the tallies back with
    :func:`merged_tallies`, and fold them from time to time with :func:`compact_tallies`. A batch counts as soon as its
    marker below ``landed`` is there, which is written after its rows below ``data``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        marked, names = batch_formats(batch_lines(batch), fmt, registry)
        tally(marked, names, registry).write.mode("overwrite").parquet(f"{path}/data/batch={batch_id}")
        _publish(batch.sparkSession, [(batch_id,)], "batch bigint", f"{path}/landed/id={batch_id}", "overwrite")

    return run_batches(lines, write, checkpoint, trigger)


def _publish(spark: SparkSession, rows: list[tuple], schema: str, path: str, mode: str = "error") -> None:
    """One small file, which is there as a whole or not at all."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(path)


def _landed(spark: SparkSession, path: str) -> list[int]:
    return sorted({r.batch for r in spark.read.parquet(f"{path}/landed").select("batch").collect()})


def _fold(spark: SparkSession, into: str | None) -> tuple[int, int, str | None]:
    """Version, last batch and folder of the newest published fold; (-1, -1, None) before the first one."""
    if into is None:
        return -1, -1, None
    try:
        found = spark.read.parquet(f"{into}/manifest").select("version", "upto", "folder").collect()
    except AnalysisException:  # nothing folded yet
        return -1, -1, None
    return max(map(tuple, found), default=(-1, -1, None))


def _tallies(spark: SparkSession, path: str, fold: tuple[int, int, str | None], last: int) -> DataFrame:
    """Tallies up to batch ``last``, those of the fold from its folder."""
    _, upto, folder = fold
    parts = [] if folder is None else [spark.read.parquet(folder)]
    if last > upto:
        batches = spark.read.parquet(f"{path}/data")
        parts.append(batches.where((F.col("batch") > upto) & (F.col("batch") <= last)).drop("batch"))
    return merge_tallies(parts)


def compact_tallies(spark: SparkSession, path: str, into: str) -> int:
    """Fold all landed batches below ``path`` into one folder below ``into``; returns the last batch in it.

    The fold first lists its batches and reads only these, so a batch that lands meanwhile stays for the next one. Its
    rows go into a folder of their own, which counts from the moment the manifest of the next version names it: a
    fold that dies changes nothing, and of two folds at once the later one fails. Nothing is deleted;
    folders of batches up to the returned one are not read again by readers that pass ``into``.
    """
    fold = _fold(spark, into)
    version, upto, _ = fold
    last = upto
    for batch in _landed(spark, path):  # batches land in order; stop at a gap, should there be one
        last = batch if batch == last + 1 else last
    if last > upto:
        folder = f"{into.rstrip('/')}/fold-{uuid.uuid4().hex}"
        _tallies(spark, path, fold, last).write.parquet(folder)
        _publish(spark, [(version + 1, last, folder)], "version bigint, upto bigint, folder string", f"{into}/manifest/id={version + 1}")
    return last


def merged_tallies(spark: SparkSession, path: str, compacted: str | None = None) -> DataFrame:
    """The tallies of all landed batches, of which those of the newest fold come from ``compacted``; each counts once."""
    fold = _fold(spark, compacted)
    return _tallies(spark, path, fold, max([fold[1], *_landed(spark, path)]))


class ProgressLog(StreamingQueryListener):
    """Rows read, rate and late rows of every micro-batch, however long a query runs.

    A query itself remembers its last hundred reports only. Register the log before the query starts::

        log = ProgressLog()
        spark.streams.addListener(log)
    """

    def __init__(self) -> None:
        self.reports: dict[str, list[tuple[int, int, float, int]]] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        self.reports.setdefault(str(event.runId), [])
        self.ended.setdefault(str(event.runId), threading.Event())

    def onQueryProgress(self, event) -> None:
        report = json.loads(event.progress.json)
        self.reports.setdefault(str(report["runId"]), []).append(_report_row(report))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()

    def metrics(self, query: StreamingQuery, wait: float = 30.0) -> DataFrame:
        """One row per finished micro-batch of a query; waits for the last reports of one that has ended."""
        run = str(query.runId)
        if not query.isActive:
            self.ended.setdefault(run, threading.Event()).wait(wait)
        return SparkSession.active().createDataFrame(self.reports.get(run, []), _REPORT)
