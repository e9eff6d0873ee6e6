"""Alerts for rates that last, as chained windows: no Python state, and one row at the start and end of an alert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import is_error


def sustained_alert(
    entries: DataFrame,
    threshold: int = 100,
    lasting: int = 5,
    every: int = 60,
    delay: str = "10 minutes",
    by: tuple[str, ...] = (),
    errors_only: bool = True,
) -> DataFrame:
    """(*by, state, at, n): ``firing`` once a count stays above the threshold, ``resolved`` once it no longer does.

    Entries are counted in buckets of ``every`` seconds of event time. An alert starts at the end of the
    ``lasting``-th bucket in a row with more than ``threshold`` entries (errors, by default) and ends where the first
    other bucket starts; a bucket without entries is such a bucket, too. ``n`` counts the last ``lasting`` buckets of
    the run at that time. Runs are kept apart by the columns in ``by``.

    Every bucket above the threshold is looked at in the sliding windows of ``lasting + 1`` buckets that hold it. Where
    just one bucket is missing, and it is the first, an alert starts; where it is the last, one has ended. A window
    is decided when the watermark has passed it, so in append mode each row comes once, ``delay`` late, and is
    never taken back. Rows later than that are dropped. Entries without an instant, or not parsed, do not count.
    State holds counts only, a few numbers for each open bucket, however many entries there are.

    Works on streams (append mode) and on batches, where all windows are decided.
    """
    if lasting < 1 or every < 1:
        raise ValueError("lasting and every must be at least 1")
    if clash := {"state", "at", "n", "event_ts"}.intersection(c.lower() for c in by):
        raise ValueError(f"columns of the result cannot tell runs apart: {sorted(clash)}")
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    rows = entries.where(F.col("parsed") & F.col("event_ts").isNotNull())
    if errors_only:
        rows = rows.where(is_error(F.col("level")))
    width = f"{every} seconds"
    counted = (
        rows.select("event_ts", *keys)
        .withWatermark("event_ts", delay)
        .groupBy(F.window("event_ts", width).alias("w"), *names)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > threshold)
    )
    step = F.make_dt_interval(secs=F.lit(every))
    seen = (
        counted.groupBy(F.window(F.window_time("w"), f"{every * (lasting + 1)} seconds", width).alias("s"), *names)
        .agg(F.count(F.lit(1)).alias("above"), F.sum("n").alias("n"), F.min("w.start").alias("low"), F.max("w.end").alias("high"))
        .where(F.col("above") == lasting)
    )
    state = F.when(F.col("low") > F.col("s.start"), "firing").when(F.col("high") < F.col("s.end"), "resolved")
    at = F.when(F.col("state") == "firing", F.col("s.end")).otherwise(F.col("s.end") - step)
    found = seen.withColumn("state", state).where(F.col("state").isNotNull())
    return found.select(*[F.col(k).alias(c) for k, c in zip(names, by)], "state", at.alias("at"), "n")
