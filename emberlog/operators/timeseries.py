"""Activity over time. Buckets and hours use the wall clock as written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import settle
from ..schema import DEFAULT_SAMPLES
from .counts import severity_samples
from .ranking import first_k

# Bucket sizes and the trend threshold.
BUCKETS = {"5min": "5 minutes", "15min": "15 minutes", "1h": "1 hour", "1day": "1 day"}
DEFAULT_BUCKET = "1h"
SLOT_MINUTES = {"5min": 5, "15min": 15}
TREND_SLOPE = 0.1


def bucket_width(bucket: str) -> str:
    """Window width of a bucket name; unknown names mean one hour."""
    return BUCKETS.get(bucket, BUCKETS[DEFAULT_BUCKET])


def bucket_start(ts: Column, bucket: str) -> Column:
    return F.window(ts, bucket_width(bucket))["start"]


def slot_start(ts: Column, bucket: str = DEFAULT_BUCKET) -> Column:
    """Start of the bucket, or of the hour in a longer one: counts by slot add up to buckets and to hours of the day.

    Unlike a window it may stand inside other expressions, and it drops no row without a timestamp.
    """
    minutes = SLOT_MINUTES.get(bucket, 60)
    minute = F.floor(F.minute(ts) / minutes) * minutes
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.day(ts), F.hour(ts), minute.cast("int"), F.lit(0))


def _stamped(entries: DataFrame, n: str | None) -> DataFrame:
    times = settle(entries.select("source_path", "event_ts_local", *([n] if n else [])), "event_ts_local")
    return times.where(F.col("event_ts_local").isNotNull())


def _counted(n: str | None) -> Column:
    return (F.sum(n) if n else F.count(F.lit(1))).alias("n")


def temporal_distribution(entries: DataFrame, bucket: str = DEFAULT_BUCKET, n: str | None = None) -> DataFrame:
    """Entries per bucket; entries without a timestamp are skipped, empty buckets are absent.

    ``n`` names a column of counts, for rows that stand for several entries.
    """
    stamped = _stamped(entries, n)
    return (
        stamped.groupBy("source_path", F.window("event_ts_local", bucket_width(bucket)).alias("_w"))
        .agg(_counted(n))
        .select("source_path", F.col("_w.start").alias("bucket"), "n")
    )


def hourly_distribution(entries: DataFrame, n: str | None = None) -> DataFrame:
    stamped = _stamped(entries, n)
    return stamped.groupBy("source_path", F.hour("event_ts_local").alias("hour")).agg(_counted(n))


def trend(buckets: DataFrame) -> DataFrame:
    """Least-squares slope of the count over the bucket position, and its direction.

    Ranks buckets, not entries: a group is as large as its time range is long.
    """
    position = F.row_number().over(Window.partitionBy("source_path").orderBy("bucket"))
    slope = F.coalesce(F.regr_slope(F.col("n"), F.col("_x")), F.lit(0.0))
    fitted = buckets.withColumn("_x", position).groupBy("source_path").agg(slope.alias("slope"))
    direction = (
        F.when(F.col("slope") > TREND_SLOPE, "increasing")
        .when(F.col("slope") < -TREND_SLOPE, "decreasing")
        .otherwise("stable")
    )
    return fitted.withColumn("direction", direction)


def peak_period(buckets: DataFrame) -> DataFrame:
    """The bucket with the highest count; ties go to the earliest bucket."""
    return first_k(buckets, ["source_path"], [F.col("n").desc(), F.col("bucket")], 1, spread=False)


def active_hours(hours: DataFrame) -> DataFrame:
    return hours.groupBy("source_path").agg(F.count_distinct("hour").alias("active_hours"))


def analytics(
    entries: DataFrame,
    bucket: str = DEFAULT_BUCKET,
    scope: str = "samples",
    k: int = DEFAULT_SAMPLES,
    enable_time_series: bool = True,
) -> DataFrame:
    """One row per source: buckets, hours, trend and peak.

    ``scope='samples'`` looks at the collected errors and warnings, ``scope='all'`` at every entry.
    """
    if scope == "samples":
        rows = severity_samples(entries, k)
    elif scope == "all":
        rows = entries.where("parsed")
    else:
        raise ValueError(f"unknown scope: {scope}")
    sources = entries.select("source_path").distinct()
    if not enable_time_series:
        return sources.select("source_path", *_empty_analytics())
    return assemble_analytics(sources, temporal_distribution(rows, bucket), hourly_distribution(rows))


def _empty_analytics() -> list[Column]:
    return [
        F.lit(None).cast("array<struct<bucket:timestamp_ntz,n:bigint>>").alias("temporal"),
        F.lit(None).cast("array<struct<hour:int,n:bigint>>").alias("hourly"),
        F.lit(None).cast("string").alias("trend_direction"),
        F.lit(None).cast("timestamp_ntz").alias("peak_period"),
    ]


def assemble_analytics(sources: DataFrame, buckets: DataFrame, hours: DataFrame) -> DataFrame:
    """Buckets and hours -> one row per source. Both inputs are bounded by time, not by entries."""
    position = F.row_number().over(Window.partitionBy("source_path").orderBy("bucket"))
    per_bucket = (
        buckets.withColumn("_x", position)
        .groupBy("source_path")
        .agg(
            F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("temporal"),
            F.coalesce(F.regr_slope(F.col("n"), F.col("_x")), F.lit(0.0)).alias("slope"),
            F.max_by("bucket", F.struct(F.col("n"), -F.col("_x"))).alias("peak_period"),
        )
    )
    per_hour = hours.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("hour", "n"))).alias("hourly"))
    joined = sources.join(per_bucket, "source_path", "left").join(per_hour, "source_path", "left")
    direction = (
        F.when(F.col("slope") > TREND_SLOPE, "increasing")
        .when(F.col("slope") < -TREND_SLOPE, "decreasing")
        .otherwise("stable")
    )
    return joined.select("source_path", "temporal", "hourly", direction.alias("trend_direction"), "peak_period")
