"""Activity of a summary: every error and warning counts, also beyond the samples that a summary lists."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest

from emberlog.operators.timeseries import slot_start, temporal_distribution
from emberlog.plans import summary as plans
from pyspark.sql import functions as F

START = datetime(2024, 2, 28, 22, 58, 30)
WIDTHS = {"5min": 5, "15min": 15, "1h": 60, "1day": 24 * 60, "2weeks": 60}


def _access(at, status):
    return f'10.0.0.1 - - [{at:%d/%b/%Y:%H:%M:%S} +0530] "GET /x" {status} 1'


def _log():
    """Two quiet days, then many errors and warnings, with lines between them that do not count."""
    stamped = [(START + timedelta(minutes=i * (97 if i < 30 else 7)), (500, 404, 200)[i % 3]) for i in range(400)]
    lines = ["", "junk"]
    for at, status in stamped:
        lines += [_access(at, status), ""]
    return lines, [at for at, status in stamped if status != 200]


def _bucket(at, minutes):
    day = at.replace(hour=0, minute=0, second=0)
    return day + timedelta(minutes=int((at - day).total_seconds()) // 60 // minutes * minutes)


@pytest.mark.parametrize("bucket, blocks", [("5min", True), ("1h", False), ("1day", True)])
def test_activity_counts_all_errors_and_warnings(lines_of, bucket, blocks):
    log, times = _log()
    frame = lines_of({"a": log, "b": [_access(START, 200)]}, partitions=3)
    frame = frame.withColumn("block_start", F.expr("line_id div 100 * 100")) if blocks else frame.drop("block_start")
    rows = {r["source_path"]: r for r in plans.summarize(frame, fmt="apache_access", k=5, analytics=True, bucket=bucket).collect()}
    row, want = rows["a"], Counter(_bucket(at, WIDTHS[bucket]) for at in times)
    assert len(row["errors"]) == len(row["warnings"]) == 5
    assert [(x["bucket"], x["n"]) for x in row["temporal"]] == sorted(want.items())
    assert [(x["hour"], x["n"]) for x in row["hourly"]] == sorted(Counter(at.hour for at in times).items())
    assert row["peak_period"] == min(want, key=lambda b: (-want[b], b))
    assert rows["b"]["temporal"] is None and rows["b"]["trend_direction"] == "stable"


def test_trend_is_that_of_the_whole_file(lines_of):
    """The first five errors come ever more seldom, all together come ever more often."""
    hours = [0, 0, 0, 1, 2] + [h for h in range(3, 12) for _ in range(h * 3)]
    log = [_access(START.replace(hour=h, minute=0) + timedelta(seconds=i), 500) for i, h in enumerate(hours)]
    row = plans.summarize(lines_of(log), k=5, analytics=True).first()
    assert row["trend_direction"] == "increasing"
    assert (row["peak_period"], sum(x["n"] for x in row["temporal"])) == (datetime(2024, 2, 28, 11), len(hours))


def test_errors_without_a_clock_are_skipped(lines_of):
    log = ['{"level":"error","message":"x"}', '{"level":"error","message":"y","timestamp":"2024-01-01T05:30:00Z"}']
    row = plans.summarize(lines_of(log), fmt="json", analytics=True).first()
    assert [(x["bucket"], x["n"]) for x in row["temporal"]] == [(datetime(2024, 1, 1, 5), 1)]
    assert len(row["errors"]) == 2


def test_merged_parts_keep_the_activity(lines_of):
    log, times = _log()
    frame = lines_of(log)
    cuts = (F.col("line_id") < 300, F.col("line_id") >= 300)
    pieces = [plans.summary_parts(frame.where(c), fmt="apache_access", k=5, bucket="15min") for c in cuts]
    active = plans.activity(plans.merge_parts(pieces).tallies)
    got = {r["bucket"]: r["n"] for r in temporal_distribution(active, "15min", "n").collect()}
    assert got == Counter(_bucket(at, 15) for at in times)


@pytest.mark.parametrize("bucket", list(WIDTHS))
def test_slots_lie_in_one_bucket_and_one_hour(spark, bucket):
    texts = ["0001-01-01 00:00:00", "1969-12-31 23:59:59.999999", "2024-03-10 02:30:00.5", "9999-12-31 23:59:59"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lit("f").alias("source_path"), F.col("t").cast("timestamp_ntz").alias("at"))
    slot = frame.select("source_path", slot_start(F.col("at"), bucket).alias("event_ts_local"), F.lit(3).alias("n"))
    direct = temporal_distribution(frame.withColumnRenamed("at", "event_ts_local"), bucket).collect()
    summed = temporal_distribution(slot, bucket, "n").collect()
    assert {r["bucket"]: 3 * r["n"] for r in direct} == {r["bucket"]: r["n"] for r in summed}
    hours = frame.select(F.hour("at") == F.hour(slot_start(F.col("at"), bucket))).distinct().collect()
    assert [tuple(r) for r in hours] == [(True,)]
