"""Alerts that last: starts, ends, gaps, several runs, late rows, and a stream in two runs."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.streaming.alerts import sustained_alert

T0 = datetime(2024, 5, 1, 12, 0)
SCHEMA = "event_ts timestamp, level string, parsed boolean, source string"


def rows(counts: dict[int, int], source: str = "a", level: str = "ERROR", parsed: bool = True):
    """So many rows in each minute after T0."""
    return [(T0 + timedelta(minutes=m, seconds=i % 60), level, parsed, source) for m, n in counts.items() for i in range(n)]


def events(df):
    return sorted((r.source, r.state, int((r.at - T0).total_seconds() // 60), r.n) for r in df.collect())


def plain(counts: dict[int, int], threshold: int, lasting: int):
    """The same minute by minute."""
    out, run = [], []
    for m in range(min(counts), max(counts) + 2):
        if counts.get(m, 0) > threshold:
            run.append(counts[m])
            if len(run) == lasting:
                out.append(("a", "firing", m + 1, sum(run)))
        else:
            if len(run) >= lasting:
                out.append(("a", "resolved", m, sum(run[-lasting:])))
            run = []
    return sorted(out)


@pytest.mark.parametrize("lasting", [1, 2, 5])
def test_runs_against_minutes(spark, lasting):
    counts = {m: (m * 7 + m // 9) % 11 for m in range(90) if m % 23}
    counts |= {m: 9 for m in range(40, 48)}
    frame = spark.createDataFrame(rows(counts), SCHEMA)
    got = events(sustained_alert(frame, 4, lasting, 60, by=("source",)))
    assert got == plain(counts, 4, lasting) and got


def test_only_parsed_errors_with_an_instant_count(spark):
    some = rows({0: 3, 1: 3}) + rows({2: 3}, level="INFO") + rows({2: 3}, parsed=False) + [(None, "ERROR", True, "a")] * 3
    frame = spark.createDataFrame(some, SCHEMA)
    assert events(sustained_alert(frame, 2, 3, 60, by=("source",))) == []
    assert events(sustained_alert(frame, 2, 3, 60, by=("source",), errors_only=False)) == [("a", "firing", 3, 9), ("a", "resolved", 3, 9)]


def test_keys_keep_runs_apart_and_null_is_a_key(spark):
    frame = spark.createDataFrame(rows({0: 2, 2: 2}) + rows({1: 2}, "b") + rows({0: 2, 1: 2}, None), SCHEMA)
    got = sustained_alert(frame, 1, 2, 60, by=("source",)).select("source", "state").collect()
    assert sorted(got) == [(None, "firing"), (None, "resolved")]
    assert sustained_alert(frame, 1, 3, 60).where("state = 'firing'").count() == 1


def test_empty_and_arguments(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert sustained_alert(frame).count() == 0
    with pytest.raises(ValueError):
        sustained_alert(frame, lasting=0)
    with pytest.raises(ValueError):
        sustained_alert(frame, by=("N",))


def test_stream_tells_start_before_end_and_each_once(spark, tmp_path):
    source, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))

    def run(some):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        alerts = sustained_alert(spark.readStream.schema(SCHEMA).parquet(source), 1, 3, 60, "0 seconds", ("source",))
        query = alerts.writeStream.format("parquet").option("path", out).option("checkpointLocation", offsets)
        query.trigger(availableNow=True).start().awaitTermination()
        return events(spark.read.parquet(out))

    assert run(rows({0: 2, 1: 2, 2: 2, 3: 2, 4: 1})) == [("a", "firing", 3, 6)]
    # minute 4 was still open: its row of the first run counts, too
    assert run(rows({4: 2, 7: 1})) == [("a", "firing", 3, 6), ("a", "resolved", 5, 7)]
    late = rows({5: 5, 6: 5}) + rows({20: 1})  # behind the watermark: never counted
    assert run(late) == [("a", "firing", 3, 6), ("a", "resolved", 5, 7)]


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(rows({0: 1}), SCHEMA)
    plan = sustained_alert(frame.where(F.col("parsed")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
