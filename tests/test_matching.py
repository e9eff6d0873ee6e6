from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from checks import parsing
from checks.render import events_frame, raw_line
from emberlog import formats as fm

KINDS = ("view", "click", "signup", "purchase", "error")


def stored_events(spark, path, n=60) -> str:
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), i % 7, KINDS[i % 5], 1.0) for i in range(n)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_json_is_read_once_per_line(spark, tmp_path):
    hits = parsing.matches_every_format(spark, stored_events(spark, tmp_path))
    readers = sum(bool(f.openers) for f in fm.DEFAULT_REGISTRY.all()) + 1  # and containerd's message
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == readers
    assert {r.format: r.hits for r in hits.collect()} == {f: 48 if f == "hdfs" else 60 for f in parsing.EXPECTED}


def test_stored_pieces_match_the_same_lines(spark, tmp_path):
    events = events_frame(spark, stored_events(spark, tmp_path, 20))
    own = events.select(F.explode(F.array(*[raw_line(f) for f in parsing.EXPECTED])).alias("raw"))
    odd = ["", "  ", "{", "[", "{}", "[1]", '{"log":1}', '{"log":1,"stream":null,"time":2} x', "￿ 10.0.0.1", "10.0.0.1 - - [x] \"\" 1 -￿"]
    odd += ["2024-01-01T00:00:00.1Z stdout F {\"level\":1", "2024-01-01T00:00:00.1Z stdout F plugin/", '[{"level":1}] ]', "a\nb", None]
    lines = own.union(spark.createDataFrame([(x,) for x in odd], "raw string")).cache()
    for fmt in [f.name for f in fm.DEFAULT_REGISTRY.all()]:
        read, pieces = fm.with_pieces(fmt, lines)
        got = read.select("raw", fm.matches(fmt, F.col("raw"), **pieces).alias("hit"))
        want = lines.select("raw", fm.matches(fmt, F.col("raw")).alias("hit"))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), fmt
