from __future__ import annotations

from datetime import datetime, timedelta

from checks import streams


def test_the_landed_file_is_sorted_in_parts_and_in_order(spark, tmp_path, monkeypatch):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=i), i % 7, "view", 1.0) for i in range(400, 0, -1)]
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "events.parquet"))
    parts = []

    def stored(df):
        kept = df.checkpoint(eager=True)
        parts.append(kept.rdd.getNumPartitions())
        return kept

    monkeypatch.setattr(streams, "materialize", stored)
    monkeypatch.setattr(streams, "events_frame", lambda s, d, real=streams.events_frame: real(s, d).repartition(4))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = streams.tail_batches(spark, str(tmp_path)).first().n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert n == sum(i % 97 != 0 for i in range(351, 401))
    assert parts[0] > 1
