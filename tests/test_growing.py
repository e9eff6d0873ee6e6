"""Growing files, paced replay, folds of tallies."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from emberlog.plans import summary as plans
from emberlog.streaming import growing, live

LINE = '198.51.100.7 - - [06/May/2031:07:08:{0:02d} +0000] "GET /{0} HTTP/1.1" {1} 8\n'


@pytest.fixture
def tail(spark, tmp_path):
    landing, seen = tmp_path / "in", []
    landing.mkdir()

    def run(**options):
        def sink(rows, batch_id):
            seen.append(sorted((r["source_path"].rsplit("/", 1)[1], r["line_id"], r["raw"]) for r in rows.collect()))

        live.tail_growing(spark, str(landing), sink, str(tmp_path / "offsets"), **options).awaitTermination()
        return [x for batch in seen for x in batch]

    return landing, seen, run


def test_appended_lines_come_once(tail):
    """Each call of ``run`` is a restart of the query from its checkpoint."""
    landing, seen, run = tail
    log = landing / "a.log"
    log.write_text("".join(f"line {i}\n" for i in range(100)))
    assert [r[2] for r in run(first=3)] == ["line 97", "line 98", "line 99"]
    with log.open("a") as out:
        out.write("appended 1\n\nappended 2\r\nno end")
    (landing / "b.log").write_text("new file\n")
    (landing / "_hidden").write_text("hidden\n")
    run(first=3)
    assert [r[2] for r in seen[-1]] == ["appended 1", "appended 2", "new file"]
    before = len(seen)
    run(first=3)
    assert len(seen) == before or seen[-1] == []
    with log.open("a") as out:
        out.write(" yet, now it has\n")
    run(first=3)
    assert [r[2] for r in seen[-1]] == ["no end yet, now it has"]


def test_a_replaced_file_starts_over(tail):
    landing, seen, run = tail
    log = landing / "a.log"
    log.write_text("one\ntwo\nthree\n")
    run(first=-1)
    log.write_text("fresh\n")
    run(first=-1)
    assert [r[2] for r in seen[-1]] == ["fresh"]
    log.write_text("other and longer than before\nsecond\n")
    run(first=-1)
    assert [r[2] for r in seen[-1]] == ["other and longer than before", "second"]
    log.write_text("")
    run(first=-1)
    log.write_text("again\n")
    run(first=-1)
    assert [r[2] for r in seen[-1]] == ["again"]


def test_pieces_cut_anywhere_hold_every_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "READ", 7)
    monkeypatch.setattr(growing, "LOOK", 5)
    rng = random.Random(2)
    lines = ["x" * rng.randrange(0, 30) + str(i) for i in range(60)] + ["", "", "Größe é", "end"]
    path = tmp_path / "a.log"
    path.write_text("\n".join(lines) + "\npart")
    data = path.read_bytes()
    for piece in (1, 3, 10, 1000):
        reader = growing.GrowingReader({"path": str(tmp_path), "piece": str(piece)})
        got = [r for p in reader.partitions(reader.initialOffset(), reader.latestOffset()) for b in reader.read(p) for r in b.to_pylist()]
        assert [r["raw"] for r in got] == lines
        assert all(data[r["line_id"] :].startswith(r["raw"].encode() + b"\n") for r in got)
    assert [reader.back(str(path), len(data), n) for n in (0, 1)] == [len(data) - 4, len(data) - 8]


def test_lines_a_trigger_and_resume(tmp_path):
    for name, n in (("a", 5), ("b", 8)):
        (tmp_path / f"{name}.log").write_text("".join(f"{name}{i}\n" for i in range(n)))
    options = {"path": str(tmp_path), "lines": "4", "glob": "*.log", "progress": str(tmp_path / "at.json")}
    reader, got = growing.GrowingReader(options), []
    start = reader.initialOffset()
    for k in range(6):
        end = reader.latestOffset()
        batch = [r["raw"] for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        got.append(batch)
        reader.commit(end)
        start = end
        if k == 1:
            reader = growing.GrowingReader(options)  # a new process
    assert [len(b) for b in got] == [4, 4, 4, 1, 0, 0]
    assert sum(got, []) == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(8)]


def test_paced_replay_goes_on_at_its_line(spark, tmp_path):
    landing, seen = tmp_path / "in", []
    landing.mkdir()
    (landing / "a.log").write_text("".join(LINE.format(i, 200) for i in range(40)))

    def play(speed, until):
        def sink(rows, batch_id):
            seen.append([r["message"] for r in rows.orderBy("line_id").collect()])

        query = live.replay_paced(spark, str(landing), sink, str(tmp_path / "o"), str(tmp_path / "at.json"), "apache_access", speed)
        for _ in range(300):
            if sum(map(len, seen)) >= until:
                break
            time.sleep(0.2)
        query.stop()

    play(1, 10)
    assert max(map(len, seen)) == 5 and sum(map(len, seen)) < 40
    play(10, 40)
    played = [m for batch in seen for m in batch]
    assert list(dict.fromkeys(played)) == [f"GET /{i} HTTP/1.1" for i in range(40)]
    with pytest.raises(ValueError):
        live.replay_paced(spark, str(landing), print, "o", "p", "apache_access", 3)


def _counts(frame):
    return {r.key: r.n for r in frame.where("kind = 'level'").groupBy("key").agg(F.sum("n").alias("n")).collect()}


def test_a_batch_that_lands_during_a_fold_counts_once(spark, tmp_path, monkeypatch):
    landing, out, folded = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "folded")
    landing.mkdir()

    def land(name, n):
        (landing / name).write_text("".join(LINE.format(i, 500) for i in range(n)))
        live.tally_batches(live.stream_raw(spark, str(landing)), "apache_access", out, str(tmp_path / "o")).awaitTermination()

    land("one.log", 7)
    real = live._tallies

    def slow(*given):
        frame = real(*given)
        monkeypatch.setattr(live, "_tallies", real)
        land("two.log", 10)
        return frame

    monkeypatch.setattr(live, "_tallies", slow)
    assert live.compact_tallies(spark, out, folded) == 0
    assert _counts(live.merged_tallies(spark, out, folded)) == _counts(live.merged_tallies(spark, out)) == {"ERROR": 17}
    assert live.compact_tallies(spark, out, folded) == 1
    assert live.compact_tallies(spark, out, folded) == 1
    assert _counts(live.merged_tallies(spark, out, folded)) == {"ERROR": 17}


def test_a_fold_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    landing, out, folded = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "folded")
    landing.mkdir()
    (landing / "one.log").write_text("".join(LINE.format(i, 500) for i in range(4)))
    live.tally_batches(growing.growing_lines(spark, str(landing)), "apache_access", out, str(tmp_path / "o")).awaitTermination()

    def die(*given, **named):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(live, "_publish", die)
        with pytest.raises(RuntimeError):
            live.compact_tallies(spark, out, folded)
    assert _counts(live.merged_tallies(spark, out, folded)) == {"ERROR": 4}
    with (landing / "one.log").open("a") as more:
        more.write(LINE.format(9, 500) * 2)
    live.tally_batches(growing.growing_lines(spark, str(landing)), "apache_access", out, str(tmp_path / "o")).awaitTermination()
    live.compact_tallies(spark, out, folded)
    assert _counts(live.merged_tallies(spark, out, folded)) == {"ERROR": 6}
    assert plans.merge_tallies([live.merged_tallies(spark, out, folded)]).count() > 0
