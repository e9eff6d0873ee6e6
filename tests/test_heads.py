"""Heads of files against a scan of all lines."""

from __future__ import annotations

import gzip

import pytest

from emberlog.operators.detect import detect_files, detect_format
from emberlog.plans.summary import analyze
from emberlog.sources import heads
from emberlog.sources import lines as src

ACCESS = '198.51.100.7 - - [06/May/2031:07:08:09 +0000] "GET /a HTTP/1.1" 500 8\n'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a b.log").write_bytes(b"one\r\ntwo\rthree\n\n  \nbad \xff\xfe\nlast")
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "access%20=x.log").write_text(ACCESS * 300)
    (tmp_path / "blank.log").write_text("\n \n" * 200 + ACCESS * 3)
    (tmp_path / "long.log").write_text("x" * 200_000 + "\n" + ACCESS)
    with gzip.open(tmp_path / "zipped.log.gz", "wt") as out:
        out.write('{"level":"info","message":"m"}\n' * 50)
    return str(tmp_path)


def test_heads_equal_a_scan(spark, folder, monkeypatch):
    for n in (1, 4, 50):
        columns = ["source_path", "position", "raw"]
        want = src.head_lines(src.read_lines(spark, folder), n).select(columns)
        assert sorted(map(tuple, src.head_of_files(spark, folder, n).select(columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("skip", [False, True])
def test_formats_equal_a_scan(spark, folder, skip):
    want = detect_format(src.read_lines(spark, folder), skip_blank=skip).select("source_path", "format", "hits")
    got = detect_files(spark, folder, skip_blank=skip).select("source_path", "format", "hits")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ("apache_access" in {r.format for r in got.collect() if "blank" in r.source_path}) == skip


def test_bytes_read_do_not_grow_with_the_file(tmp_path, monkeypatch):
    asked = []
    real = heads._open

    class Counted:
        def __init__(self, system):
            self.system = system

        def open_input_stream(self, path, compression):
            stream = self.system.open_input_stream(path, compression=compression)
            return _Stream(stream, asked)

    monkeypatch.setattr(heads, "_open", lambda p: (Counted(real(p)[0]), real(p)[1]))
    for size in (10_000, 1_000_000):
        asked.clear()
        path = tmp_path / f"{size}.log"
        path.write_text(ACCESS * (size // 70))
        rows = heads.HeadReader({"files": "[]", "n": "100"}).head(f"file:{path}")
        assert len(rows) == 100 and sum(asked) <= heads.READ


class _Stream:
    def __init__(self, stream, asked):
        self.stream, self.asked = stream, asked

    def __enter__(self):
        return self

    def __exit__(self, *given):
        self.stream.close()

    def read(self, n):
        data = self.stream.read(n)
        self.asked.append(len(data))
        return data


def test_analysis_of_files_with_odd_names(spark, folder):
    rows = {r.source_path.rsplit("/", 1)[1]: r.detected_format for r in analyze(spark, folder).collect()}
    assert len(rows) == 5 and sorted(rows.values()) == ["apache_access", "apache_access", "json", "universal", "universal"]
