"""Derived instants: literal lines of each format, dates that do not exist, and the plain registry."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from emberlog.formats import DEFAULT_REGISTRY
from emberlog.formats.instants import DERIVED, full_year, with_derived_instants
from emberlog.operators.entries import parse_entries
from emberlog.operators.timeseries import temporal_distribution

LINES = {
    "apache_error": [
        ("[Tue Mar 05 07:08:09 2019] [error] disk is gone", datetime(2019, 3, 5, 7, 8, 9)),
        ("[Tue Mar 05 07:08:09.250500 2019] [core:warn] [pid 7] slow", datetime(2019, 3, 5, 7, 8, 9, 250500)),
        ("[feb 3 1:02:03 2020] [notice] no weekday", datetime(2020, 2, 3, 1, 2, 3)),
        ("[Tue Feb 30 07:08:09 2019] [error] no such day", None),
        ("[yesterday] [error] no date", None),
    ],
    "java_log": [
        ("2021-06-07 08:09:10,123 WARN [pool] a.B: full", datetime(2021, 6, 7, 8, 9, 10, 123000)),
        ("2021-06-07 08:09:10.456 INFO a.B: dot", datetime(2021, 6, 7, 8, 9, 10, 456000)),
        ("21/06/07 08:09:10 INFO a.B: short", datetime(2021, 6, 7, 8, 9, 10)),
        ("69/12/31  23:59:59 INFO a.B: last century", datetime(1969, 12, 31, 23, 59, 59)),
        ("21/13/07 08:09:10 INFO a.B: month 13", None),
    ],
    "hdfs": [
        ("210607 080910 15 INFO dfs.Node: block", datetime(2021, 6, 7, 8, 9, 10)),
        ("200229 235959 15 WARN dfs.Node: leap", datetime(2020, 2, 29, 23, 59, 59)),
        ("210229 235959 15 WARN dfs.Node: no leap", None),
        ("210607 250910 15 WARN dfs.Node: hour 25", None),
    ],
    "supercomputer": [
        ("- 1600000000 2020.09.13 n1 2020-09-13-12.26.40 n1 RAS KERNEL INFO up", datetime(2020, 9, 13, 12, 26, 40)),
        ("- 0 1970.01.01 n1 up", datetime(1970, 1, 1)),
        ("- 999999999999999 2020.09.13 n1 far away", None),
    ],
    "hpc": [
        ("17 node-3 unix.hw error 1600000000 1 fan stopped", datetime(2020, 9, 13, 12, 26, 40)),
        ("17 node-3 unix.hw error 253402300800 1 year 10000", None),
    ],
}


@pytest.mark.parametrize("name", list(LINES))
def test_literal_lines(lines_of, name):
    raws, expected = zip(*LINES[name])
    entries = parse_entries(lines_of(list(raws)), fmt=name, registry=with_derived_instants())
    rows = {r.raw: r for r in entries.collect()}
    assert all(rows[raw].parsed for raw in raws)
    assert [rows[raw].event_ts_local for raw in raws] == list(expected)
    plain = parse_entries(lines_of(list(raws)), fmt=name)
    assert plain.where("event_ts is not null").count() == 0
    same = [c for c in plain.columns if not c.startswith("event_ts")]
    assert plain.select(same).withColumn("metadata", F.col("metadata").cast("string")).exceptAll(
        entries.select(same).withColumn("metadata", F.col("metadata").cast("string"))
    ).count() == 0


def test_buckets_work_on_them(lines_of):
    entries = parse_entries(lines_of([raw for raw, _ in LINES["hdfs"]]), fmt="hdfs", registry=with_derived_instants())
    assert sorted(r.n for r in temporal_distribution(entries).collect()) == [1, 1]


def test_registry_is_a_copy():
    made = with_derived_instants(names=("hpc",))
    assert [f.name for f in made.all()] == [f.name for f in DEFAULT_REGISTRY.all()]
    assert made.get("hpc").stamps and not made.get("hdfs").stamps and not DEFAULT_REGISTRY.get("hpc").stamps
    assert made.get("windows").stamps is DEFAULT_REGISTRY.get("windows").stamps
    with pytest.raises(ValueError):
        with_derived_instants(names=("json",))
    assert set(DERIVED) <= {f.name for f in made.all()}


def test_full_year(spark):
    texts = ["00", "68", "69", "99", "1", "x1", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.y for r in frame.select("i", full_year(F.col("t")).alias("y")).orderBy("i").collect()]
    assert got == ["2000", "2068", "1969", "1999", None, None, None]
