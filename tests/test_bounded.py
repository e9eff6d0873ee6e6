"""Summaries and heads of logs whose keys or sizes grow without bound."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from emberlog.operators import tables, triage
from emberlog.plans import summary as plans
from emberlog.schema import MAP_KEYS, OTHER_KEYS
from emberlog.sources import reports


@pytest.fixture(scope="module")
def wide_log(lines_of):
    """A status of its own on every line, one status on many, and a second source with few."""
    row = '{"level":"%s","message":"m","timestamp":"2031-05-06T07:08:09Z","status":"%s"}'
    many = [row % ("error" if i % 4 == 0 else "info", f"s{i:05d}" if i % 3 else "busy") for i in range(6000)]
    return lines_of({"many": many, "few": [row % ("info", "ok")] * 5 + [row % ("error", "bad")]})


def test_maps_are_bounded_and_lose_no_count(wide_log):
    parts = plans.summary_parts(wide_log, fmt="json")
    rows = {r.source_path: r for r in plans.assemble_parts(parts).collect()}
    codes = rows["many"].status_codes
    assert len(codes) == MAP_KEYS + 1 and codes["busy"] == 2000 and sum(codes.values()) == 6000
    assert codes[OTHER_KEYS] == 4000 - (MAP_KEYS - 1) and "s00001" in codes
    assert rows["few"].status_codes == {"ok": 5, "bad": 1} and rows["few"].level_counts == {"INFO": 5, "ERROR": 1}
    assert rows["many"].error_rate == pytest.approx(rows["many"].level_counts["ERROR"] / 60, abs=0.01)


def test_reports_of_wide_maps(wide_log):
    parts = plans.summary_parts(wide_log, fmt="json")
    made = plans.assemble_parts(parts)
    whole = tables.status_table(made, parts.tallies)
    assert whole.where("source_path = 'many'").count() == 4001 and whole.agg(F.sum("n")).first()[0] == 6006
    assert tables.status_table(made).where("source_path = 'many'").count() == MAP_KEYS + 1
    assert plans.long_counts(parts.tallies, "status", "code").count() == 4003
    context = {r.source_path: r.context for r in triage.triage_context(made).collect()}
    assert "busy: 2,000" in context["many"] and OTHER_KEYS not in context["many"]
    assert reports.summary_json(made).count() == 2


def test_parts_of_wide_logs_add_up(lines_of):
    row = '{"level":"info","message":"m","timestamp":"2031-05-06T07:08:09Z","status":"s%d"}'
    days = [lines_of([row % (i % 1500 + 100 * k) for i in range(2000)]) for k in range(2)]
    both = plans.merge_summaries([plans.summary_parts(d, fmt="json") for d in days]).first()
    assert sum(both.status_codes.values()) == 4000 and len(both.status_codes) == MAP_KEYS + 1
