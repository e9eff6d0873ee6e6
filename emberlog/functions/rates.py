"""Percentages, shares and their display classes."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def pct(n: Column, total: Column) -> Column:
    """100 * n / total; 0.0 on a zero total."""
    return F.coalesce(n / F.nullif(total, F.lit(0)) * 100.0, F.lit(0.0))


def error_rate(errors: Column, parsed: Column) -> Column:
    return pct(errors, parsed)


def parse_success_rate(parsed: Column, total: Column) -> Column:
    return pct(parsed, total)


def share_of_max(n: Column, per: str = "source_path") -> Column:
    """n over the largest n of its source. For bounded groups: hours, buckets."""
    return n / F.max(n).over(Window.partitionBy(per))


def activity_class(share: Column) -> Column:
    return F.when(share >= 0.8, "peak").when(share >= 0.5, "high").otherwise("normal")


# Thresholds of the two success views and of the error view.
_SUCCESS_LIMITS = {"success_list": (90, 70), "success_detail": (95, 80)}
_ERROR_LIMITS = (1, 5)


def rate_class(rate: Column, kind: str) -> Column:
    if kind == "error":
        good, fair = _ERROR_LIMITS
        return F.when(rate <= good, "success").when(rate <= fair, "warning").otherwise("error")
    good, fair = _SUCCESS_LIMITS[kind]
    return F.when(rate >= good, "success").when(rate >= fair, "warning").otherwise("error")
