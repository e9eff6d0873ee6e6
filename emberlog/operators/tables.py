"""Small frames behind reports and charts, built from SUMMARY or from bucket and hour counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import level_rank, status_category
from ..functions.rates import activity_class, pct, share_of_max
from ..functions.text import ellipsize, escape_text
from ..functions.times import bucket_label, span_text, utc_wall_clock
from .counts import span_micros
from .ranking import last_buckets


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def percent_text(rate: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", rate)


def clock_text(ts: Column) -> Column:
    return F.date_format(utc_wall_clock(ts), "yyyy-MM-dd HH:mm:ss")


def overview(summary: DataFrame) -> DataFrame:
    """(source_path, position, metric, value); rows without a value are left out."""
    values = [
        ("Total Lines", thousands(F.col("total_lines"))),
        ("Parsed Lines", thousands(F.col("parsed_lines"))),
        ("Failed Lines", thousands(F.col("failed_lines"))),
        ("Parse Success Rate", percent_text(F.col("parse_success_rate"))),
        ("Error Rate", percent_text(F.col("error_rate"))),
        ("First Entry", clock_text(F.col("earliest_ts"))),
        ("Last Entry", clock_text(F.col("latest_ts"))),
        ("Time Span", span_text(span_micros(F.col("earliest_ts"), F.col("latest_ts")))),
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(name).alias("metric"), value.alias("value"))
            for i, (name, value) in enumerate(values, start=1)
        ]
    )
    return summary.select("source_path", F.inline(rows)).where(F.col("value").isNotNull())


def severity_table(summary: DataFrame) -> DataFrame:
    """The five levels that occur, most severe first, as a share of parsed lines."""
    rows = summary.select("source_path", "parsed_lines", F.explode("level_counts").alias("level", "n"))
    known = rows.where(level_rank(F.col("level")).isNotNull() & (F.col("n") > 0))
    return known.select(
        "source_path",
        (5 - level_rank(F.col("level"))).cast("int").alias("position"),
        "level",
        "n",
        pct(F.col("n"), F.col("parsed_lines")).alias("pct"),
    )


def status_table(summary: DataFrame, tallies: DataFrame | None = None) -> DataFrame:
    """Counts of every status. With the ``tallies`` behind the summary all codes are rows, however many there are;
    from the summary alone, codes beyond its bounded map come as one rest row.
    """
    if tallies is not None:
        rows = tallies.where(F.col("kind") == "status").select("source_path", F.col("key").alias("code"), "n")
    else:
        rows = summary.select("source_path", F.explode("status_codes").alias("code", "n"))
    return rows.select("source_path", "code", "n", status_category(F.col("code")).alias("category"))


def top_tables(summary: DataFrame, cut: int = 80) -> DataFrame:
    """Top error messages (cut and escaped for a table cell) and top sources, one row per place."""
    errors = summary.select("source_path", F.posexplode("top_errors").alias("at", "item")).select(
        "source_path",
        F.lit("error").alias("kind"),
        (F.col("at") + 1).alias("position"),
        F.left(escape_text(F.col("item.message"), "markdown"), F.lit(cut)).alias("value"),
        F.col("item.count").alias("n"),
    )
    sources = summary.select("source_path", F.posexplode("top_sources").alias("at", "item")).select(
        "source_path",
        F.lit("source").alias("kind"),
        (F.col("at") + 1).alias("position"),
        F.col("item.source").alias("value"),
        F.col("item.count").alias("n"),
    )
    return errors.unionByName(sources)


def top_display(summary: DataFrame, k: int = 5, cut: int = 100) -> DataFrame:
    """The shorter list of a terminal view: ``k`` messages, ellipsized."""
    return summary.select("source_path", F.posexplode(F.slice("top_errors", 1, k)).alias("at", "item")).select(
        "source_path",
        (F.col("at") + 1).alias("position"),
        ellipsize(F.col("item.message"), cut).alias("message"),
        F.col("item.count").alias("n"),
    )


def hourly_table(hours: DataFrame) -> DataFrame:
    """Hours with activity and their share of the busiest hour."""
    return hours.where(F.col("n") > 0).select(
        "source_path", "hour", "n", share_of_max(F.col("n")).alias("share")
    )


def recent_table(buckets: DataFrame, k: int = 10) -> DataFrame:
    """The last ``k`` buckets, old to new, with label and share of the busiest of them."""
    return last_buckets(buckets, k).select(
        "source_path",
        "position",
        bucket_label(F.col("bucket")).alias("label"),
        "n",
        share_of_max(F.col("n")).alias("share"),
    )


def chart_series(buckets: DataFrame, hours: DataFrame, k: int = 50) -> DataFrame:
    """Both chart series in one frame: ``series`` temporal (last ``k`` buckets) or hourly."""
    temporal = last_buckets(buckets, k).select(
        "source_path",
        F.lit("temporal").alias("series"),
        "position",
        bucket_label(F.col("bucket")).alias("label"),
        "n",
        F.lit(None).cast("string").alias("activity"),
    )
    hourly = hourly_table(hours).select(
        "source_path",
        F.lit("hourly").alias("series"),
        F.row_number().over(Window.partitionBy("source_path").orderBy("hour")).alias("position"),
        F.format_string("%02d:00", F.col("hour")).alias("label"),
        "n",
        activity_class(F.col("share")).alias("activity"),
    )
    return temporal.unionByName(hourly)


def severity_chart(levels: DataFrame) -> DataFrame:
    """Every level that occurs as a share of all levels; words outside the five come last."""
    total = F.sum("n").over(Window.partitionBy("source_path"))
    return levels.where(F.col("n") > 0).select(
        "source_path",
        "level",
        "n",
        pct(F.col("n"), total).alias("pct"),
        F.coalesce(F.lit(4) - level_rank(F.col("level")), F.lit(5)).cast("int").alias("severity"),
    )
