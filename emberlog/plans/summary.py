"""Per-source summary of log files: one parse pass for all counts; samples parse only the blocks that hold them.

The counting pass turns every line into a few (kind, key) rows and aggregates them together, so line
counts, levels, status codes, sources, error messages, the time range and, on request, the errors and
warnings over time cost one scan, one parse and one shuffle. The result, one row per distinct key, is
stored once; rankings and totals read it from there.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..formats import DEFAULT_REGISTRY, FormatRegistry
from ..functions.levels import is_error, is_warning
from ..functions.rates import error_rate, parse_success_rate
from ..functions.text import is_blank
from ..operators.counts import severity_samples, span_micros
from ..operators.detect import detect_files, detect_format, with_fallback
from ..operators.entries import attach_format, formats_in_use, parse_marked
from ..operators.ranking import first_k
from ..operators.timeseries import DEFAULT_BUCKET, assemble_analytics, hourly_distribution, slot_start, temporal_distribution
from ..runtime import broadcast_if_small, materialize
from ..schema import DEFAULT_SAMPLES, MAP_KEYS, OTHER_KEYS, TOP_K

_RANKED = ("source", "error")
_MAPPED = ("level", "status")
_BY_BLOCK = ("error_block", "warning_block")


def tally(
    marked: DataFrame,
    names: list[str],
    registry: FormatRegistry = DEFAULT_REGISTRY,
    by_block: bool = False,
    bucket: str | None = None,
) -> DataFrame:
    """Lines with ``format`` -> (source_path, kind, key, n, first_line, earliest_ts, latest_ts).

    Kinds: ``line`` (blank, parsed, failed), ``level``, ``status``, ``source``, ``error`` (message). With
    ``by_block`` also ``error_block`` and ``warning_block``, counts of those lines by block start. With ``bucket``
    also ``activity``, counts of errors and warnings by the slot of their wall clock (see :func:`slot_start`).
    """
    entries = parse_marked(marked, names, registry)
    ok, level = F.col("parsed"), F.col("level")
    outcome = F.when(is_blank(F.col("raw")), "blank").when(ok, "parsed").otherwise("failed")

    def pair(kind: str, key: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"))

    pairs = [
        pair("line", outcome),
        pair("level", F.when(ok, F.nullif(level, F.lit("")))),
        pair("status", F.when(ok, F.col("status"))),
        pair("source", F.when(ok, F.nullif(F.col("source"), F.lit("")))),
        pair("error", F.when(ok & is_error(level), F.col("message"))),
    ]
    if by_block:
        block = F.col("block_start").cast("string")
        pairs += [pair("error_block", F.when(ok & is_error(level), block)), pair("warning_block", F.when(ok & is_warning(level), block))]
    if bucket is not None:
        # A column of its own, so that the clock is read once, and of errors and warnings only.
        severe = ok & (is_error(level) | is_warning(level))
        entries = entries.withColumn("_at", F.when(severe, F.col("event_ts_local")))
        pairs.append(pair("activity", slot_start(F.col("_at"), bucket).cast("string")))
    rows = (
        entries.select("source_path", "line_id", "event_ts", F.explode(F.array(*pairs)).alias("p"))
        .where(F.col("p.key").isNotNull())
        .select("source_path", "line_id", F.col("p.kind").alias("kind"), F.col("p.key").alias("key"), "event_ts")
    )
    return rows.groupBy("source_path", "kind", "key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line_id").alias("first_line"),
        F.min("event_ts").alias("earliest_ts"),
        F.max("event_ts").alias("latest_ts"),
    )


def merge_tallies(parts: list[DataFrame]) -> DataFrame:
    """Add up tallies of the same kind of rows, for example one per day.

    ``first_line`` is the least line id of all parts, so it orders keys when the parts share one numbering. For
    parts that number their lines on their own, give them a column ``part``: the first key of the least part wins.
    """
    together = reduce(DataFrame.unionByName, parts)
    place = F.struct("part", "first_line") if "part" in together.columns else F.struct("first_line")
    merged = together.groupBy("source_path", "kind", "key").agg(
        F.sum("n").alias("n"),
        F.min(place).alias("_first"),
        F.min("earliest_ts").alias("earliest_ts"),
        F.max("latest_ts").alias("latest_ts"),
    )
    rest = [c for c in merged.columns if c != "_first"]
    return merged.select(*rest[:4], "_first.*", *rest[4:])


@dataclass(frozen=True)
class SummaryParts:
    """What a summary is made of, in a form that adds up without loss.

    ``tallies``: one row per distinct key; ``formats``: one row per source; ``samples``: the first ``k`` errors and
    warnings of each source as rows. All three are bounded by keys, sources and ``k``; store them as tables.
    """

    tallies: DataFrame
    formats: DataFrame
    samples: DataFrame
    k: int
    parts: int = 1


def merge_parts(pieces: list[SummaryParts]) -> SummaryParts:
    """Combine parts in the given order: exact counts and rankings, and the first ``k`` samples over all parts.

    ``k`` is the largest of the parts'. A source's format comes from the first part that has it.
    """
    tallies, formats, samples, offset = [], [], [], 0
    for piece in pieces:
        shift = F.lit(offset)
        tallies.append(_numbered(piece.tallies, shift))
        formats.append(_numbered(piece.formats.select("source_path", "format", *_part_of(piece.formats)), shift))
        samples.append(_numbered(piece.samples, shift))
        offset += piece.parts
    k = max(piece.k for piece in pieces)
    known = reduce(DataFrame.unionByName, formats).groupBy("source_path").agg(F.min_by("format", "part").alias("format"))
    rows = reduce(DataFrame.unionByName, samples)
    order = [F.col("part"), F.col("position")]
    first = first_k(rows, ["source_path", "kind"], order, k, rank="_place", spread=False)
    kept = first.withColumn("position", F.col("_place")).withColumn("part", F.lit(0)).drop("_place")
    return SummaryParts(merge_tallies(tallies), known, kept, k, offset)


def _part_of(frame: DataFrame) -> list[str]:
    return ["part"] if "part" in frame.columns else []


def _numbered(frame: DataFrame, shift: Column) -> DataFrame:
    own = F.col("part") if "part" in frame.columns else F.lit(0)
    return frame.withColumn("part", (own + shift).cast("int"))


def merge_summaries(pieces: list[SummaryParts]) -> DataFrame:
    """SUMMARY over several parts, equal to one run over all their lines."""
    return assemble_parts(merge_parts(pieces))


def assemble_parts(piece: SummaryParts) -> DataFrame:
    return _assemble(piece.tallies, piece.formats, _sample_arrays(piece.samples))


def _assemble(tallies: DataFrame, formats: DataFrame, samples: DataFrame) -> DataFrame:
    """Tallies + formats + sample arrays -> SUMMARY. Inputs are small: keys, not lines."""
    place = [F.col(c) for c in ("part", "first_line") if c in tallies.columns]
    ranked = _top_keys(tallies.where(F.col("kind").isin(*_RANKED)), place, TOP_K)
    mapped = _top_keys(tallies.where(F.col("kind").isin(*_MAPPED)), place, MAP_KEYS)
    closed = tallies.where(F.col("kind") == "line").withColumn("place", F.lit(None).cast("int"))
    # Errors and the rest of a map come from sums over all keys, also those that the map leaves out.
    sums = tallies.where(F.col("kind").isin(*_MAPPED)).groupBy("source_path").agg(
        F.coalesce(F.sum(F.when((F.col("kind") == "level") & is_error(F.col("key")), F.col("n"))), F.lit(0)).alias("_errors"),
        *[F.coalesce(F.sum(F.when(F.col("kind") == name, F.col("n"))), F.lit(0)).alias(f"_all_{name}") for name in _MAPPED],
    )
    rows = closed.unionByName(ranked).unionByName(mapped)
    kind = F.col("kind")

    def lines(outcome: str) -> Column:
        return F.coalesce(F.sum(F.when((kind == "line") & (F.col("key") == outcome), F.col("n"))), F.lit(0))

    def counter(name: str) -> Column:
        return F.collect_list(F.when(kind == name, F.struct("key", "n")))

    def bounded(name: str) -> Column:
        """At most MAP_KEYS keys, the counts of all others under OTHER_KEYS."""
        left = F.col(f"_all_{name}") - F.aggregate(f"_{name}", F.lit(0).cast("bigint"), lambda a, e: a + e["n"])
        rest = F.array(F.struct(F.lit(OTHER_KEYS).alias("key"), left.alias("n")))
        return F.map_from_entries(F.when(left > 0, F.concat(f"_{name}", rest)).otherwise(F.col(f"_{name}")))

    def listed(name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(kind == name, F.struct("place", "key", "n"))))

    wide = rows.groupBy("source_path").agg(
        lines("blank").alias("blank_lines"),
        lines("parsed").alias("parsed_lines"),
        lines("failed").alias("failed_lines"),
        F.min(F.when(kind == "line", F.col("earliest_ts"))).alias("earliest_ts"),
        F.max(F.when(kind == "line", F.col("latest_ts"))).alias("latest_ts"),
        counter("level").alias("_level"),
        counter("status").alias("_status"),
        listed("error").alias("_top_errors"),
        listed("source").alias("_top_sources"),
    )
    picked = samples.groupBy("source_path").agg(
        F.max_by("entries", F.when(kind == "error", 1)).alias("errors"),
        F.max_by("entries", F.when(kind == "warning", 1)).alias("warnings"),
    )
    total = F.col("blank_lines") + F.col("parsed_lines") + F.col("failed_lines")
    none = F.array().cast(samples.schema["entries"].dataType)
    return (
        wide.join(sums, "source_path", "left")
        .join(formats.select("source_path", "format"), "source_path", "left")
        .join(picked, "source_path", "left")
        .select(
            "source_path",
            F.col("format").alias("detected_format"),
            total.alias("total_lines"),
            "blank_lines",
            "parsed_lines",
            "failed_lines",
            error_rate(F.coalesce("_errors", F.lit(0)), F.col("parsed_lines")).alias("error_rate"),
            parse_success_rate(F.col("parsed_lines"), total).alias("parse_success_rate"),
            "earliest_ts",
            "latest_ts",
            F.floor(span_micros(F.col("earliest_ts"), F.col("latest_ts")) / 1_000_000)
            .cast("bigint")
            .alias("span_seconds"),
            bounded("level").alias("level_counts"),
            bounded("status").alias("status_codes"),
            F.transform("_top_errors", lambda x: F.struct(x["key"].alias("message"), x["n"].alias("count"))).alias(
                "top_errors"
            ),
            F.transform("_top_sources", lambda x: F.struct(x["key"].alias("source"), x["n"].alias("count"))).alias(
                "top_sources"
            ),
            F.coalesce("errors", none).alias("errors"),
            F.coalesce("warnings", none).alias("warnings"),
        )
    )


def _top_keys(tallies: DataFrame, place: list[Column], k: int) -> DataFrame:
    """The ``k`` most frequent keys of each source and kind, ties in order of appearance, with their ``place``."""
    return first_k(tallies, ["source_path", "kind"], [F.col("n").desc(), *place, F.col("key")], k, rank="place", spread=False)


def long_counts(tallies: DataFrame, kind: str, name: str) -> DataFrame:
    """(source_path, <name>, n) of every key of a kind, one row each: what the bounded maps of a summary leave out too."""
    return tallies.where(F.col("kind") == kind).select("source_path", F.col("key").alias(name), "n")


def activity(tallies: DataFrame) -> DataFrame:
    """(source_path, event_ts_local, n): errors and warnings per slot, from tallies made with a ``bucket``."""
    slots = tallies.where(F.col("kind") == "activity")
    return slots.select("source_path", F.col("key").cast("timestamp_ntz").alias("event_ts_local"), "n")


def _sample_arrays(samples: DataFrame) -> DataFrame:
    """Bounded samples -> (source_path, kind, entries in file order)."""
    entry = F.struct("line_id", "event_ts", "event_ts_local", "level", "message", "source", "raw")
    return (
        samples.groupBy("source_path", "kind")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("position"), entry.alias("entry")))).alias("all"))
        .select("source_path", "kind", F.transform("all", lambda x: x["entry"]).alias("entries"))
    )


def summary_parts(
    lines: DataFrame,
    fmt: str | None = None,
    k: int = DEFAULT_SAMPLES,
    use_fallback: bool = True,
    skip_blank: bool = False,
    registry: FormatRegistry = DEFAULT_REGISTRY,
    found: DataFrame | None = None,
    bucket: str | None = None,
) -> SummaryParts:
    """LINES -> what their summary is made of. Runs the detection job and the counting job.

    ``found`` holds formats detected already, as :func:`emberlog.operators.detect.detect_files` gives them.
    With ``bucket`` the tallies also hold the errors and warnings over time.
    """
    if fmt is None:
        found = detect_format(lines, skip_blank=skip_blank, registry=registry) if found is None else found
        formats = materialize(with_fallback(found.select("source_path", "format"), use_fallback))
        names = formats_in_use(formats)
        if not names:
            names = [registry.all()[-1].name]
        marked = attach_format(lines, formats)
    else:
        registry.get(fmt)
        names = [fmt]
        marked = lines.withColumn("format", F.lit(fmt))
        formats = None
    content = marked.where(~is_blank(F.col("raw")))
    if "block_start" in lines.columns:
        counted = materialize(tally(marked, names, registry, by_block=True, bucket=bucket))
        tallies = counted.where(~F.col("kind").isin(*_BY_BLOCK))
        content = content.join(broadcast_if_small(_sampled_blocks(counted, k)), ["source_path", "block_start"], "left_semi")
    else:
        tallies = materialize(tally(marked, names, registry, bucket=bucket))
    if formats is None:
        formats = tallies.select("source_path").distinct().withColumn("format", F.lit(fmt))
    return SummaryParts(tallies, formats, severity_samples(parse_marked(content, names, registry), k), k)


def _sampled_blocks(counted: DataFrame, k: int) -> DataFrame:
    """(source_path, block_start) of the blocks that hold the first ``k`` errors or warnings of a source.

    Line ids grow with block starts, so the samples lie in the blocks before which fewer than ``k`` were counted.
    """
    earlier = (
        Window.partitionBy("source_path", "kind").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    blocks = counted.where(F.col("kind").isin(*_BY_BLOCK)).withColumn("block_start", F.col("key").cast("bigint"))
    needed = blocks.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where(F.col("_before") < k)
    return materialize(needed.select("source_path", "block_start").distinct())


def summarize(
    lines: DataFrame,
    fmt: str | None = None,
    k: int = DEFAULT_SAMPLES,
    analytics: bool = False,
    bucket: str = "1h",
    use_fallback: bool = True,
    skip_blank: bool = False,
    registry: FormatRegistry = DEFAULT_REGISTRY,
    found: DataFrame | None = None,
) -> DataFrame:
    """LINES -> SUMMARY, one row per source.

    Runs the detection job and the counting job, stores both small results in the shared folder, and
    returns a frame that reads them. With ``analytics`` the columns temporal, hourly, trend_direction and
    peak_period are added, computed on all errors and warnings, also those beyond the ``k`` samples.
    """
    slots = (bucket or DEFAULT_BUCKET) if analytics else None
    parts = summary_parts(lines, fmt, k, use_fallback, skip_blank, registry, found, slots)
    if not analytics:
        return assemble_parts(parts)
    summary = assemble_parts(replace(parts, samples=materialize(parts.samples)))
    sources = parts.formats.select("source_path")
    active = activity(parts.tallies)
    extra = assemble_analytics(sources, temporal_distribution(active, bucket, "n"), hourly_distribution(active, "n"))
    return summary.join(extra, "source_path", "left")


def analyze(spark: SparkSession, paths: list[str] | str, **options) -> DataFrame:
    """Text files -> SUMMARY. Options as in :func:`summarize`. Formats are detected from the files' heads."""
    from ..sources.lines import read_lines

    if options.get("fmt") is None:
        wanted = {k: options[k] for k in ("skip_blank", "registry") if k in options}
        options["found"] = detect_files(spark, paths, **wanted)
    return summarize(read_lines(spark, paths), **options)
