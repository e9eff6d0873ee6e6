"""Format detection from the first lines of every source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import DEFAULT_REGISTRY, FormatRegistry
from ..formats.base import Line, LogFormat
from ..functions.text import WHITESPACE, is_blank, strip
from ..functions.variants import parse_object
from ..schema import DETECT_SAMPLE, FALLBACK_FORMAT
from .ranking import first_k


def detect_format(
    lines: DataFrame,
    sample: int = DETECT_SAMPLE,
    skip_blank: bool = False,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> DataFrame:
    """One row per source: (source_path, format, hits); format is null when nothing matched.

    Every format counts the sampled lines it accepts and parses. Most hits win; a tie goes to the
    format whose first hit came first, then to registry order. ``skip_blank`` samples non-blank lines.
    The sample is a bounded pick per source, the scoring one aggregation over it.
    """
    pool = lines.where(~is_blank(F.col("raw"))) if skip_blank else lines
    head = first_k(pool.select("source_path", "line_id", "raw"), ["source_path"], [F.col("line_id")], sample)
    return score_formats(head, registry)


def detect_files(
    spark: SparkSession,
    paths: list[str] | str,
    sample: int = DETECT_SAMPLE,
    skip_blank: bool = False,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> DataFrame:
    """:func:`detect_format` for text files, of which only the first lines are read.

    Files that hold no line have no row. Where only Spark can open the files, all their lines are scanned.
    """
    from ..sources.heads import read_heads
    from ..sources.lines import read_lines

    heads = read_heads(spark, paths, sample, WHITESPACE if skip_blank else None)
    if heads is None:
        return detect_format(read_lines(spark, paths), sample, skip_blank, registry)
    return score_formats(heads.select("source_path", "line_id", "raw"), registry)


def score_formats(head: DataFrame, registry: FormatRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """Score sampled lines (source_path, line_id, raw) against every format."""
    formats = registry.detectable()
    read = head.withColumn("_text", strip(F.col("raw"))).withColumn("_doc", parse_object(F.col("_text"), "{["))
    flags = {f"_m{i}": fmt.matches(_shared_line(fmt)) for i, fmt in enumerate(formats)}
    matched = read.select("source_path", "line_id", *[flag.alias(name) for name, flag in flags.items()])
    tallies = []
    for name in flags:
        tallies.append(F.count_if(F.col(name)).alias(f"{name}_hits"))
        tallies.append(F.min(F.when(F.col(name), F.col("line_id"))).alias(f"{name}_first"))
    scored = matched.groupBy("source_path").agg(*tallies)
    candidates = F.array(
        *[
            F.struct(
                F.col(f"_m{i}_hits").alias("hits"),
                (-F.col(f"_m{i}_first")).alias("earliness"),
                F.lit(-i).alias("rank"),
                F.lit(fmt.name).alias("format"),
            )
            for i, fmt in enumerate(formats)
        ]
    )
    best = scored.select("source_path", F.array_max(candidates).alias("best"))
    found = F.col("best.hits") > 0
    return best.select(
        "source_path",
        F.when(found, F.col("best.format")).alias("format"),
        F.col("best.hits").alias("hits"),
    )


def _shared_line(fmt: LogFormat) -> Line:
    """A line whose trimmed text and JSON value are shared by all formats that look at them."""
    pieces = {}
    if fmt.trims:
        pieces["text"] = F.col("_text")
    if fmt.openers:
        opens = reduce(lambda a, b: a | b, [F.col("_text").startswith(o) for o in fmt.openers])
        pieces["doc"] = F.when(opens, F.col("_doc"))
    return Line(fmt, F.col("raw"), **pieces)


def with_fallback(formats: DataFrame, use_fallback: bool = True) -> DataFrame:
    """Undetected sources become ``universal``, or raise an error when the job runs."""
    if use_fallback:
        chosen = F.coalesce(F.col("format"), F.lit(FALLBACK_FORMAT))
    else:
        problem = F.concat(F.lit("Could not detect log format for: "), F.col("source_path"))
        chosen = F.when(F.col("format").isNull(), F.raise_error(problem)).otherwise(F.col("format"))
    return formats.withColumn("format", chosen)


def force_format(lines: DataFrame, fmt: str, registry: FormatRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """Every source gets the format the caller picked."""
    registry.get(fmt)
    return lines.select("source_path").distinct().withColumn("format", F.lit(fmt))


def format_catalogue(spark: SparkSession, registry: FormatRegistry = DEFAULT_REGISTRY) -> DataFrame:
    rows = [(f.name, f.description, position) for position, f in enumerate(registry.all())]
    return spark.createDataFrame(rows, "name string, description string, priority int")
