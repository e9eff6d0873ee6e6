"""Text files -> LINES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import DEFAULT_REGISTRY, FormatRegistry
from ..operators.detect import detect_files, with_fallback
from ..operators.entries import parse_entries
from ..operators.ranking import first_k
from ..runtime import materialize
from ..schema import DETECT_SAMPLE
from .heads import read_heads

MAX_PREVIEW = 500
_IN_TASK = (1 << 33) - 1


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """Lines of text files, plain or compressed; broken UTF-8 becomes U+FFFD.

    ``line_id`` grows in file order without any sort or shuffle. Every line takes at least one byte, so
    block start plus the line's number inside its task is larger for every later block: blocks of full
    size fill a task of their own, and only the last block of a file may share one.
    """
    if spark.conf.get("spark.sql.files.maxPartitionNum", None):
        raise ValueError("unset spark.sql.files.maxPartitionNum: it merges blocks and breaks line order")
    block = F.col("_metadata.file_block_start")
    return (
        spark.read.text(paths)
        .select(
            F.col("_metadata.file_path").alias("source_path"),
            block.alias("block_start"),
            ordered_ids(block).alias("line_id"),
            F.make_valid_utf8("value").alias("raw"),
        )
    )


def ordered_ids(block: Column) -> Column:
    """Line ids of lines as a file scan yields them, from the start of their block."""
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_TASK))
    return block + F.when(block > 0, 1).otherwise(0) + in_task


def head_lines(lines: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` raw lines per source, blank lines included, with their ``position``."""
    if not 1 <= n <= MAX_PREVIEW:
        raise ValueError(f"preview size must be within 1..{MAX_PREVIEW}")
    return first_k(lines, ["source_path"], [F.col("line_id")], n, rank="position")


def head_of_files(spark: SparkSession, paths: list[str] | str, n: int = 50) -> DataFrame:
    """:func:`head_lines` for text files, of which only the first lines are read."""
    if not 1 <= n <= MAX_PREVIEW:
        raise ValueError(f"preview size must be within 1..{MAX_PREVIEW}")
    heads = read_heads(spark, paths, n)
    if heads is None:
        return head_lines(read_lines(spark, paths), n)
    return heads.withColumn("position", (F.col("line_id") + 1).cast("int"))


def tail_lines(lines: DataFrame, n: int = 50) -> DataFrame:
    """Last ``n`` lines per source; ``position`` 1 is the last line."""
    return first_k(lines, ["source_path"], [F.col("line_id").desc()], n, rank="position")


def parse_files(
    spark: SparkSession,
    paths: list[str] | str,
    fmt: str | None = None,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> DataFrame:
    """Detect (unless ``fmt`` is given) and parse files; blank and failed lines are left out.

    Raises when the format of a file cannot be detected.
    """
    lines = read_lines(spark, paths)
    if fmt is not None:
        return parse_entries(lines, fmt=fmt, keep_failed=False, registry=registry)
    found = detect_files(spark, paths, DETECT_SAMPLE, registry=registry)
    formats = materialize(with_fallback(found, use_fallback=False))
    return parse_entries(lines, formats, keep_failed=False, registry=registry)
