"""Bounded picks: first rows per group, top-k, paging, order by severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import level_rank

_SPREAD = 256


def first_k(
    df: DataFrame, per: list[str], order: list[Column], k: int, rank: str | None = None, spread: bool = True
) -> DataFrame:
    """First ``k`` rows of every group, exact, safe when one group holds most rows.

    Step 1 ranks inside (group, task slot); each task passes on at most ``k`` rows of a group, and the
    slots spread those over many reducers. Step 2 ranks the few survivors per group. Both steps are
    planned with a rank limit before their shuffle. ``spread=False`` skips step 1 for input that an
    aggregation already shrank.
    """
    position = rank or "_rank"
    if spread:
        slot = Window.partitionBy(*per, "_slot").orderBy(*order)
        df = (
            df.withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(_SPREAD)))
            .withColumn("_rank", F.row_number().over(slot))
            .where(F.col("_rank") <= k)
            .drop("_rank", "_slot")
        )
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(
        F.col(position) <= k
    )
    return ranked if rank else ranked.drop(position)


def top_k(df: DataFrame, by: list[Column | str], k: int, per: str | None = None, rank: str | None = None) -> DataFrame:
    """Top ``k`` rows in the given order, overall or per group."""
    order = [F.col(c) if isinstance(c, str) else c for c in by]
    if per is None:
        return df.orderBy(*order).limit(k)
    return first_k(df, [per], order, k, rank=rank, spread=False)


def page(analyses: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    """One page of stored analyses, newest first."""
    return analyses.orderBy(F.col("created_at").desc(), F.col("id")).offset(skip).limit(limit)


def page_info(total: int, skip: int, limit: int) -> dict[str, int]:
    """Page number and page count for a listing."""
    return {"total": total, "page": skip // limit + 1, "page_size": limit, "total_pages": -(-total // limit)}


def recent(analyses: DataFrame, k: int = 3) -> DataFrame:
    return page(analyses, 0, k)


def last_buckets(buckets: DataFrame, k: int = 10) -> DataFrame:
    """Latest ``k`` buckets per source, returned with their order from old to new as ``position``."""
    newest = first_k(buckets, ["source_path"], [F.col("bucket").desc()], k, spread=False)
    return newest.withColumn(
        "position", F.row_number().over(Window.partitionBy("source_path").orderBy("bucket"))
    )


def busiest(counts: DataFrame, k: int, key: str) -> DataFrame:
    """Buckets or hours with the most entries; ties go to the earlier key."""
    return first_k(counts, ["source_path"], [F.col("n").desc(), F.col(key)], k, rank="position", spread=False)


def top_status(status: DataFrame, k: int = 10) -> DataFrame:
    """Status codes with the most lines; ties go to the code seen first."""
    return first_k(
        status, ["source_path"], [F.col("n").desc(), F.col("first_line"), F.col("status")], k, "position", False
    )


def severity_order(levels: DataFrame) -> DataFrame:
    """Add ``position``: CRITICAL first, other words last."""
    order = F.coalesce(F.lit(4) - level_rank(F.col("level")), F.lit(5))
    return levels.withColumn("severity", order.cast("int")).orderBy("source_path", "severity", "level")
