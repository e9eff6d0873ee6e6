"""Session-level helpers: shared folder, lineage cuts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROW_LIMIT = 500_000
BROADCAST_BYTE_LIMIT = 64 << 20
SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="emberlog-"))
    return context.getCheckpointDir()


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings that suit the parsing plans.

    The JVM does not compile methods above 8000 bytes of code; with this limit Spark splits the long
    expressions of a parsing stage into methods that it does compile.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once, store in the shared folder, cut the lineage. Survives executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _row_bytes(df: DataFrame) -> Column:
    """A row's size as Spark would hold it, near enough for a bound: texts and lists by length, the rest by 8."""
    parts = [F.lit(16)]
    for field in df.schema.fields:
        kind, column = field.dataType, F.col(f"`{field.name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(column), F.lit(0)))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            parts.append(16 * F.greatest(F.size(column), F.lit(0)))
        elif isinstance(kind, T.StructType):
            parts.append(F.lit(16 * len(kind.fields)))
        else:
            parts.append(F.lit(8))
    return reduce(lambda a, b: a + b, parts).cast("bigint")


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, most_bytes: int = BROADCAST_BYTE_LIMIT) -> bool:
    """Whether a frame keeps within both bounds. Looks at ``limit + 1`` rows at most; pass a materialized frame."""
    rows, size = df.select(_row_bytes(df).alias("b")).limit(limit + 1).agg(F.count(F.lit(1)), F.sum("b")).first()
    return rows <= limit and (size or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT, most_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Hint a broadcast only when counted rows and bytes are bounded; otherwise leave the choice to Spark."""
    return F.broadcast(df) if fits_broadcast(df, limit, most_bytes) else df


def lookup_join(rows: DataFrame, side: DataFrame, key: str, how: str = "left", salt: Column | None = None) -> DataFrame:
    """Join rows with one ``side`` row per key; a hot key is never gathered into one task.

    A small side is broadcast. Beyond the bounds each of its rows is copied SALTS times and the many rows are
    dealt over the copies, so a key that holds a third of all rows spreads over SALTS tasks.
    """
    if fits_broadcast(side):
        return rows.join(F.broadcast(side), key, how)
    slot = F.pmod(F.xxhash64(salt if salt is not None else F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    copies = side.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_slot", slot).join(copies, [key, "_slot"], how).drop("_slot")


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Keep the named columns as computed values that later filters look at.

    Spark moves a filter below a projection by copying the column's expression into it; for a parsed
    field that repeats the parsing. A filter on a column that comes out of ``explode`` stays above it.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c not in names]
    packed = F.explode(F.array(F.struct(*names))).alias("_settled")
    kept = df.select(*others, packed)
    return kept.select(*[F.col(f"_settled.{c}").alias(c) if c in names else F.col(f"`{c}`") for c in df.columns])
