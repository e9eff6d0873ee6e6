"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.runtime import broadcast_if_small, materialize

SLICE_BYTES = 2 << 20
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code(spark: SparkSession) -> None:
    """Send this package to the executors, unless their Python finds it already (PYTHONPATH or working folder)."""
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if str(root) in [os.path.realpath(p) for p in known if p] or getattr(context, "_corpus_code_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="emberlog-code-")) / "emberlog.zip"  # the driver's file server sends it out
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted((root / "emberlog").rglob("*.py")):
            out.write(file, file.relative_to(root))
    context.addPyFile(str(archive))
    context._corpus_code_sent = True


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def place(columns: list[str], name: str) -> int:
    """Position of a column: the exact spelling first, then one that differs in case only."""
    if name in columns:
        return columns.index(name)
    lower = [c.lower() for c in columns]
    if name.lower() in lower:
        return lower.index(name.lower())
    raise ValueError(f"no column {name!r} in {columns}")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by position, so that other columns may clash with anything."""
    columns = list(df.columns)
    numbered = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    return numbered.select(*[F.col(f"_c{place(columns, n)}").alias(n) for n in names])


def row_key(id_column: Column, text: Column) -> Column:
    """What tells rows apart: id and text, by hash. Only copies share a key; keys without an id come last."""
    return F.struct(id_column.isNull().alias("absent"), id_column.alias("id"), F.xxhash64(text).alias("hash"))


def mark_copies(rows: DataFrame, keys: list[str], shared: DataFrame) -> DataFrame:
    """Adds ``_again``: true for all rows but one of each key in ``shared``, false for the others.

    Only rows of those keys are stored, numbered and joined with the least number of their key; none is gathered.
    """
    if shared.isEmpty():
        return rows.withColumn("_again", F.lit(False))
    on = shared.toDF(*[f"_s{i}" for i in range(len(keys))])
    same = [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate(keys)]
    side = broadcast_if_small(on, 200_000)
    many = materialize(rows.join(side, same, "left_semi").withColumn("_row", F.monotonically_increasing_id()))
    least = many.groupBy(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)]).agg(F.min("_row").alias("_first"))
    many = many.join(broadcast_if_small(materialize(least), 200_000), same).withColumn("_again", F.col("_row") > F.col("_first"))
    rest = rows.join(side, same, "left_anti").withColumn("_again", F.lit(False))
    return rest.unionByName(many.select(*rest.columns))


def release() -> None:
    """Give freed memory back to the system: Python workers live on from task to task, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def in_small_batches(work: Callable) -> Callable:
    """Let all that ``work(docs, ...)`` runs at once hand rows to Python in batches of BATCH_BYTES at most.

    Executor and worker both hold a batch, and lists of whole sets fill the usual one of 64 MB. The session's own
    setting is put back at the end.
    """

    @functools.wraps(work)
    def run(docs: DataFrame, *args, **kwargs):
        conf = docs.sparkSession.conf
        before = conf.get(BATCH_SETTING)
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
        try:
            return work(docs, *args, **kwargs)
        finally:
            conf.set(BATCH_SETTING, before)

    return run


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each slice hold about ``limit`` bytes; a long text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_bytes(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()
    release()


def text_bytes(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text, 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in one array, and where each text starts (one more entry for the end)."""
    whole = pc.fill_null(texts, "").cast(pa.large_binary())
    starts = np.frombuffer(whole.buffers()[1], dtype=np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = whole.buffers()[2]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def with_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based place of each row in the whole order, without a window over all rows.

    A range sort is stored, and each stored partition gets the number of rows before it. The sorted rows are stored.
    """
    stored = materialize(df.orderBy(*order).withColumn("_serial", F.monotonically_increasing_id()))
    part = F.shiftright("_serial", 33)
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    before = np.concatenate([[0], np.cumsum([r.n for r in sizes])]).tolist()
    starts = [(r._part, b) for r, b in zip(sizes, before)]
    side = df.sparkSession.createDataFrame(starts, "_part bigint, _before bigint")
    placed = stored.withColumn("_part", part).join(broadcast_if_small(side), "_part")
    inside = F.col("_serial").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, F.col("_before") + inside).drop("_part", "_serial", "_before")
