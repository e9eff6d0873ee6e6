"""Mixing sources to target weights by Pfair scheduling of source blocks."""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.runtime import broadcast_if_small, materialize

from .common import place

BLOCK_BYTES = 1 << 16
RESOLUTION = 1000
ALPHA = 0.7
BUCKET_ROWS = 4096


def quantise(weights: list[float], resolution: int) -> list[int]:
    """Shares of ``resolution`` slots, by largest remainder; a positive weight gets one slot at least."""
    total = sum(weights)
    exact = [w / total * resolution for w in weights]
    shares = [max(1, int(x)) if w > 0 else 0 for x, w in zip(exact, weights)]
    order = sorted(range(len(weights)), key=lambda i: exact[i] - shares[i])
    while sum(shares) > resolution:
        i = next(i for i in order if shares[i] > 1)
        shares[i] -= 1
        order.sort(key=lambda i: exact[i] - shares[i])
    for i in reversed(order):
        if sum(shares) < resolution and weights[i] > 0:
            shares[i] += 1
    if sum(shares) < resolution:
        shares[max(range(len(shares)), key=lambda i: exact[i])] += resolution - sum(shares)
    return shares


def schedule(shares: list[int]) -> list[tuple[int, int]]:
    """(source, block) for each slot of one period of sum(shares) slots.

    Block j of a source with share q of Q slots is released at floor(j Q / q) and due at ceil((j + 1) Q / q). The
    shares fill the period, so that taking the released block with the earliest deadline meets all deadlines, and
    each source's count stays less than one block from its fluid share at every slot.
    """
    period = sum(shares)
    waiting: dict[int, list[tuple[int, int, int]]] = {}
    for s, q in enumerate(shares):
        for j in range(q):
            waiting.setdefault(j * period // q, []).append((-(-(j + 1) * period // q), s, j))
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(period):
        for job in waiting.get(slot, ()):
            heapq.heappush(ready, job)
        deadline, s, j = heapq.heappop(ready)
        if deadline <= slot:
            raise RuntimeError("a deadline was missed")
        out.append((s, j))
    return out


def plan(docs: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, block_bytes: int, resolution: int) -> DataFrame:
    """``docs`` (columns _c0.., _source, _bytes, _id) with block, slot and in_mix."""
    spark = docs.sparkSession
    catalogue = docs.groupBy("_source").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("size"))
    sources = sorted(catalogue.collect(), key=lambda r: (r._source is not None, r._source or ""))  # one row a source
    names = [r._source for r in sources]
    if weights is None:
        wanted = [float(r.size) ** alpha for r in sources]
    else:
        wanted = [float(weights.get(n, 0.0)) for n in names]
        if any(w < 0 for w in wanted):
            raise ValueError("weights must not be negative")
    slots = max(resolution, 20 * len(names))
    shares = quantise(wanted, slots) if sum(wanted) > 0 else [0] * len(names)
    table = schedule(shares) if sum(shares) else []
    place_of: dict[int, list[int]] = {}
    for slot, (s, _) in enumerate(table):
        place_of.setdefault(s, []).append(slot)
    rows = [
        (names[s] is None, names[s] or "", shares[s], max(1, -(-r.n // BUCKET_ROWS)), place_of.get(s, []))
        for s, r in enumerate(sources)
    ]
    kinds = "_null boolean, _name string, _share bigint, _buckets bigint, _slots array<int>"
    shared = F.broadcast(spark.createDataFrame(rows, kinds))  # as many slots as the period has
    on = [F.col("_source").isNull() == F.col("_null"), F.coalesce("_source", F.lit("")) == F.col("_name")]
    rows = docs.join(shared, on).withColumn("_hash", F.xxhash64("_id", "_source", "_bytes"))
    # A source's order is by hash; its buckets of the hash range keep hot sources in many window partitions.
    spread = F.shiftrightunsigned(F.col("_hash").bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")), 33)
    rows = rows.withColumn("_bucket", F.shiftright(spread * F.col("_buckets"), 31))
    keys = ["_null", "_name", "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("_bytes").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_null", "_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = materialize(sums.select(*keys, F.coalesce(before, F.lit(0)).alias("_before")))
    inside = Window.partitionBy(*keys).orderBy("_hash", "_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_inside", F.coalesce(F.sum("_bytes").over(inside), F.lit(0)))
    rows = rows.join(broadcast_if_small(sums, 100_000), keys)
    block = F.floor((F.col("_before") + F.col("_inside")) / F.lit(block_bytes)).cast("bigint")
    rows = rows.withColumn("_block", block)
    turn = (F.col("_block") / F.col("_share")).cast("bigint")
    slot = turn * F.lit(len(table)) + F.element_at("_slots", (F.col("_block") % F.col("_share") + 1).cast("int"))
    rows = rows.withColumn("_slot", F.when(F.col("_share") > 0, slot))
    # The mixture ends before the first slot whose source has no block left for it.
    ends = []
    for s, r in enumerate(sources):
        if shares[s]:
            blocks = -(-int(r.size) // block_bytes)
            ends.append(blocks // shares[s] * len(table) + place_of[s][blocks % shares[s]])
    return rows.withColumn("_in_mix", F.coalesce(F.col("_slot") < F.lit(min(ends, default=0)), F.lit(False)))


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    at = lambda name: F.col(f"_c{place(docs.columns, name)}")
    return numbered.withColumns(
        {
            "_id": at(id_col),
            "_source": at(source_col).cast("string"),
            "_bytes": F.coalesce(F.octet_length(at(text_col)), F.lit(0)).cast("bigint") + 1,
        }
    )


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    alpha: float = ALPHA,
    block_bytes: int = BLOCK_BYTES,
    resolution: int = RESOLUTION,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, ``n_bytes``, ``block``, ``slot``, ``in_mix``.

    Each source's documents, in an order by hash, are cut into blocks of ``block_bytes`` (a document counts its
    bytes and one more, and belongs to the block that it starts in). Blocks are scheduled as in
    :func:`schedule`, with shares of ``resolution`` slots from ``weights``, or from the sources' sizes to the power
    ``alpha``. ``slot`` is the block's turn in the mixture. The mixture, ``in_mix``, ends at the first turn for
    which a source has no block: up to there every prefix holds the target weights to less than one block.
    Later documents keep their slot, so that a caller with other needs can go on.

    Exact weights are rounded to the resolution. A source that ``weights`` lacks, or has at 0, has null slots. A
    null source is a source. Null texts count one byte. Repeated rows are scheduled each, ties in no set order. An
    empty table gives an empty result. Other columns are ignored.
    """
    rows = plan(_prepared(docs, id_col, text_col, source_col), weights, alpha, block_bytes, resolution)
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_source").alias("source"),
        (F.col("_bytes") - 1).alias("n_bytes"),
        F.col("_block").alias("block"),
        F.col("_slot").alias("slot"),
        F.col("_in_mix").alias("in_mix"),
    )


def mixture(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All documents of sources with a share, with all their columns, sorted by slot over the partitions.

    Once a source has run dry the others go on in the order of their slots, so no document goes. Sources that
    ``weights`` lacks, or has at 0, are left out.
    """
    rows = plan(_prepared(docs, "doc_id", "text", "source"), weights, alpha, block_bytes, RESOLUTION)
    ordered = rows.where("_slot IS NOT NULL").repartitionByRange("_slot", "_hash").sortWithinPartitions("_slot", "_hash", "_id")
    return ordered.select(*[f"_c{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def deviation(slots: list[int], shares: list[int]) -> Fraction:
    """The largest distance of any source from its fluid share over all prefixes of a slot sequence."""
    counts, worst, total = [0] * len(shares), Fraction(0), sum(shares)
    for t, s in enumerate(slots, 1):
        counts[s] += 1
        for i, q in enumerate(shares):
            worst = max(worst, abs(counts[i] - Fraction(t * q, total)))
    return worst
