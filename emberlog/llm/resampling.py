"""Importance resampling towards a target distribution, by hashed n-gram features and Gumbel top-k."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.runtime import broadcast_if_small, materialize

from .common import flat, pick, slices, with_position

SLICE = 4 << 20
BLOCK = 1 << 19
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[~_WORD[_LOWER]] = 0x20
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


class Words:
    """Lower-cased words of a batch of texts, one space between words, and the n-grams they form."""

    def __init__(self, texts: pa.Array) -> None:
        data, starts = flat(texts)
        data = _LOWER[data]
        word = data != 0x20
        edge = np.zeros(len(data) + 1, bool)
        edge[starts] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word.copy()
        end[:-1] &= ~word[1:] | edge[1:-1]
        keep = word.copy()
        keep[1:] |= word[:-1]
        place = np.cumsum(keep) - 1
        first = np.flatnonzero(begin)
        self.begins, self.ends = place[first], place[np.flatnonzero(end)] + 1
        self.bounds = np.searchsorted(first, starts)
        self.bytes = data[keep].tobytes() + bytes(8)

    def count(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.bounds)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of each run of n words, and where each text's runs start among them."""
        runs = np.maximum(self.count() - (n - 1), 0)
        bounds = np.concatenate([[0], np.cumsum(runs)])
        if n == 1:
            return self.begins, self.ends, bounds
        first = np.arange(bounds[-1]) + np.repeat(self.bounds[:-1] - bounds[:-1], runs)
        return self.begins[first], self.ends[first + n - 1], bounds


class GramTable:
    """Open-addressed table of the distinct n-grams of one block.

    Keys are xxhash64 values; a slot also knows one occurrence, and an occurrence only settles in a slot whose bytes
    equal its own, so different n-grams with one hash take different slots. All occurrences probe together, one
    step a round. Slots store the bucket of their n-gram and its count.
    """

    def __init__(self, text: bytes, begins: np.ndarray, ends: np.ndarray, buckets: int, digest=xxhash.xxh64_intdigest) -> None:
        n = len(begins)
        view = memoryview(text)
        keys = np.fromiter((digest(view[b:e]) for b, e in zip(begins.tolist(), ends.tolist())), np.uint64, n)
        size = 1 << max(4, (2 * n).bit_length())
        mask = np.uint64(size - 1)
        owner = np.full(size, -1, np.int64)
        self.slot = (keys & mask).astype(np.int64)
        eight = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
        sizes = ends - begins
        waiting = np.arange(n)
        while len(waiting):
            at = self.slot[waiting]
            free = owner[at] < 0
            owner[at[free]] = waiting[free]
            holder = owner[at]
            same = keys[holder] == keys[waiting]
            same[same] = _equal(eight, begins, sizes, holder[same], waiting[same])
            waiting = waiting[~same]
            self.slot[waiting] = (self.slot[waiting] + 1) & (size - 1)
        self.counts = np.bincount(self.slot, minlength=size)
        self.bucket = np.zeros(size, np.int64)
        used = np.flatnonzero(owner >= 0)
        held = owner[used]
        pairs = zip(begins[held].tolist(), ends[held].tolist())
        self.bucket[used] = np.fromiter((zlib.crc32(view[b:e]) % buckets for b, e in pairs), np.int64, len(used))

    def histogram(self, buckets: int) -> np.ndarray:
        """Occurrences of each bucket."""
        used = np.flatnonzero(self.counts)
        return np.bincount(self.bucket[used], self.counts[used], buckets).astype(np.int64)


def _equal(eight: np.ndarray, begins: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether occurrences a and b hold the same bytes, eight at a time."""
    same = sizes[a] == sizes[b]
    live = np.flatnonzero(same & (a != b))
    done = 0
    while len(live):
        left = np.minimum(sizes[a[live]] - done, 8)
        differ = ((eight[begins[a[live]] + done] ^ eight[begins[b[live]] + done]) & _TAIL[left]) != 0
        same[live[differ]] = False
        live = live[~differ & (sizes[a[live]] > done + 8)]
        done += 8
    return same


def tables(words: Words, max_n: int, buckets: int) -> Iterator[tuple[GramTable, np.ndarray]]:
    """A table for each block of occurrences, and the number of the text each occurrence stands in.

    Blocks keep the table's size bounded however long a text is.
    """
    for n in range(1, max_n + 1):
        begins, ends, bounds = words.grams(n)
        for a in range(0, len(begins), BLOCK):
            b = min(a + BLOCK, len(begins))
            yield GramTable(words.bytes, begins[a:b], ends[a:b], buckets), np.searchsorted(bounds, np.arange(a, b), side="right") - 1


def bucket_counts(docs: DataFrame, max_n: int, buckets: int) -> dict[int, int]:
    """Features of a frame (doc_id, text) by bucket; each task sends at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, 0, SLICE):
            for table, _ in tables(Words(part.column(0)), max_n, buckets):
                total += table.histogram(buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket bigint, n bigint")
    return {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """Thousandfold log ratio of smoothed bucket shares, target over source, rounded down."""
    s, t = float(sum(source.values())), float(sum(target.values()))
    ratio = lambda b: (target.get(b, 0) + 1.0) * (s + buckets) / ((source.get(b, 0) + 1.0) * (t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of (doc_id, text)."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            words = Words(part.column(1))
            n, weight = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
            for table, owner in tables(words, max_n, buckets):
                sums = np.concatenate([[0], np.cumsum(gain[table.bucket[table.slot]])])
                first = np.searchsorted(owner, np.arange(part.num_rows + 1))
                n += np.diff(first)
                weight += np.diff(sums[first])
            arrays = [part.column(0), pa.array(words.count().astype(np.int64)), pa.array(n), pa.array(weight)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    max_n: int = 1,
    buckets: int = 10_000,
    least_words: int = 20,
    num: int = 10,
    den: int = 100,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_features``, ``weight``, ``score``, ``rank``.

    Features are runs of 1 to ``max_n`` consecutive words, hashed to buckets. A bucket's gain compares its share in
    ``target`` with its share in ``docs``; a document's weight is the sum over its features. The score adds Gumbel
    noise derived from ``seed`` and id, so the num / den best of the documents with at least ``least_words``
    words are a draw without replacement by importance. ``rank`` is 1 for the best, null for the rest.

    Two scans of the texts, which are never shuffled; the driver holds one number a bucket. Ranks come from a range
    sort of ids and scores.

    Null, empty and wordless texts have no features and weight 0. Repeated rows each take part; equal scores go to
    the smaller id, a null id first. Without a target text all gains follow from smoothing alone. An empty table
    gives an empty result. Other columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    wanted = pick(target, target_col).toDF("text")
    gain = gains(bucket_counts(rows, max_n, buckets), bucket_counts(wanted, max_n, buckets), buckets)
    weighed = weigh(rows, gain, max_n)
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise).withColumn("_in", F.col("n_words") >= least_words))
    drawn = scored.where("_in").count() * num // den
    placed = with_position(scored, [F.col("_in").desc(), F.col("score").desc(), F.col("doc_id").asc()], "_at")
    rank = F.when(F.col("_in") & (F.col("_at") < drawn), F.col("_at") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


def drawn_documents(docs: DataFrame, ranks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns. Rows that share an id come together."""
    names = list(docs.columns)
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    ids = materialize(ranks.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn")).distinct())
    key = F.col(f"_c{names.index(id_col)}")
    return numbered.join(broadcast_if_small(ids), key.eqNullSafe(F.col("_drawn")), "left_semi").toDF(*names)
