"""Connected components as joins, and exact similarity inside candidate clusters of bounded size."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.runtime import broadcast_if_small, materialize

from .common import release

MEMBERS = 2048
ENTRIES = 2_000_000
SMALL = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all ends of the edges (u, v): root is the least node that can be reached.

    Alternates the large-star and small-star steps until nothing changes, about the logarithm of the longest
    path. Each step is a minimum by node and a join with it; the edges never grow in number.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    pairs = materialize(pairs)
    seen = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        state = pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def deal(members: DataFrame, size: str, ratio: float, most: int = MEMBERS, entries: int = ENTRIES) -> DataFrame:
    """Deal cluster members to tasks: adds ``band``, ``i``, ``j``, ``part`` and ``side`` to rows (node, root, ...).

    A cluster within ``most`` rows and ``entries`` set entries is one task. A larger one, if its sets have more than SMALL
    entries on average (smaller ones cost less to copy than to class), is first cut by set size: sets that differ in size by more than ``ratio`` cannot be similar, so classes of that ratio only meet
    themselves and the next class, whose rows come along as ``side`` 1. A task that is still larger is cut into
    blocks by node hash, and each pair of blocks is a task. No pair is lost and no task is larger.
    """
    need = F.greatest(F.count(F.lit(1)) / most, F.sum(size) / entries)
    totals = members.groupBy("root").agg(((need > 1) & (F.avg(size) > SMALL)).alias("_large"))
    rows = members.join(broadcast_if_small(totals, 100_000), "root")
    own = F.floor(F.log(F.col(size)) / math.log(ratio)).cast("int")
    at = lambda band, side: F.struct(band.alias("band"), F.lit(side).alias("side"))
    places = F.when(F.col("_large"), F.array(at(own, 0), at(own - 1, 1))).otherwise(F.array(at(F.lit(0), 0)))
    rows = rows.withColumn("_place", F.explode(places)).select(*members.columns, "_place.*")
    groups = rows.groupBy("root", "band").agg(need.alias("_need"), F.min("side").alias("_first"))
    groups = groups.where("_first = 0").select("root", "band", F.when(F.col("_need") <= 1, 1).otherwise(F.ceil(2 * F.col("_need"))).cast("int").alias("_blocks"))
    rows = rows.join(broadcast_if_small(groups, 100_000), ["root", "band"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.withColumn("i", F.least("part", "_other")).withColumn("j", F.greatest("part", "_other"))
    return rows.drop("_blocks", "_other")


#: What a task's rows start with.
TASK = ["root", "band", "i", "j", "part", "side", "node"]


class Overlaps:
    """Exact overlaps among sorted sets by an inverted index, which takes the place of the list ``sets``."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.ends = np.cumsum(self.sizes)
        flat = np.concatenate(sets)
        sets.clear()
        order = np.argsort(flat, kind="stable").astype(np.int32 if len(flat) < 1 << 31 else np.int64)
        new = np.ones(len(flat), bool)
        flat = flat[order]
        np.not_equal(flat[1:], flat[:-1], out=new[1:])
        del flat
        self.posting = np.repeat(np.arange(self.n, dtype=np.int32), self.sizes)[order]
        self.token = np.empty(len(order), np.int32)
        self.token[order] = np.cumsum(new, dtype=np.int32) - 1
        self.first = np.flatnonzero(new)
        self.count = np.diff(np.append(self.first, len(new)))

    def with_member(self, i: int) -> np.ndarray:
        """Number of common elements of set i with each set."""
        tokens = self.token[self.ends[i] - self.sizes[i] : self.ends[i]]
        tokens = tokens[self.count[tokens] > 1]
        if not len(tokens):
            return np.zeros(self.n, np.int64)
        n, first = self.count[tokens], self.first[tokens]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.posting[np.repeat(first, n) + inside], minlength=self.n)

    def partners(self, i: int, num: int, den: int, part: np.ndarray, side: np.ndarray, cross: bool) -> np.ndarray:
        """As :meth:`similar`, only the pairs that this task is there for."""
        near = self.similar(i, num, den)
        if cross:
            near = near[part[near] != part[i]]
        return near[side[near] == 0] if side[i] else near

    def similar(self, i: int, num: int, den: int) -> np.ndarray:
        """Members other than i whose Jaccard similarity with it is num / den or more."""
        common = self.with_member(i)
        ok = (common > 0) & (den * common >= num * (self.sizes[i] + self.sizes - common))
        ok[i] = False
        return np.flatnonzero(ok)


def task_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """Rows (as lists of columns) of each run of equal values in the first ``keys`` columns; runs may cross batches.

    Nothing else holds the columns, so a caller that empties the list frees them.
    """
    held: list[pa.RecordBatch] = []

    def columns() -> list:
        table = pa.Table.from_batches(held)
        held.clear()
        return [c.combine_chunks() for c in table.columns]

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            here = tuple(key[:, a])
            if held and here != last:
                yield columns()
            last = here
            held.append(batch.slice(a, b - a))
    if held:
        yield columns()
    release()


def taken_sets(group: list, at: np.ndarray) -> list[np.ndarray]:
    """Rows ``at`` of the last column, lists, as unsigned 64-bit arrays without copies; the group is emptied."""
    column = group[-1]
    group.clear()
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    every = np.split(values, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))[:-1])
    return [every[k] for k in at]


class Forest:
    """Union by least index, to turn links into a spanning forest before they leave a task."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> bool:
        a, b = self.root(i), self.root(j)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def verify(dealt: DataFrame, body: Callable, schema: str) -> DataFrame:
    """Run ``body`` over each task of rows (TASK, ..., set), streamed in order of task."""
    ordered = dealt.repartition(*TASK[:4]).sortWithinPartitions(*TASK[:4], "node")
    return ordered.mapInArrow(body, schema)
