"""N-gram Jaccard join by partitions of the universe, the pigeonhole principle and exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.runtime import broadcast_if_small, materialize

from .clusters import TASK, Forest, Overlaps, components, deal, taken_sets, task_groups, verify
from .common import flat, in_small_batches, mark_copies, pick, place, row_key, slices
from .words import mix, word_hashes

SLICE = 2 << 20
RATIO = 1.25
#: A sketch counts a set's elements in so many parts of the universe (BIG ones in more, as counts of few tell little);
#: it is looked at from coarse to fine. A task compares SKETCHES of them.
COARSE, SKETCH, FINEST, BIG = 32, 256, 2048, 2048
SKETCHES = 8192
#: What the cost model takes for unrelated documents: the share of pairs that have much in common, and how much.
ALIKE_SHARE, ALIKE = 1e-4, 0.5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_KEEP = np.uint64((1 << 63) - 1)
_TOP = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's word shingles; with fewer words, of the whole sequence."""
    hashes, owner = word_hashes(*flat(texts))
    n = len(texts)
    bounds = np.searchsorted(owner, np.arange(n + 1))
    count = np.diff(bounds)
    combined = np.zeros(max(0, len(hashes) - shingle + 1), np.uint64)
    for j in range(shingle):
        combined += hashes[j : j + len(combined)] * (_ODD[j % 5] + np.uint64(2 * (j // 5)))
    combined = mix(combined)
    out = []
    for i in range(n):
        if count[i] >= shingle:
            out.append(np.unique(combined[bounds[i] : bounds[i + 1] - shingle + 1]))
        elif count[i]:
            words = hashes[bounds[i] : bounds[i + 1]]
            whole = (words * _ODD[np.arange(len(words)) % 5]).sum(dtype=np.uint64) ^ np.uint64(len(words))
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(one: np.ndarray) -> int:
    """A 63-bit identity of a set: equal sets have equal ids."""
    total = mix(one + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(one))
    return int(mix(np.array([total], np.uint64))[0] & _KEEP)


def sketch(one: np.ndarray) -> bytes:
    """How many elements a sorted set has in each of SKETCH (from BIG elements on FINEST) equal parts of the universe.

    255 stands for more.
    """
    parts = FINEST if len(one) >= BIG else SKETCH
    count = np.bincount((one >> np.uint64(65 - parts.bit_length())).astype(np.int64), minlength=parts)
    return np.minimum(count, 255).astype(np.uint8).tobytes()


@dataclass(frozen=True)
class Band:
    """How sets whose smaller partner has ``low`` to ``high`` elements are indexed.

    ``most`` elements may differ between two similar sets; ``parts`` segments of the universe; with ``deletions``
    each segment also indexes what is left after taking one element away.
    """

    number: int
    low: int
    high: int
    partner: int
    most: int
    parts: int
    deletions: bool


def bands(largest: int, num: int, den: int, rows: dict[int, int] | None = None) -> list[Band]:
    """Size bands up to ``largest``, each with the cheaper of its two index forms for the given row counts."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * RATIO))
        partner = high * den // num
        most = (den - num) * (high + partner) // (den + num)
        n = sum(c for b, c in (rows or {}).items() if b == len(out))
        options = []
        for deletions in (False, True):
            parts = _parts(low, most, deletions)
            size = (low + high) / 2
            keys = parts + (size if deletions else 0)
            differ = size * 2 * (1 - ALIKE) / (1 + ALIKE) / parts
            chance = math.exp(-differ) * ((1 + differ) if deletions else 1)
            options.append((keys + n * ALIKE_SHARE * parts * chance, deletions, parts))
        _, deletions, parts = min(options)
        out.append(Band(len(out), low, high, partner, most, parts, deletions))
        low = high + 1
    return out


def _parts(size: int, most: int, deletions: bool) -> int:
    """Segments so that a set of ``size`` elements is very likely to fill enough of them for the pigeonhole."""
    worth = lambda m: _worth(size, m, deletions)
    m = 1
    while worth(m)[0] - 4 * worth(m)[1] < most + 1:
        m += max(1, m // 32)
        if m > 4 * (most + 1) + 4:
            break
    return m


def _worth(size: int, m: int, deletions: bool) -> tuple[float, float]:
    """Mean and deviation of what the segments of a set count for: 1 if not empty, 2 with two elements and deletions."""
    if m == 1:
        return (2.0 if deletions and size > 1 else 1.0), 0.0
    empty = (1 - 1 / m) ** size
    single = size / m * (1 - 1 / m) ** (size - 1)
    if deletions:
        mean = m * (2 * (1 - empty - single) + single)
        spread = m * (4 * (1 - empty - single) + single - (2 * (1 - empty - single) + single) ** 2)
    else:
        mean, spread = m * (1 - empty), m * empty * (1 - empty)
    return mean, math.sqrt(max(spread, 0.0))


def band_keys(one: np.ndarray, band: Band) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a sorted set in a band, and which of them stand for whole segments.

    Two similar sets share a key, and the key stands for a whole segment in one of them: without a shared key
    they differ in as many elements as the filled segments count, which is more than ``band.most``. A set whose
    segments count for too little also gets the keys of its empty segments.
    """
    m = np.uint64(band.parts)
    part = ((one >> np.uint64(32)) * m) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    count = np.diff(np.append(first, len(one)))
    value = mix(one ^ _ODD[0])
    sums = np.add.reduceat(value, first)
    own = np.array([band.number + 1], np.uint64) * _ODD[2]
    salt = mix((part[first] + np.uint64(1)) * _ODD[1] + own)
    keys = [mix(sums ^ salt)]
    worth = len(first)
    if band.deletions:
        many = count > 1
        worth += int(many.sum())
        rows = np.repeat(many, count)
        keys.append(mix((np.repeat(sums, count) - value)[rows] ^ np.repeat(salt, count)[rows]))
    whole = len(first)
    if worth <= band.most:
        empty = np.setdiff1d(np.arange(band.parts, dtype=np.uint64), part[first])
        keys.insert(0, mix(mix((empty + np.uint64(1)) * _ODD[1] + own)))
        whole += len(empty)
    joined = np.concatenate(keys)
    return joined, np.arange(len(joined)) < whole


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n, node, sketch): size of each document's set, the set's id and sketch, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            sets = shingle_sets(part.column(1), shingle)
            ids = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
            counts = pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())
            arrays = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), ids, counts]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "node", "sketch"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, node bigint, sketch binary")


def index_keys(docs: DataFrame, shingle: int, plan: list[Band]) -> DataFrame:
    """(key, tag): for each set the keys of its own band, and of smaller bands that a partner may be in.

    ``tag`` is the set's id, with the sign bit where the key stands for a whole segment. Copies are dropped within
    a slice of the input already, so a set of which there are very many copies gives few rows.
    """
    highs = np.array([b.high for b in plan])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            seen: set[int] = set()
            keys, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for one in shingle_sets(part.column(1), shingle):
                if not len(one) or (node := set_id(one)) in seen:
                    continue
                seen.add(node)
                own = int(np.searchsorted(highs, len(one)))
                for band in reversed(plan[: own + 1]):
                    if band.partner < len(one):
                        break
                    if band.most:
                        got, whole = band_keys(one, band)
                        keys.append(got)
                        tags.append(np.where(whole, np.uint64(node) | _TOP, np.uint64(node)))
            arrays = [pa.array(np.concatenate(x).view(np.int64)) for x in (keys, tags)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "tag"])

    return docs.mapInArrow(run, "key bigint, tag bigint")


def candidate_edges(keys: DataFrame) -> DataFrame:
    """(u, v): every set that shares a key, linked with the first set that has the key for a whole segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_tag = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            tag = batch.column(1).to_numpy()
            new = np.concatenate([[last_key is None or key[0] != last_key], key[1:] != key[:-1]])
            start = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            head = np.where(start >= 0, tag[np.maximum(start, 0)], last_tag)
            last_key, last_tag = key[-1], head[-1]
            low = np.int64((1 << 63) - 1)
            u, v = head & low, tag & low
            kept = (head < 0) & (u != v)
            pairs = np.unique(np.stack([np.maximum(u, v)[kept], np.minimum(u, v)[kept]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["u", "v"])

    # Tags with the sign bit sort first, so the head of a key's run stands for a whole segment if any row does.
    ordered = keys.repartition("key").sortWithinPartitions("key", "tag")
    return ordered.mapInArrow(run, "u bigint, v bigint")


def sieve(members: DataFrame, found: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root): the connected groups of candidates once pairs with sketches too far apart are left out.

    ``members`` holds (node, root, n). Two sets differ in as many elements as the counts of their sketches differ by,
    at least, so no similar pair is left out. Passages that many documents share connect unlike sets to groups
    that grow faster than the input; here only sketches of those are moved and copied, not sets.
    """
    wanted = broadcast_if_small(members.select("node"), 200_000)
    sketches = found.where("n > 0").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("sketch").alias("sketch"))
    dealt = deal(members, "n", 1.01 * den / num, SKETCHES, 1 << 62)
    tasks = dealt.select(*TASK, "n").join(sketches, "node").select(*TASK, "n", "sketch")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(batches, 4):
            _, _, i, j, part, side, node, n, counts = group
            ids, at = np.unique(node.to_numpy(), return_index=True)
            part, side, n = part.to_numpy()[at], side.to_numpy()[at], n.to_numpy()[at]
            sketches = [np.frombuffer(counts[int(k)].as_buffer(), np.uint8) for k in at]
            cross = i[0].as_py() != j[0].as_py()
            heads = near_sketches(sketches, n, num, den, part if cross else None, side)
            moved = np.flatnonzero(heads != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[heads[moved]])], ["u", "v"])

    return components(verify(tasks, body, "u bigint, v bigint"))


def near_sketches(sketches: list[np.ndarray], n: np.ndarray, num: int, den: int, part: np.ndarray | None, side: np.ndarray) -> np.ndarray:
    """For each set a member of its group: what pairs connect whose sizes and sketches allow a similarity of num / den.

    With ``part`` only pairs of different parts count; pairs of two rows of side 1 are another task's.
    """
    order = np.argsort(n, kind="stable")
    size, side = n[order], side[order]
    part = None if part is None else part[order]
    fine = np.empty((len(order), SKETCH), np.int16)
    for k, at in enumerate(order.tolist()):  # counts of joined parts, which again are 255 at most
        fine[k] = np.minimum(sketches[at].reshape(SKETCH, -1).sum(axis=1), 255)
    coarse = fine.reshape(len(fine), COARSE, -1).sum(axis=2, dtype=np.int16)
    big = int(np.searchsorted(size, BIG))
    finest = np.array([sketches[at] for at in order[big:].tolist()], np.int16).reshape(-1, FINEST)
    ends = np.searchsorted(size * num, size * den, side="right")
    label = np.arange(len(order))
    for a in range(len(order)):
        b = a + 1 + np.flatnonzero(label[a + 1 : ends[a]] != label[a])  # what is connected already needs no look
        if side[a]:
            b = b[side[b] == 0]
        if part is not None:
            b = b[part[b] != part[a]]
        for counts, start in ((coarse, 0), (fine, 0), (finest, big)):
            if a < start or not len(b):
                break
            apart = np.abs(counts[b - start] - counts[a - start]).sum(axis=1, dtype=np.int64)
            b = b[(den + num) * apart <= (den - num) * (size[a] + size[b])]
        for other in np.unique(label[b]):
            label[label == other] = label[a]
    heads = np.empty_like(order)
    heads[order] = order[label]
    return heads


@in_small_batches
def similar_sets(docs: DataFrame, shingle: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents, and (node, root, n_links) of all sets that are linked with another set."""
    found = materialize(signatures(docs, shingle))
    highs = bands(max(1, found.agg(F.max("n")).first()[0] or 1), num, den)
    edges = F.array(*[F.lit(b.high) for b in highs])
    number = F.size(F.filter(edges, lambda h: h < F.col("n")))
    rows = {r.band: r.n for r in found.where("n > 0").groupBy(number.alias("band")).agg(F.approx_count_distinct("node").alias("n")).collect()}
    plan = bands(highs[-1].high, num, den, rows)
    graph = components(candidate_edges(index_keys(docs, shingle, plan)))
    first = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"))
    members = materialize(graph.join(first, "node"))
    members = materialize(sieve(members, found, num, den).join(members.drop("root"), "node"))
    dealt = deal(members, "n", 1.01 * den / num)
    dealt = materialize(dealt)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SLICE):
            made = shingle_sets(part.column(1), shingle)
            same = pa.array([len(s) > 0 and set_id(s) == n for s, n in zip(made, part.column(2).to_pylist())], pa.bool_())
            lists = pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(2), lists], ["node", "set"]).filter(same)

    wanted = broadcast_if_small(members.select(F.col("rep"), "node"), 200_000)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep"))).select("doc_id", "text", "node")
    with_sets = texts.mapInArrow(sets, "node bigint, set array<bigint>")
    tasks = dealt.select(*TASK).join(with_sets, "node").select(*TASK, "set")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(batches, 4):
            _, _, i, j, part, side, node = group[:7]
            ids, at = np.unique(node.to_numpy(), return_index=True)
            index, part, side = Overlaps(taken_sets(group, at)), part.to_numpy()[at], side.to_numpy()[at]
            cross = i[0].as_py() != j[0].as_py()
            forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
            for k in range(len(ids)):
                near = index.partners(k, num, den, part, side, cross)
                links[k] = len(near)
                for other in near:
                    forest.link(k, int(other))
            some = np.flatnonzero(links)
            heads = np.array([ids[forest.root(int(k))] for k in some], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(heads), pa.array(links[some])], ["node", "head", "links"])

    linked = materialize(verify(tasks, body, "node bigint, head bigint, links bigint"))
    counts = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    roots = components(linked.select(F.col("node").alias("u"), F.col("head").alias("v")))
    return found, roots.join(counts, "node")


def ngram_join(
    docs: DataFrame, shingle: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id``, ``n_links``.

    Two documents link when the Jaccard similarity of their shingle sets is num / den or more. ``component_id`` is
    the least id that links reach; ``n_links`` counts linked sets other than the document's own.

    Sets are told apart by a 63-bit hash, so copies cost nothing beyond the first scan. Keys of universe segments,
    by size band, connect candidates in stars; each connected group of candidates is then verified exactly, in
    tasks of bounded size. Rows grow with documents and keys, never with pairs.

    Null, empty and blank texts have no shingles and stand alone. Repeated rows each get a row. Rows with a null id
    belong to the component of their text. An empty table gives an empty result. Other columns are ignored.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    found, linked = similar_sets(rows, shingle, num, den)
    first = found.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"))
    least = linked.join(first, "node").groupBy("root").agg(F.min("rep").alias("least"))
    known = first.join(linked, "node", "left").join(least, "root", "left")
    known = known.select("node", F.coalesce("least", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return found.join(known, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_firsts(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that are the first of their component, or in none; all columns stay as they are.

    Rows are told apart by id and text, so rows without an id, or with the id of another row, are judged each. Of
    rows that share the first's id and text one stays. Rows without words stay.
    """
    names = list(docs.columns)
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    key = row_key(F.col(f"_c{place(names, 'doc_id')}"), F.col(f"_c{place(names, 'text')}"))
    numbered = numbered.withColumn("_key", key)
    joined = ngram_join(numbered.select(F.col("_key").alias("doc_id"), F.col(f"_c{place(names, 'text')}").alias("text")), shingle, num, den)
    judged = joined.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_gone"), (F.col("doc_id") == F.col("component_id")).alias("_first"))
    judged = materialize(judged.agg(F.count(F.lit(1)).alias("n")).where("NOT _first OR n > 1"))
    gone = broadcast_if_small(judged.where("NOT _first").select("_gone"), 500_000)
    kept = numbered.join(gone, F.col("_key") == F.col("_gone"), "left_anti")
    kept = mark_copies(kept, ["_key"], judged.where("_first").select("_gone")).where("NOT _again")
    return kept.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)
