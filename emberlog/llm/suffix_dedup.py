"""Removal of repeated byte strings, by sorting anchored suffixes in range partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.runtime import materialize

from .common import flat, pick, slices
from .words import mix, windows

LENGTH = 200
GRAM = 72
SEGMENT = 1 << 22
HOT = 100_000
CHUNK = 8192
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 24) - 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        ones = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))])
        _POWERS["up"], _POWERS["down"] = ones(_BASE), ones(_INVERSE)
    return _POWERS["up"], _POWERS["down"]


class Hashes:
    """64-bit hashes of byte ranges of eight bytes or more of a segment.

    Sums of powers times scrambled windows of eight bytes, all windows that lie inside the range. Scrambling first
    keeps texts from cancelling out, as plain bytes can in such a sum.
    """

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _powers(max(len(data), SEGMENT) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(mix(windows(data)[: len(data)]) * up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end - 7] - self.sums[begin]) * self.down[begin] ^ (end - begin).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k - 7 : k - 7 + n] - self.sums[:n]) * self.down[:n])


def find_runs(data: np.ndarray, starts: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of string starts that share an anchor, within one segment of whole or cut texts.

    The anchor of a string is its gram of least hash, the leftmost of equals. It depends on the string alone, so
    equal strings have equal anchors at equal offsets. A run covers the bytes from its first start to ``length``
    after its last.
    """
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return {k: none for k in ("doc", "begin", "span", "off", "gram", "ctx")}
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, window = 1, length - gram + 1
    best = least
    while width * 2 <= window:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if window > width:
        rest = window - width
        best = np.minimum(best[: len(best) - rest], best[rest:])
    anchor = (best & _PLACE).astype(np.int64)
    ok = np.zeros(len(anchor) + 1, np.int64)
    sizes = np.diff(starts)
    some = sizes >= length
    np.add.at(ok, starts[:-1][some], 1)
    np.add.at(ok, starts[1:][some] - length + 1, -1)
    valid = np.cumsum(ok[:-1]) > 0
    at = np.flatnonzero(valid)
    if not len(at):
        return {k: none for k in ("doc", "begin", "span", "off", "gram", "ctx")}
    doc = np.searchsorted(starts, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    begin, last = at[first], at[np.append(first[1:], len(at)) - 1]
    p, end = anchor[begin], last + length
    off = p - begin
    ctx = mix(hashes.of(begin, end) + off.astype(np.uint64) * _BASE)
    return {"doc": doc[first], "begin": begin, "span": end - begin, "off": off, "gram": grams[p], "ctx": ctx}


def leads(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one signed number in byte order."""
    eight = np.zeros((len(at), 8), np.uint8)
    for k in range(8):
        eight[:, k] = data[np.minimum(at + k, len(data) - 1)]
    return eight.view(">u8").reshape(-1).astype(np.uint64).view(np.int64) ^ np.int64(-(1 << 63))


def segments(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(data, starts, row, shift) of a slice; a long text is cut into segments that overlap by length - 1."""
    data, starts = flat(part.column(1))
    if len(data) <= SEGMENT + length:
        yield data, starts, np.arange(part.num_rows), np.zeros(part.num_rows, np.int64)
        return
    for i in range(part.num_rows):
        for a in range(int(starts[i]), max(int(starts[i]) + 1, int(starts[i + 1]) - length + 1), SEGMENT):
            b = min(int(starts[i + 1]), a + SEGMENT + length - 1)
            yield data[a:b], np.array([0, b - a]), np.array([i]), np.array([a - int(starts[i])])


def anchored_runs(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of all rows. Of runs that are equal within a slice of the input one stands for all (``again``); the
    others are known to repeat (``known``) and get keys of their own, so that copies never meet in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SEGMENT):
            keys = part.column(0).to_numpy()
            for data, starts, row, shift in segments(part, length):
                got = find_runs(data, starts, length, gram)
                if not len(got["doc"]):
                    continue
                begin = got["begin"] - starts[got["doc"]] + shift[got["doc"]]
                rid = keys[row[got["doc"]]]
                lead, grams, ctx = leads(data, got["begin"] + got["off"]), got["gram"], got["ctx"]
                _, first, inverse, count = np.unique(grams + ctx * _BASE, return_index=True, return_inverse=True, return_counts=True)
                known = np.ones(len(ctx), bool)
                known[first] = False
                own = mix(rid.view(np.uint64) ^ mix(begin.astype(np.uint64)))
                arrays = [
                    pa.array(np.where(known, own.view(np.int64), lead)),
                    pa.array(np.where(known, own, grams).view(np.int64)),
                    pa.array(np.where(known, np.uint64(0), ctx).view(np.int64)),
                    pa.array(rid),
                    pa.array(begin),
                    pa.array(got["span"].astype(np.int32)),
                    pa.array(got["off"].astype(np.int32)),
                    pa.array(~known & (count[inverse] > 1)),
                    pa.array(known),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    names = ["lead", "gram", "ctx", "rid", "at", "span", "off", "again", "known"]
    kinds = ["bigint"] * 5 + ["int", "int", "boolean", "boolean"]
    return rows.select("rid", "text").mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))


def multikey_order(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a byte matrix in order, and common prefix lengths of neighbours: multikey quicksort by 8-byte words.

    Each step sorts by one word within groups that are equal so far, and leaves groups of one alone.
    """
    n, width = matrix.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = matrix
    words = padded.view(">u8").astype(np.uint64)
    order, bound = np.arange(n), np.zeros(n, bool)
    bound[:1] = True
    for j in range(words.shape[1]):
        follows = np.append(bound[1:], True)
        open_at = np.flatnonzero(~(bound & follows))
        if not len(open_at):
            break
        group = np.cumsum(bound)[open_at]
        rows = order[open_at]
        word = words[rows, j]
        by = np.lexsort((word, group))
        order[open_at], word, group = rows[by], word[by], group[by]
        bound[open_at[1:]] |= (word[1:] != word[:-1]) | (group[1:] != group[:-1])
    differ = matrix[order[1:]] != matrix[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def repeated_offsets(contexts: list[bytes], off: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Which anchor offsets (columns) give a string that another context has at the same offset.

    Strings at offset o are equal when the suffixes from the anchor agree on length - o bytes and the reversed
    prefixes on o bytes: two sorted orders with common prefix lengths give both as classes.
    """
    n, most = len(contexts), length - gram
    right, left = np.zeros((n, length), np.uint8), np.zeros((n, max(1, most)), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    for i, c in enumerate(contexts):
        b = np.frombuffer(c, np.uint8)
        tail = b[off[i] : off[i] + length]
        right[i, : len(tail)] = tail
        left[i, : off[i]] = b[: off[i]][::-1]
    low, high = np.maximum(0, off - (sizes - length)), off
    order_r, common_r = multikey_order(right)
    order_l, common_l = multikey_order(left)
    flags = np.zeros((n, most + 1), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(most + 1):
        some = np.flatnonzero((low <= o) & (o <= high))
        if len(some) < 2:
            continue
        class_r[order_r] = np.concatenate([[0], np.cumsum(common_r < length - o)])
        class_l[order_l] = np.concatenate([[0], np.cumsum(common_l < o)])
        key = class_r[some] * n + class_l[some]
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        flags[some, o] = count[inverse] > 1
    return flags


def pooled_contexts(joined: DataFrame, length: int) -> DataFrame:
    """The bytes of pooled runs, keyed by the first 24 bytes from the anchor; hot runs as one hash a string."""
    schema = "lead bigint, lead2 bigint, lead3 bigint, rid bigint, at bigint, off int, edge boolean, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SEGMENT):
            texts, pools = part.column(1).cast(pa.large_binary()), part.column(3).to_pylist()
            out: list[tuple] = []
            for i, pool in enumerate(pools):
                data = np.frombuffer(texts[i].as_buffer(), np.uint8)
                rid = part.column(0)[i].as_py()
                cold = [r for r in pool if not r["hot"]]
                at = np.array([r["at"] + r["off"] for r in cold], np.int64)
                keys = [leads(data, at + 8 * k).tolist() for k in range(3)] if cold else []
                for k, r in enumerate(cold):
                    body = data[r["at"] : r["at"] + r["span"]].tobytes()
                    out.append((keys[0][k], keys[1][k], keys[2][k], rid, r["at"], r["off"], r["edge"], body))
                for r in pool:
                    if r["hot"]:
                        hashes = Hashes(data[r["at"] : r["at"] + r["span"]])
                        begin = np.arange(r["span"] - length + 1)
                        one = hashes.of(begin, begin + length).view(np.int64)
                        two = leads(data, r["at"] + begin + length // 2)
                        out += [(a, b, 0, rid, r["at"] + k, -1, r["edge"], b"") for k, (a, b) in enumerate(zip(one.tolist(), two.tolist()))]
                if len(out) >= 4 * CHUNK:
                    yield packed(out)
                    out = []
            if out:
                yield packed(out)

    kinds = [pa.int64()] * 5 + [pa.int32(), pa.bool_(), pa.binary()]
    names = ["lead", "lead2", "lead3", "rid", "at", "off", "edge", "bytes"]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names)

    return joined.mapInArrow(run, schema)


def repeated_in_pool(pool: DataFrame, length: int, gram: int) -> DataFrame:
    """(rid, begin, stop) of the bytes that edge runs share with another run.

    Sampled splitters deal the suffixes by their first 24 bytes; equal leading bytes never part, as a gram is
    longer, so nothing has to be compared across the borders of buckets. Within a bucket the stream is read in
    chunks that end where the leading bytes change.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if sum(b.num_rows for b in held) >= CHUNK:
                tail = [held[-1].column(k)[-1].as_py() for k in range(3)]
                differs = np.zeros(batch.num_rows, bool)
                for k in range(3):
                    differs |= batch.column(k).to_numpy() != tail[k]
                cut = int(np.argmax(differs)) if differs.any() else batch.num_rows
                if cut:
                    held.append(batch.slice(0, cut))
                if cut == batch.num_rows:
                    continue
                yield pa.Table.from_batches(held)
                held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunks(batches):
            off, at = table.column("off").to_numpy(), table.column("at").to_numpy()
            edge, rid = table.column("edge").to_numpy(), table.column("rid").to_numpy()
            cold, hot = np.flatnonzero(off >= 0), np.flatnonzero(off < 0)
            begin, stop, own = [], [], []
            if len(cold):
                flags = repeated_offsets(table.column("bytes").take(pa.array(cold)).to_pylist(), off[cold], length, gram)
                hit = np.flatnonzero(flags.any(axis=1) & edge[cold])
                least, most = flags[hit].argmax(axis=1), flags.shape[1] - 1 - flags[hit][:, ::-1].argmax(axis=1)
                place = at[cold][hit] + off[cold][hit]
                # Strings of one run overlap, so that what is repeated of it is one stretch of bytes.
                begin.append(place - most)
                stop.append(place - least + length)
                own.append(rid[cold][hit])
            if len(hot):
                keys = np.stack([table.column(k).to_numpy()[hot] for k in range(2)], axis=1)
                _, inverse, count = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
                hit = hot[(count[inverse.reshape(-1)] > 1) & edge[hot]]
                begin.append(at[hit])
                stop.append(at[hit] + length)
                own.append(rid[hit])
            arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in (own, begin, stop)]
            yield pa.RecordBatch.from_arrays(arrays, ["rid", "begin", "stop"])

    keys = ["lead", "lead2", "lead3"]
    return pool.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, "rid bigint, begin bigint, stop bigint")


def without_spans(joined: DataFrame, kind: str, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, SEGMENT):
            texts, spans = part.column(1).cast(pa.large_binary()), part.column(3).to_pylist()
            out: list[tuple] = []
            for i, found in enumerate(spans):
                data = texts[i].as_py() if texts[i].is_valid else b""
                kept, at, removed, runs = [], 0, 0, []
                for s in sorted((s["begin"], s["stop"]) for s in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                for a, b in runs:
                    kept.append(data[at:a])
                    removed += b - a
                    at = b
                kept.append(data[at:])
                left = b"".join(kept)
                flatted = [x for r in runs for x in r]
                out.append((len(data), removed, len(runs), hashlib.sha256(left).hexdigest(), flatted, left))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.int64()), pa.binary()]
            arrays = [part.column(2)] + [pa.array([o[k] for o in out], kinds[k]) for k in range(6 if with_text else 4)]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return joined.mapInArrow(run, schema + ", spans array<bigint>, kept binary" * with_text)


def repeated_strings(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_text: bool = False,
    hot: int = HOT,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    Every byte that lies in a string of ``length`` bytes that also starts elsewhere in the corpus, in the same
    document or another, is removed; strings are judged on the input. With ``with_text`` also ``spans`` (begins
    and ends of the removed runs, in turn) and ``kept``, the remaining bytes.

    Suffixes start at anchors, about 3 in 200 bytes; each stands for the run of strings that it anchors. A first
    range partition and sort finds runs that are repeated as a whole, and runs that share an anchor's gram only.
    The bytes of the latter, with one copy of each repeated run beside them, are range-partitioned by leading bytes
    and sorted by multikey quicksort, which tells exactly which strings repeat. A gram in more than ``hot`` runs
    is compared by two hashes a string instead, dealt by hash, so that no bucket has to hold it.

    Null and empty texts, and those below ``length`` bytes, lose nothing. Repeated rows repeat all their strings.
    An empty table gives an empty result. Other columns are ignored.
    """
    if not 8 * 3 <= gram <= length:
        raise ValueError("the gram must have 24 bytes or more and fit into the string")
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    runs = anchored_runs(rows, length, gram).repartitionByRange("lead", "gram")
    order = Window.partitionBy("lead", "gram").orderBy("ctx", "rid", "at")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select(
        "rid",
        "at",
        "span",
        "off",
        "again",
        "known",
        F.count(F.lit(1)).over(whole).alias("n"),
        (F.first("ctx").over(whole) != F.last("ctx").over(whole)).alias("mixed"),
        F.coalesce(F.lag("ctx").over(order) == F.col("ctx"), F.lit(False)).alias("as_before"),
        F.coalesce(F.lead("ctx").over(order) == F.col("ctx"), F.lit(False)).alias("as_after"),
    )
    runs = materialize(runs.where("n > 1 OR again OR known"))
    full = F.col("as_before") | F.col("as_after") | F.col("again") | F.col("known")
    stretches = runs.where(full).select("rid", F.col("at").alias("begin"), (F.col("at") + F.col("span")).alias("stop"))
    pool = runs.where(F.col("mixed") & ~F.col("as_before") & ~F.col("known"))
    item = F.struct("at", "span", "off", (F.col("n") > hot).alias("hot"), (~full).alias("edge"))
    pool = pool.groupBy("rid").agg(F.collect_list(item).alias("pool"))
    dealt = rows.repartition("rid")
    # Equal rows share their key; one of them stands for all in the pool, as all their runs are repeated whole.
    contexts = pooled_contexts(dealt.join(pool, "rid").select("rid", "text", "doc_id", "pool"), length)
    edges = repeated_in_pool(contexts, length, gram)
    spans = stretches.union(edges).groupBy("rid").agg(F.collect_list(F.struct("begin", "stop")).alias("spans"))
    joined = dealt.join(spans, "rid", "left").select("rid", "text", "doc_id", "spans")
    return without_spans(joined, rows.schema["doc_id"].dataType.simpleString(), with_text)
