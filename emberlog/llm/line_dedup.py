"""Line dedup: an exact set-similarity join of lines by rare-token prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.runtime import broadcast_if_small, materialize

from .clusters import TASK, Overlaps, components, deal, taken_sets, task_groups, verify
from .common import flat, in_small_batches, mark_copies, pick, place, release, slices
from .words import mix, word_hashes

BUCKETS = 1 << 24
_SHIFT = np.uint64(40)
BLOCK = 1 << 13
HOT = 1 << 15
SLICE = 2 << 20
NO_ID = -(1 << 63)
#: Sizes and places of tokens are kept up to here; such rows meet without the filters that need them.
WIDE = (1 << 16) - 1
_KEEP = np.uint64((1 << 63) - 1)
_SALT = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Lines:
    """The lines of a batch that have enough different words: sorted token sets, one after another."""

    doc: np.ndarray
    number: np.ndarray
    tokens: np.ndarray
    first: np.ndarray
    size: np.ndarray
    node: np.ndarray
    in_doc: np.ndarray


def order_in_groups(group: np.ndarray, upper: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Order by group, then ``upper`` (a byte), then value: one sort of packed keys, and a full one if keys tie."""
    if not len(group):
        return np.zeros(0, np.int64)
    bits = 64 - int(group[-1]).bit_length() - (8 if upper is not None else 0)
    key = group.astype(np.uint64) << np.uint64(64 - int(group[-1]).bit_length()) if group[-1] else np.zeros(len(group), np.uint64)
    if upper is not None:
        key |= upper.astype(np.uint64) << np.uint64(bits)
    key |= values >> np.uint64(64 - bits)
    order = np.argsort(key)
    sorted_values, sorted_key = values[order], key[order]
    if ((sorted_key[1:] == sorted_key[:-1]) & (sorted_values[1:] != sorted_values[:-1])).any():
        return np.lexsort((values, group) if upper is None else (values, upper, group))
    return order


def read_lines(texts: pa.Array, least: int) -> Lines:
    data, starts = flat(texts)
    breaks = np.flatnonzero(data == 10) + 1
    line_starts = np.unique(np.concatenate([starts, breaks]))
    count = np.searchsorted(breaks, starts[1:], side="right") - np.searchsorted(breaks, starts[:-1], side="right")
    in_doc = np.where(starts[1:] > starts[:-1], count + 1, 0)
    # A break at the very end of a text starts an empty last line, which is the next text's first position.
    ends_open = np.isin(starts[1:], breaks) & (starts[1:] > starts[:-1])
    in_doc = np.where(ends_open & (in_doc > 0), count + 1, in_doc)
    hashes, owner = word_hashes(data, line_starts)
    order = order_in_groups(owner, None, hashes)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    lines, size = owner[heads], np.diff(np.append(heads, len(owner)))
    enough = size >= least
    kept = np.repeat(enough, size)
    lines, size = lines[enough], size[enough]
    tokens = hashes[kept]
    first = np.cumsum(size) - size
    doc = np.searchsorted(starts, line_starts[lines], side="right") - 1
    number = lines - np.searchsorted(line_starts, starts[doc])
    if len(tokens):
        node = mix(np.add.reduceat(mix(tokens + _SALT), first) + size.astype(np.uint64)) & _KEEP
    else:
        node = np.zeros(0, np.uint64)
    return Lines(doc, number, tokens, first, size, node.view(np.int64), in_doc)


def chosen_lines(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    """The lines of each text that its list of numbers, from 0, names: a text each, in order."""
    data, starts = flat(texts)
    line_starts = np.unique(np.concatenate([starts[:-1], np.flatnonzero(data == 10) + 1]))
    lists = numbers.value_lengths().to_numpy(zero_copy_only=False)
    at = np.repeat(np.searchsorted(line_starts, starts[:-1]), lists) + numbers.flatten().to_numpy(zero_copy_only=False)
    chosen = np.zeros(len(line_starts), bool)
    chosen[at] = True
    length = np.diff(np.append(line_starts, len(data)))
    kept = pa.py_buffer(data[np.repeat(chosen, length)])
    ends = np.concatenate([[0], np.cumsum(length[chosen])]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), kept)


def numbered_lines(docs: DataFrame, least: int) -> DataFrame:
    """One scan for two kinds of rows: the lines of each document, and counts of the tokens of each task.

    Document rows hold doc_id, hash, n_lines, and the numbers, set ids (``nodes``) and set sizes of eligible lines; the others a
    ``block`` of the counts in BUCKETS buckets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.uint32)
        for part in slices(batches, 1, SLICE):
            got = read_lines(part.column(1), least)
            np.add.at(total, (got.tokens >> _SHIFT).astype(np.int64), np.uint32(1))
            cut = np.searchsorted(got.doc, np.arange(part.num_rows + 1)).astype(np.int32)
            arrays = [
                part.column(0),
                part.column(2),
                pa.array(got.in_doc, pa.int64()),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(got.number.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(got.node)),
                pa.ListArray.from_arrays(pa.array(cut), pa.array(got.size.astype(np.int32))),
                pa.nulls(part.num_rows, pa.int32()),
                pa.nulls(part.num_rows, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)
        blocks = total.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        packed = [zlib.compress(blocks[b].astype("<u4").tobytes(), 1) for b in some]
        nothing = [pa.nulls(len(some), k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays([*nothing, pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names)

    names = ["doc_id", "hash", "n_lines", "numbers", "nodes", "sizes", "block", "counts"]
    schema = "doc_id bigint, hash bigint, n_lines bigint, numbers array<int>, nodes array<bigint>, sizes array<int>, block int, counts binary"
    return docs.mapInArrow(run, schema)


def rarity_codes(counted: DataFrame) -> np.ndarray:
    """One byte for each of BUCKETS token buckets that grows with the bucket's count over all lines.

    Exact up to 15, then eighths of powers of two. Any table gives a right join, as it only fixes an order of
    tokens; a better one makes prefixes rarer. What is added up are blocks of the tasks' fixed arrays.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for part in batches:
            for block, packed in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.int64)
                totals[block] = totals[block] + counts if block in totals else counts
        codes = []
        for counts in totals.values():
            high = np.minimum(16 + 8 * (np.log2(np.maximum(counts, 16)) - 4), 255).astype(np.uint8)
            codes.append(np.where(counts < 16, counts, high).astype(np.uint8).tobytes())
        arrays = [pa.array(list(totals), pa.int32()), pa.array(codes, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["block", "codes"])

    summed = counted.select("block", "counts").repartition("block").mapInArrow(add, "block int, codes binary")
    table = np.zeros((BUCKETS // BLOCK, BLOCK), np.uint8)
    for row in summed.collect():  # BUCKETS bytes in all
        table[row.block] = np.frombuffer(row.codes, np.uint8)
    return table.reshape(-1)


def prefix_rows(docs: DataFrame, least: int, num: int, den: int, codes: np.ndarray) -> DataFrame:
    """(key, node, low, high): for each different line of a slice its rarest tokens, as far as needed.

    With tokens in order of rarity, two lines of similarity num / den share one of the first
    size - ceil(size num / den) + 1 tokens of each. Tokens that occur once cannot be shared and give no row.
    ``key`` holds 32 bits of the token, the line's size and the token's position, so rows of a token are in order of
    size. ``low`` and ``high`` are a 128-bit parity map of the tokens:
    lines that differ in d tokens differ in d bits at most. Keys of tokens with more than HOT lines are cut
    into pairs of blocks of lines.
    """
    shared = docs.sparkSession.sparkContext.broadcast(codes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code_of = shared.value
        for part in slices(batches, 0, SLICE):
            got = read_lines(part.column(0), least)
            if not len(got.size):
                continue
            line = np.repeat(np.arange(len(got.size)), got.size)
            code = code_of[(got.tokens >> _SHIFT).astype(np.int64)]
            bit = mix(got.tokens ^ _SALT)
            word = np.uint64(1) << (bit & np.uint64(63))
            upper = (bit >> np.uint64(6)) & np.uint64(1) == 1
            low = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), word), got.first)
            high = np.bitwise_xor.reduceat(np.where(upper, word, np.uint64(0)), got.first)
            order = order_in_groups(line, code, got.tokens)
            tokens, code = got.tokens[order], code[order]
            position = np.arange(len(tokens)) - np.repeat(got.first, got.size)
            prefix = got.size + (-got.size * num // den) + 1
            _, fresh = np.unique(got.node, return_index=True)
            new = np.zeros(len(got.size), bool)
            new[fresh] = True
            kept = (position < np.repeat(prefix, got.size)) & (code > 1) & new[line]
            line, tokens, code, position = line[kept], tokens[kept], code[kept], position[kept]
            key, node = tokens, got.node[line]
            estimate = np.where(code < 16, code, 2.0 ** (4 + (code.astype(np.float64) - 15) / 8))
            blocks = np.maximum(1, np.ceil(estimate / HOT)).astype(np.int64)
            if (blocks > 1).any():
                pick_rows = np.repeat(np.arange(len(key)), blocks)
                other = np.arange(len(pick_rows)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                n, own = blocks[pick_rows], node[pick_rows] % blocks[pick_rows]
                a, b = np.minimum(own, other), np.maximum(own, other)
                key = tokens[pick_rows] ^ np.where(n > 1, mix((a * n + b + 1).astype(np.uint64)), np.uint64(0))
                line, node, position = line[pick_rows], node[pick_rows], position[pick_rows]
            shape = (np.minimum(got.size[line], WIDE) << 16) | np.minimum(position, WIDE)
            key = (key & ~np.uint64(0xFFFFFFFF)) | shape.astype(np.uint64)
            columns = [key.view(np.int64), node, low[line].view(np.int64), high[line].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "low", "high"])

    return docs.select("text").mapInArrow(run, "key bigint, node bigint, low bigint, high bigint")


def star_edges(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each connected group of the pairs: no more edges than ends, and the same groups."""
    ends, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = where[: len(u)], where[len(u) :]
    label = np.arange(len(ends))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        np.minimum.at(label, before, label.copy())
        label = label[label]
        if np.array_equal(label, before):
            break
    moved = label != np.arange(len(ends))
    return ends[moved], ends[label[moved]]


def candidate_edges(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): stars over lines that share a prefix token and pass the length, positional and parity filters.

    Similar lines share tokens enough to follow the first shared one in both, so only pairs with that room count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs_of_keys(batches):
            key, node, low, high = without_copies(part)
            low, high = low.view(np.uint64), high.view(np.uint64)
            size, position = (key >> 16) & WIDE, key & WIDE
            token = key >> 32
            last = np.append(np.flatnonzero(token[1:] != token[:-1]), len(key) - 1)
            end = last[np.searchsorted(last, np.arange(len(key)))] + 1
            one, found, lag = np.arange(len(key)), [], 0
            pending = 0
            while len(one):
                lag += 1
                one = one[one + lag < end[one]]
                one = one[size[one] * den >= size[one + lag] * num]  # sizes grow along a run
                two = one + lag
                m, n = size[one], size[two]
                both = m + n
                least = -(-num * both // (num + den))
                i, j = position[one], position[two]
                ok = (m - i >= least) & (n - j >= least)
                wide = n == WIDE
                ok = (ok | wide) & (node[one] != node[two])
                a, b = one[ok], two[ok]
                bits = np.bitwise_count(low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(high[a] ^ high[b])
                near = (bits <= (both - 2 * least)[ok]) | wide[ok]
                if near.any():
                    found.append((node[a[near]], node[b[near]]))
                    pending += int(near.sum())
                if pending > 1_000_000:
                    found = [star_edges(*map(np.concatenate, zip(*found)))]
                    pending = len(found[0][0])
            if found:
                u, v = star_edges(*map(np.concatenate, zip(*found)))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    dealt = rows.repartition(F.shiftright("key", 32)).sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def without_copies(part: list[pa.Array]) -> list[np.ndarray]:
    """One row of each key and line; the others come from copies of the line in other slices."""
    columns = [c.to_numpy() for c in part]
    new = np.ones(len(columns[0]), bool)
    new[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
    return [c[new] for c in columns]


def runs_of_keys(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[list[pa.Array]]:
    """Consecutive rows in parts of about ``rows``, never cutting a run of one token, the upper 32 bits of the key."""
    held: list[pa.RecordBatch] = []

    def columns() -> list[pa.Array]:
        return [c.combine_chunks() for c in pa.Table.from_batches(held).columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        if sum(b.num_rows for b in held) >= rows:
            key = batch.column(0).to_numpy() >> 32
            tail = held[-1].column(0)[-1].as_py() >> 32
            cut = int(np.argmax(key != tail)) if (key != tail).any() else len(key)
            if cut:
                held.append(batch.slice(0, cut))
            if cut == len(key):
                continue
            yield columns()
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield columns()
    held = []
    release()


def earliest_similar(docs: DataFrame, first: DataFrame, edges: DataFrame, least: int, num: int, den: int) -> DataFrame:
    """(node, at): for every line set with a similar one the least place among its similar sets, verified exactly.

    ``first`` holds (node, at, size) with the earliest place of each set.
    """
    members = materialize(first.join(broadcast_if_small(materialize(components(edges))), "node"))
    wanted = members.groupBy(F.col("at.doc").alias("_doc"), F.col("at.hash").alias("_text")).agg(F.collect_list("at.line").alias("wanted"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0, SLICE):
            got = read_lines(chosen_lines(part.column(0), part.column(1)), least)
            cut = np.append(got.first, len(got.tokens)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(cut), pa.array(got.tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(got.node), values], ["node", "set"])

    same = (F.col("doc_id") == F.col("_doc")) & (F.col("hash") == F.col("_text"))
    texts = docs.join(broadcast_if_small(materialize(wanted)), same).select("text", "wanted")
    with_sets = texts.mapInArrow(sets, "node bigint, set array<bigint>")
    tasks = deal(members, "size", 1.01 * den / num).select(*TASK, "at.doc", "at.hash", "at.line")
    tasks = tasks.join(with_sets, "node").select(*TASK, "doc", "hash", "line", "set")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in task_groups(batches, 4):
            _, _, i, j, part, side, node, doc, text, line = group[:10]
            ids, at = np.unique(node.to_numpy(), return_index=True)
            index, part, side = Overlaps(taken_sets(group, at)), part.to_numpy()[at], side.to_numpy()[at]
            docs_at, texts_at, lines_at = doc.to_numpy()[at], text.to_numpy()[at], line.to_numpy()[at]
            place_of = np.empty(len(ids), np.int64)
            by_place = np.lexsort((lines_at, texts_at, docs_at))
            place_of[by_place] = np.arange(len(ids))
            cross = i[0].as_py() != j[0].as_py()
            out = []
            for k in range(len(ids)):
                near = index.partners(k, num, den, part, side, cross)
                if len(near):
                    out.append((k, by_place[place_of[near].min()]))
            own, best = np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)
            arrays = [pa.array(ids[own]), pa.array(docs_at[best]), pa.array(texts_at[best]), pa.array(lines_at[best])]
            yield pa.RecordBatch.from_arrays(arrays, ["node", "doc", "hash", "line"])

    found = verify(tasks, body, "node bigint, doc bigint, hash bigint, line int")
    return found.groupBy("node").agg(F.min(F.struct("doc", "hash", "line")).alias("at"))


def least_near(least: int, num: int, den: int) -> int | None:
    """The least size of a set, ``least`` or more, that a different set can be similar to; None without any.

    The most similar set has one word more: size / (size + 1) has to reach num / den.
    """
    return max(least, -(-num // (den - num))) if num < den else None


def repeated_lines(
    docs: DataFrame, num: int = 80, den: int = 100, least_words: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: id, ``n_lines``, ``n_removed``, ``removed`` (numbers of lines, from 0, in order).

    Lines are split at newlines; words are compared with A-Z as a-z. A line with ``least_words`` different words or
    more is removed if an earlier line, by (document id, line number), has a word set of Jaccard similarity
    num / den or more, whether or not that line is removed itself. Shorter lines stay; by default no line with a
    word is exempt.

    Equal word sets are one node, whose earliest place decides; near sets are found by prefix tokens in order of
    rarity with length, positional and parity filters, grouped, and verified exactly in tasks of bounded size.

    Null and empty texts have no lines. Documents with a null id come first. Rows with equal ids, or without, are
    documents each, in order of a hash of their text; of identical rows one comes first. An empty table gives an
    empty result. Other columns are ignored. Ids are integers.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    found, gone = removals(rows, num, den, least_words)
    found = mark_copies(found, ["doc_id", "hash"], shared_keys(found))
    joined = found.join(gone, (F.col("doc_id") == F.col("doc")) & (F.col("hash") == F.col("_text")), "left")
    removed = F.when(F.col("_again"), F.col("numbers")).otherwise(F.coalesce("removed", F.array().cast("array<int>")))
    return joined.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        "n_lines",
        F.size(removed).cast("bigint").alias("n_removed"),
        removed.alias("removed"),
    )


def keyed(id_column: Column, text: Column) -> dict[str, Column]:
    return {"doc_id": F.coalesce(id_column.cast("bigint"), F.lit(NO_ID)), "hash": F.xxhash64(text)}


def shared_keys(found: DataFrame) -> DataFrame:
    """(doc_id, hash) of identical rows with lines to compare."""
    counts = found.where(F.size("numbers") > 0).groupBy("doc_id", "hash").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.where("n > 1").select("doc_id", "hash"))


@in_small_batches
def removals(rows: DataFrame, num: int, den: int, least_words: int) -> tuple[DataFrame, DataFrame]:
    """Documents with their lines, and (doc, _text, removed): the repeated lines of each id and text hash."""
    key = keyed(F.col("doc_id"), F.col("text"))
    rows = rows.select(key["doc_id"].alias("doc_id"), "text", key["hash"].alias("hash"))
    both = materialize(numbered_lines(rows, least_words))
    found = both.where(F.col("block").isNull()).select("doc_id", "hash", "n_lines", "numbers", "nodes")
    whole = both.where(F.col("block").isNull()).select(F.col("doc_id").alias("doc"), "hash", F.explode(F.arrays_zip("numbers", "nodes", "sizes")).alias("_l"))
    lines = whole.select("doc", "hash", F.col("_l.numbers").alias("line"), F.col("_l.nodes").alias("node"))
    at = F.struct("doc", "hash", "line")
    sized = whole.select("doc", "hash", F.col("_l.numbers").alias("line"), F.col("_l.nodes").alias("node"), F.col("_l.sizes").alias("size"))
    first = materialize(sized.groupBy("node").agg(F.min(at).alias("at"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")))
    at_least = least_near(least_words, num, den)
    if at_least is None:
        best = first.where("n > 1").select("node", F.col("at").alias("_best"))
    else:
        codes = rarity_codes(both.where(F.col("block").isNotNull()))
        edges = candidate_edges(prefix_rows(rows, at_least, num, den, codes), num, den)
        near = earliest_similar(rows, first.select("node", "at", "size"), edges, at_least, num, den)
        best = first.where("n > 1").select("node", "at").union(materialize(near).select("node", "at"))
        best = best.groupBy("node").agg(F.min("at").alias("_best"))
    gone = lines.join(broadcast_if_small(materialize(best)), "node").where(at > F.col("_best")).groupBy("doc", F.col("hash").alias("_text"))
    return found, gone.agg(F.array_sort(F.collect_set("line")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, num: int = 80, den: int = 100, least_words: int = 1) -> DataFrame:
    """The documents without their repeated lines, ``n_chars`` counted anew where the table has it.

    A document goes when lines were removed and no word is left. Documents without repeated lines, those without
    words among them, stay as they are, with all columns.
    """
    names = list(docs.columns)
    numbered = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    text = F.col(f"_c{place(names, 'text')}")
    key = keyed(F.col(f"_c{place(names, 'doc_id')}"), text)
    numbered = numbered.withColumns({"_id": key["doc_id"], "_hash": key["hash"]})
    found, gone = removals(pick(docs, "doc_id", "text"), num, den, least_words)
    shared = shared_keys(found)
    numbered = mark_copies(numbered, ["_id", "_hash"], shared)
    gone = materialize(gone.toDF("_doc", "_text", "_lines"))
    joined = numbered.join(broadcast_if_small(gone, 50_000), (F.col("_id") == F.col("_doc")) & (F.col("_hash") == F.col("_text")), "left")
    if not shared.isEmpty():  # of identical rows all but one lose every line that was compared
        every = found.join(broadcast_if_small(shared, 200_000), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id", "hash"])
        every = every.select(F.col("doc_id").alias("_d"), F.col("hash").alias("_h"), F.col("numbers").alias("_every"))
        joined = joined.join(every, F.col("_again") & (F.col("_id") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left")
        joined = joined.withColumn("_lines", F.coalesce("_every", "_lines"))
    joined = joined.withColumnRenamed("_lines", "_gone")
    left = F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("_gone", i))
    changed = F.when(F.col("_gone").isNotNull(), F.array_join(left, "\n")).otherwise(text)
    joined = joined.withColumn("_new", changed)
    joined = joined.where(F.col("_gone").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]"))
    columns = []
    for i, name in enumerate(names):
        value = F.col(f"_c{i}")
        if i == place(names, "text"):
            value = F.col("_new")
        elif name == "n_chars":
            value = F.when(F.col("_gone").isNotNull(), F.length("_new").cast(docs.schema[i].dataType)).otherwise(value)
        columns.append(value.alias(f"_o{i}"))
    return joined.select(*columns).toDF(*names)
