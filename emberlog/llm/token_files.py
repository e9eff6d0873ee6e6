"""Token ids in entropy-coded shards: canonical length-limited Huffman codes, blocks that decode on their own."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from emberlog.runtime import broadcast_if_small, materialize, scratch_path

from .common import pick, slices
from .tokens import _byte_of_char

MAX_BITS = 18
BLOCK_IDS = 512
SHARD_IDS = 1 << 20
CHUNK_BLOCKS = 4096
RANGE_BYTES = 64 << 20
KEEP_CHARS = 48
_HEAD = struct.Struct("<4sIIIQQII")
_MAGIC = b"EHUF"
_STAND_IN = {b: c for c, b in _byte_of_char().items()}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """Values by key, computed when missing, in two generations: when the younger one is full, the older one goes."""

    def __init__(self, compute: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= KEEP_CHARS:
            self[key] = found
        return found


#: Fixed value: the pre-token rule of the word vocabulary, as its file states it.
_WORD_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: One run of Latin letters, then one of marks without the apostrophe: two pre-tokens under that rule.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class IdEncoder:
    """Ids of whole texts as the ``tokenizers`` library gives them, packed as little-endian integers.

    A vocabulary that drops white space encodes each stretch between blanks and line ends on its own, so each
    distinct stretch is encoded once and remembered. Stretches of Latin letters and marks go to the library's model
    pre-token by pre-token, all others through its whole chain. Other vocabularies encode whole texts.
    """

    def __init__(self, path: str, limit: int = 200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind: np.dtype | None = None
        self.stretches, self.pieces = Memo(self.stretch, limit), Memo(self.piece, limit)
        names = [t["content"] for t in spec["added_tokens"]]
        stripped = any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        rules = [x.get("pattern", {}).get("Regex") for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        same_rule = rules == [_WORD_RULE, None] and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.by_words = same_rule and not stripped and not any(" " in n or "\n" in n for n in names)
        self.stand_in = str.maketrans({chr(b): "".join(_STAND_IN[x] for x in chr(b).encode()) for b in range(0xC0, 0x100)})

    def batch(self, texts: list[str], kind: np.dtype) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, kind).tobytes() for e in found]

    def piece(self, part: str) -> bytes:
        """Ids of one pre-token in lower case."""
        text = part if part.isascii() else part.translate(self.stand_in)
        return array(self.kind.char, [t.id for t in self.tokenizer.model.tokenize(text)]).tobytes()

    def stretch(self, text: str) -> bytes:
        m = _PLAIN.fullmatch(text)
        if m is None:
            return self.batch([text], self.kind)[0]
        word, marks = m.groups()
        if not marks:
            return self.pieces[word.lower()] if word else b""
        return self.pieces[word.lower()] + self.pieces[marks] if word else self.pieces[marks]

    def encode(self, texts: list[str], kind: np.dtype) -> list[bytes]:
        if not self.by_words:
            return self.batch(texts, kind)
        if kind != self.kind:
            self.kind = kind
            for memo in (self.stretches, self.pieces):
                memo.clear()
                memo.old = {}
        self.stretches.turn()
        self.pieces.turn()
        known = self.stretches.__getitem__
        return [b"".join(map(known, t.replace("\n", " ").split(" "))) for t in texts]


_ENCODERS: dict[str, IdEncoder] = {}


def id_type(largest: int) -> np.dtype:
    """The narrowest unsigned type for ids up to ``largest``."""
    return np.dtype("<u2") if largest < 1 << 16 else np.dtype("<u4")


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal prefix code lengths of at most ``limit`` bits for positive counts, by package-merge.

    Only the order of leaves and packages of each level is kept; going back down, the leaves among the items a
    level needs are always its cheapest ones, and each level makes them one bit longer.
    """
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} symbols do not fit codes of {limit} bits")
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.int64)
    items, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        half = len(items) // 2
        packed = items[: 2 * half].reshape(half, 2).sum(axis=1)
        both = np.concatenate([leaves, packed])
        rank = np.argsort(both, kind="stable")
        items = both[rank]
        marks.append(rank < n)
    out, need = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(marks):
        taken = int(leaf[:need].sum())
        out[:taken] += 1
        need = 2 * (need - taken)
    lengths = np.empty(n, np.int64)
    lengths[order] = out
    return lengths


class Code:
    """A canonical code: symbols in order of length, then of value, take consecutive code words."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((symbols, lengths))
        self.symbols, self.lengths = symbols[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths[-1]) if len(order) else 1
        room = np.int64(1) << (self.bits - self.lengths)
        self.words = (np.cumsum(room) - room) >> (self.bits - self.lengths)
        largest = int(self.symbols.max()) + 1 if len(order) else 0
        self.word_of, self.length_of = np.zeros(largest, np.uint64), np.zeros(largest, np.int64)
        self.word_of[self.symbols], self.length_of[self.symbols] = self.words.astype(np.uint64), self.lengths
        table = np.repeat(self.symbols << 5 | self.lengths, room)
        self.table = np.concatenate([table, np.ones((1 << self.bits) - len(table), np.int64)])
        self.check = zlib.crc32(np.stack([self.symbols, self.lengths]).tobytes())

    def pack(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bits of the ids, first bit first, filled up to whole bytes, and the bit where each id starts."""
        lengths = self.length_of[ids]
        ends = np.cumsum(lengths)
        begins = ends - lengths
        word = begins >> 5
        value = self.word_of[ids] << (64 - lengths - (begins & 31)).astype(np.uint64)
        size = int(ends[-1] >> 5) + 2
        out = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
        out += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
        return out.astype(">u4").tobytes()[: int(ends[-1] + 7) >> 3], begins

    def unpack(self, data: np.ndarray, begins: np.ndarray, block: int) -> np.ndarray:
        """``block`` ids from each of the given bits on; all blocks advance together, one table look-up an id."""
        first, last = int(begins[0]) >> 3, int(begins[-1]) >> 3
        data = data[first : last + block * self.bits // 8 + 8]
        data = np.concatenate([data, np.zeros(max(0, last - first + block * self.bits // 8 + 8 - len(data)), np.uint8)]).astype(np.uint32)
        window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        at, out = begins - 8 * first, np.empty((block, len(begins)), np.uint32)
        down = np.uint32(32 - self.bits)
        for i in range(block):
            entry = self.table[(window[at >> 3] << (at & 7).astype(np.uint32)) >> down]
            out[i] = entry >> 5
            at = at + (entry & 31)
        return out.T.reshape(-1)


def write_shard(code: Code, doc_ids: pa.Array, texts: list[bytes], kind: np.dtype) -> bytes:
    """One shard: head, bit offset of each block, index of documents (an Arrow stream), code words.

    Blocks of BLOCK_IDS ids are coded one after the other; a chunk of blocks starts at a whole byte.
    """
    sizes = np.array([len(t) // kind.itemsize for t in texts], np.int64)
    ids = np.frombuffer(b"".join(texts), kind)
    offsets, payload, done = [], [], 0
    for a in range(0, len(ids), BLOCK_IDS * CHUNK_BLOCKS):
        bits, begins = code.pack(ids[a : a + BLOCK_IDS * CHUNK_BLOCKS])
        offsets.append(begins[::BLOCK_IDS] + 8 * done)
        payload.append(bits)
        done += len(bits)
    sink = pa.BufferOutputStream()
    index = pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes)], ["doc_id", "n_tokens"])
    with pa.ipc.new_stream(sink, index.schema) as out:
        out.write_batch(index)
    table, marks = sink.getvalue().to_pybytes(), np.concatenate(offsets).astype("<u8")
    head = _HEAD.pack(_MAGIC, 1, BLOCK_IDS, code.check, len(ids), done, len(marks), len(table))
    return b"".join([head, marks.tobytes(), table, *payload])


def read_shard(code: Code, shard) -> tuple[pa.RecordBatch, Iterator[np.ndarray]]:
    """Index of a shard (doc_id, n_tokens) and its ids, in pieces of CHUNK_BLOCKS blocks."""
    magic, version, block, check, n, size, n_blocks, n_index = _HEAD.unpack_from(shard)
    if magic != _MAGIC or version != 1 or check != code.check:
        raise ValueError("not a shard of this code")
    at = _HEAD.size
    marks = np.frombuffer(shard, "<u8", n_blocks, at).astype(np.int64)
    at += 8 * n_blocks
    with pa.ipc.open_stream(pa.py_buffer(shard).slice(at, n_index)) as stream:
        index = stream.read_next_batch()
    data = np.frombuffer(shard, np.uint8, size, at + n_index)

    def pieces() -> Iterator[np.ndarray]:
        for a in range(0, n_blocks, CHUNK_BLOCKS):
            ids = code.unpack(data, marks[a : a + CHUNK_BLOCKS], block)
            yield ids[: n - a * block]

    return index, pieces()


def encode_documents(rows: DataFrame, vocabulary: str, end_id: int, kind: np.dtype, largest: int) -> DataFrame:
    """(doc_id, n_tokens, ids, counts): packed ids of each text of (doc_id, text), with the end id.

    Each task adds one row with ``counts`` only, the occurrences of every id in it, compressed.
    """
    end = np.array([end_id], kind).tobytes()
    names = ["doc_id", "n_tokens", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, IdEncoder(vocabulary))
        total, id_type = np.zeros(largest + 1, np.int64), None
        for part in slices(batches):
            found = [ids + end for ids in encoder.encode([t or "" for t in part.column(1).to_pylist()], kind)]
            total += np.bincount(np.frombuffer(b"".join(found), kind), minlength=largest + 1)
            sizes = pa.array([len(x) // kind.itemsize for x in found], pa.int64())
            id_type = part.column(0).type
            yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], names)
        if total.any():
            last = pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), last], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids binary, counts binary")


def id_counts(encoded: DataFrame, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids that occur and how often, over all documents; bounded by the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(largest + 1, np.int64)
        for part in batches:
            for counts in part.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(counts), np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    rows = encoded.where(F.col("counts").isNotNull()).select("counts").mapInArrow(run, "id bigint, n bigint")
    found = sorted((r.id, r.n) for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect())
    return np.array([i for i, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def write_ids(
    docs: DataFrame,
    path: str,
    vocabulary: str | None = None,
    end_id: int = 1,
    max_bits: int = MAX_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write the token ids of every text below ``path``, in ascending order of id, and the code beside them.

    ``path/code`` has (symbol, bits); ``path/shards`` has rows (part, number, n_ids, shard), in that order the whole
    stream of ids. A shard holds whole documents, about SHARD_IDS ids, and can be decoded from any of its blocks.
    Spark's writer commits the shards, so a lost or repeated task leaves none behind.

    Texts are encoded once; ids move once, range-partitioned by document id. Ties of the id go by ids, and copies
    spread over partitions. Null and empty texts are the end id alone. An empty table writes no shards.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    from tokenizers import Tokenizer

    largest = max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end_id)
    kind = id_type(largest)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    stored = scratch_path(spark, "ids")
    encode_documents(rows, vocabulary, end_id, kind, largest).write.option("compression", "zstd").parquet(stored)
    encoded = spark.read.parquet(stored)
    symbols, counts = id_counts(encoded, largest)
    lengths = code_lengths(counts, max_bits) if len(symbols) else counts
    pairs = list(zip(symbols.tolist(), lengths.tolist()))
    spark.createDataFrame(pairs, "symbol bigint, bits bigint").coalesce(1).write.parquet(f"{path}/code")
    code = Code(symbols, lengths)
    total = int(counts.sum()) * kind.itemsize
    width = spark.sparkContext.defaultParallelism
    parts = max(-(-total // RANGE_BYTES), min(2 * width, -(-total // (2 * SHARD_IDS))), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, doc_ids = 0, [], 0, []

        def close() -> pa.RecordBatch:
            shard = write_shard(code, pa.concat_arrays(doc_ids), held, kind)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([n], pa.int64()), pa.array([shard], pa.binary())], ["number", "n_ids", "shard"])

        for part in slices(batches, 1):
            for i, ids in enumerate(part.column(1)):
                held.append(ids.as_py())
                doc_ids.append(part.column(0).slice(i, 1))
                n += len(held[-1]) // kind.itemsize
                if n >= SHARD_IDS:
                    yield close()
                    number, held, n, doc_ids = number + 1, [], 0, []
        if held:
            yield close()

    ties = encoded.where(F.col("counts").isNull()).drop("counts").withColumn("_tie", F.xxhash64("ids")).withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie"), F.col("_row")]
    ranged = ties.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "ids")
    shards = ranged.mapInArrow(run, "number bigint, n_ids bigint, shard binary").withColumn("part", F.spark_partition_id())
    shards.write.option("compression", "uncompressed").parquet(f"{path}/shards")


def read_code(spark: SparkSession, path: str) -> Code:
    """The stored code, at most one row an id of the vocabulary."""
    rows = spark.read.parquet(f"{path}/code").collect()
    return Code(np.array([r.symbol for r in rows], np.int64), np.array([r.bits for r in rows], np.int64))


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, first): ids before each shard. Sums inside partitions, then over one row a partition."""
    sizes = materialize(spark.read.parquet(f"{path}/shards").select("part", "number", "n_ids"))
    whole = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = whole.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    local = sizes.withColumn("_local", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    return local.join(broadcast_if_small(bases), "part").select("part", "number", (F.col("_base") + F.col("_local")).alias("first"))


def decoded(spark: SparkSession, path: str, body, schema: str) -> DataFrame:
    """Run ``body(code, first, shard)``, which yields record batches, over all shards of a folder."""
    code = read_code(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    joined = shards.join(broadcast_if_small(materialize(shard_starts(spark, path))), ["part", "number"]).select("first", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for first, shard in zip(part.column(0).to_pylist(), part.column(1)):
                yield from body(code, first, shard.as_buffer())

    return joined.mapInArrow(run, schema)


def read_ids(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, ids): the ids of every document, read back from the shards."""

    def body(code: Code, first: int, shard) -> Iterator[pa.RecordBatch]:
        index, pieces = read_shard(code, shard)
        sizes = index.column(1).to_numpy()
        ends = np.cumsum(sizes)
        ids = np.concatenate(list(pieces)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([index.column(0), pa.array(first + ends - sizes), lists], ["doc_id", "start", "ids"])

    return decoded(spark, path, body, f"doc_id {id_type}, start bigint, ids array<int>")


def read_digests(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded shards piece by piece."""

    def body(code: Code, first: int, shard) -> Iterator[pa.RecordBatch]:
        index, pieces = read_shard(code, shard)
        sizes = index.column(1).to_numpy()
        ends = np.cumsum(sizes)
        sums = np.zeros(len(sizes), np.int64)
        at, doc = 0, 0
        for ids in pieces:
            data, stop = memoryview(ids.astype("<u4").tobytes()), at + len(ids)
            while at < stop:
                end = min(int(ends[doc]), stop)
                base = stop - len(ids)
                sums[doc] = zlib.crc32(data[4 * (at - base) : 4 * (end - base)], int(sums[doc]))
                at = end
                if at == ends[doc]:
                    doc += 1
        arrays = [index.column(0), pa.array(first + ends - sizes), pa.array(sizes), pa.array(sums)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return decoded(spark, path, body, f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the ids of all documents below ``path`` and return one digest row per document, read back from there.

    Options and edge cases as in :func:`write_ids`. Without ``path`` a fresh folder of the session's shared folder
    is used.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    write_ids(docs, path, **options)
    kind = pick(docs, options.get("id_col", "doc_id")).schema[0].dataType.simpleString()
    return read_digests(spark, path, kind)
