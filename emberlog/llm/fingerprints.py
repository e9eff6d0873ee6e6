"""Document fingerprints by consistent weighted sampling over word counts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, pick, slices
from .words import mix, word_hashes

SAMPLES = 128
STEPS = 1 << 16
CELLS = 1 << 16
SLICE = 2 << 20


def _gamma_quantiles() -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2 at the middle of each of STEPS equal steps."""
    p = (np.arange(STEPS) + 0.5) / STEPS
    low, high = np.zeros(STEPS), np.full(STEPS, 40.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return np.round(low * (1 << 14)) / (1 << 14)


class Sampler:
    """Signatures of texts: for each of ``samples`` draws the weighted term with the least sampled value.

    For term k of weight S and one draw: r and c are gamma(2, 1), b is uniform, all from a hash of (k, draw);
    t = floor(ln S / r + b), y = exp(r (t - b)), and the value is c / (y exp(r)). Two texts choose the same
    (k, t) with the probability of their generalised Jaccard similarity. The logarithm of the value stands for
    (k, t) in the signature: 32 bits a draw. A text without terms has zeros.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 1) -> None:
        q = _gamma_quantiles()
        self.r, self.ln_c = q.astype(np.float32), np.log(q).astype(np.float32)
        self.b = (np.arange(STEPS, dtype=np.float32) + np.float32(0.5)) / np.float32(STEPS)
        self.draws = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        self.samples = samples

    def values(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.empty((len(terms), self.samples), np.float32)
        ln_s = np.log(counts.astype(np.float64)).astype(np.float32)
        low = np.uint64(STEPS - 1)
        for i in range(0, len(terms), 1024):
            h = mix(terms[i : i + 1024, None] ^ self.draws[None, :])
            r = self.r[(h & low).astype(np.int64)]
            b = self.b[((h >> np.uint64(16)) & low).astype(np.int64)]
            t = np.floor(ln_s[i : i + 1024, None] / r + b)
            out[i : i + 1024] = self.ln_c[((h >> np.uint64(32)) & low).astype(np.int64)] - r * (t - b) - r
        return out

    def signatures(self, texts: pa.Array) -> np.ndarray:
        """An unsigned 32-bit array of one row for each text."""
        n = len(texts)
        out = np.zeros((n, self.samples), np.uint32)
        hashes, docs = word_hashes(*flat(texts))
        if not len(hashes):
            return out
        # One sort brings equal words of a text together; 2**20 texts a batch at most, 44 bits of hash.
        keys = np.sort((docs.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(first, len(keys)))
        keys = keys[first]
        terms, owner = keys & np.uint64((1 << 44) - 1), (keys >> np.uint64(44)).astype(np.int64)
        pairs = (terms << np.uint64(20)) | np.minimum(counts, (1 << 20) - 1).astype(np.uint64)
        distinct, where = np.unique(pairs, return_inverse=True)
        table = self.values(distinct >> np.uint64(20), distinct & np.uint64((1 << 20) - 1))
        present, begin = np.unique(owner, return_index=True)
        for i in range(0, len(present), 64):
            a, b = begin[i], begin[i + 64] if i + 64 < len(present) else len(owner)
            least = np.minimum.reduceat(table[where[a:b]], begin[i : i + 64] - a, axis=0)
            out[present[i : i + 64]] = least.view(np.uint32)
        return out


def edited(text: str, following: str) -> str:
    """The text whose last half comes from the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per document: id and ``fingerprint`` (hex, 8 digits for each draw). No shuffle takes place.

    Null, empty and blank texts share the fingerprint of zeros. Equal texts have equal fingerprints. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for part in slices(batches, 1, SLICE):
            made = [row.astype(">u4").tobytes().hex() for row in sampler.signatures(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.string())], ["doc_id", "fingerprint"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def with_following(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, text) dealt into buckets of neighbouring ids, each with the first row of the next bucket.

    The ids' range is cut into CELLS equal cells, whose counts (a bounded table) give the bucket of each cell.
    Adds ``bucket`` and ``halo``; sorted within partitions, halo rows last in their bucket. The row after the
    last is the first.
    """
    spark = rows.sparkSession
    low, high, n, known = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1)), F.count("doc_id")).first()
    if low is None:
        low = high = 0
    width = (high - low) // CELLS + 1
    cell = F.coalesce(F.floor((F.col("doc_id") - F.lit(low)) / F.lit(width)), F.lit(0)).cast("int")
    counted = rows.select(cell.alias("cell"), "doc_id").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))
    cells = {r.cell: (r.n, r.least) for r in counted.collect()}  # CELLS rows at most
    wanted = max(1, n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bucket_of, firsts, filled = [0] * (max(cells, default=0) + 1), {}, wanted
    bucket = -1
    for c in sorted(cells):
        if filled >= wanted:
            bucket, filled = bucket + 1, 0
            firsts[bucket] = cells[c][1]
        bucket_of[c] = bucket
        filled += cells[c][0]
    if firsts and known < n:
        firsts[0] = None  # a null id comes first
    bucket_col = F.element_at(F.split(F.lit(",".join(map(str, bucket_of))), ",").cast("array<int>"), cell + 1)
    dealt = rows.select("doc_id", "text", bucket_col.alias("bucket"), F.lit(False).alias("halo"))
    # The first id of each bucket goes to the bucket before it too: as many rows as there are buckets.
    edges = [(firsts[(b + 1) % len(firsts)], b) for b in firsts]
    table = spark.createDataFrame(edges, "first_id bigint, bucket int")
    halo = rows.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("first_id")))
    halo = halo.select("doc_id", "text", "bucket", F.lit(True).alias("halo"))
    return dealt.union(halo).repartition("bucket").sortWithinPartitions("bucket", "halo", "doc_id", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    Documents are taken in ascending id (equal ids by text, null id first); the edited text replaces the last
    floor(n/2) code points by as many of the next document's first ones, or by all it has. Likeness is the share
    of equal draws. Texts are shuffled once, by buckets of neighbouring ids, so that no task sees more than its
    buckets; ids must be integers. Null texts count as empty; two texts without words have likeness 1.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held: pa.Table | None = None
        for part in slices(batches, 1, SLICE):
            table = pa.Table.from_batches([part])
            if held is not None:
                table = pa.concat_tables([held, table])
            held = table.slice(table.num_rows - 1)
            kept = np.flatnonzero(~table.column(3).to_numpy()[:-1])
            if not len(kept):
                continue
            texts = table.column(1).combine_chunks()
            strings = texts.to_pylist()
            changed = [edited(strings[i], strings[i + 1]) for i in kept]
            own, other = sampler.signatures(texts), sampler.signatures(pa.array(changed, pa.string()))
            hexed = lambda m: [row.astype(">u4").tobytes().hex() for row in m]
            arrays = [
                table.column(0).combine_chunks().take(pa.array(kept)),
                pa.array([len(strings[i]) for i in kept], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array(hexed(own[kept]), pa.string()),
                pa.array(hexed(other), pa.string()),
                pa.array((own[kept] == other).mean(axis=1)),
                pa.array((own[kept] == own[kept + 1]).mean(axis=1)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = ["bigint", "bigint", "string", "string", "string", "double", "double"]
    return with_following(rows).mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))
