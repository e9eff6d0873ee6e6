"""Packing of token pieces into training sequences: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices
from .token_counts import default_vocabulary
from .tokens import id_encoder

SEQUENCE = 1024
SEGMENTS = 64
WINDOW = 4096
SLACK = 8
END = b"\0\0\0\0"


class _Piece:
    """A run of a document's ids that is not placed yet."""

    __slots__ = ("doc", "start", "ids", "total", "quiet")

    def __init__(self, doc, start: int, ids: bytes, total: int, quiet: int) -> None:
        self.doc, self.start, self.ids, self.total, self.quiet = doc, start, ids, total, quiet

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        """Ids of the run that bear loss: those after the prompt, without the closing id."""
        stop = min(self.start + self.length, self.total - 1)
        return max(0, stop - max(self.start, self.quiet))

    def cut(self, n: int) -> tuple[_Piece, _Piece]:
        head = _Piece(self.doc, self.start, self.ids[: 4 * n], self.total, self.quiet)
        tail = _Piece(self.doc, self.start + n, self.ids[4 * n :], self.total, self.quiet)
        return head, tail


class _Packer:
    """Fills sequences from a window of pieces; holds at most the window and one sequence."""

    def __init__(self, first_id: int, length: int, segments: int, loss: int, window: int) -> None:
        self.next_id, self.limits, self.window = first_id, np.array([length, segments, loss], np.float64), window
        self.waiting: list[_Piece] = []
        self.done: list[tuple] = []

    def add(self, piece: _Piece) -> None:
        length, loss = int(self.limits[0]), int(self.limits[2])
        while piece.length >= length:
            head, rest = piece.cut(length)
            if head.loss > loss:
                break
            self.emit([head])
            piece = rest
        while piece.loss > loss or piece.length > length:
            head, piece = piece.cut(min(length, loss))
            self.waiting.append(head)
        if piece.length:
            self.waiting.append(piece)
        if len(self.waiting) >= self.window:
            self.fill(self.window // 4)

    def emit(self, pieces: list[_Piece]) -> None:
        offset = 0
        for p in pieces:
            crc = zlib.crc32(p.ids)
            self.done.append((p.doc, p.start, p.length, crc, p.total, self.next_id, offset, p.loss, p.ids))
            offset += p.length
        self.next_id += 1

    def fill(self, until: int) -> None:
        """Fill sequences until so many pieces at most still wait."""
        while len(self.waiting) > until:
            pieces = self.waiting
            needs = np.array([(p.length, 1, p.loss) for p in pieces], np.float64)
            scaled, free = needs / self.limits, np.ones(len(pieces), bool)
            more: list[_Piece] = []
            while np.count_nonzero(free) > until:
                self.emit(self.one(pieces, needs, scaled, free, more))
                if len(more) > 64:
                    break
            self.waiting = [p for p, f in zip(pieces, free) if f] + more

    def one(self, pieces, needs, scaled, free, more) -> list[_Piece]:
        """One sequence. Of the pieces that fit, the one whose needs point most along what is left goes in next."""
        left, taken = self.limits.copy(), []
        while left[0] >= 1:
            fits = free & (needs <= left).all(axis=1)
            if not fits.any():
                break
            best = int(np.argmax(np.where(fits, scaled @ (left / self.limits), -1.0)))
            free[best] = False
            left -= needs[best]
            taken.append(pieces[best])
        gap = int(min(left[0], left[2]))
        if gap > SLACK and left[1] >= 1 and free.any():
            sizes = np.where(free, needs[:, 0], -1.0)
            best = int(np.argmax(sizes))
            if sizes[best] > gap:
                head, tail = pieces[best].cut(gap)
                free[best] = False
                taken.append(head)
                more.append(tail)
                left[0] -= gap
        if left[0] > SLACK:
            self.trim(taken, int(self.limits[0] - left[0]), more)
        return taken

    @staticmethod
    def trim(taken: list[_Piece], total: int, more: list[_Piece]) -> None:
        """Shorten a sequence that stays short to a power of two, which needs no padding."""
        over = total - (1 << (total.bit_length() - 1))
        while over:
            last = taken.pop()
            if last.length <= over:
                over -= last.length
                more.append(last)
            else:
                head, tail = last.cut(last.length - over)
                taken.append(head)
                more.append(tail)
                over = 0


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    length: int = SEQUENCE,
    segments: int = SEGMENTS,
    loss_tokens: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    with_ids: bool = False,
    window: int = WINDOW,
) -> DataFrame:
    """One row per placed piece of a document's ids.

    A document is the ids of its text and a closing id 0; with ``prompt_col`` (instruction data) the prompt's
    ids come first and bear no loss, nor does the closing id. Documents are cut freely. A sequence keeps three
    limits at once: ``length`` ids, ``segments`` pieces, ``loss_tokens`` loss-bearing ids (default: ``length``).
    Runs of full length fill sequences of their own; what remains is placed from a window of ``window`` pieces
    by the dot-product heuristic, and a gap that no piece fits is filled by cutting one. A sequence that stays
    short is trimmed to a power of two. Padding is thus at most SLACK ids per sequence.

    Each task packs its own rows: no shuffle, and memory for one window. ``sequence_id`` holds the task's
    partition in its upper bits, so that a repeated task gives the same ids.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens; with ``with_ids``
    also ids. Null and empty texts give one piece with the closing id. Repeated rows are packed each. An empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()
    loss = length if loss_tokens is None else loss_tokens
    if length < 1 or segments < 1 or loss < 1:
        raise ValueError("limits must be positive")
    names = [id_col, text_col] + ([prompt_col] if prompt_col else [])
    rows = pick(docs, *names).toDF(*["doc_id", "text", "prompt"][: len(names)])
    if prompt_col:
        rows = rows.withColumn("prompt", F.coalesce("prompt", F.lit("")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = id_encoder(path)
        packer = _Packer(TaskContext.get().partitionId() << 40, length, segments, loss, window)

        def flush(kind: pa.DataType) -> pa.RecordBatch:
            done, packer.done = packer.done, []
            parts = [pa.array([r[0] for r in done], kind)]
            parts += [pa.array([r[i] for r in done], pa.int64()) for i in range(1, 8)]
            if with_ids:
                ids = [np.frombuffer(r[8], "<u4").astype(np.int32) for r in done]
                parts.append(pa.array(ids, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(parts, columns + ["ids"] * with_ids)

        kind = pa.int64()
        for part in slices(batches):
            kind = part.column(0).type
            encoded = encoder.results([t or "" for t in part.column(1).to_pylist()])
            prompts = encoder.results(part.column(2).to_pylist()) if prompt_col else [b""] * part.num_rows
            for doc, ids, prompt in zip(part.column(0).to_pylist(), encoded, prompts):
                whole = prompt + ids + END
                packer.add(_Piece(doc, 0, whole, len(whole) // 4, len(prompt) // 4))
            if packer.done:
                yield flush(kind)
        packer.fill(0)
        if packer.done:
            yield flush(kind)

    id_kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, " + ", ".join(f"{c} bigint" for c in columns[1:]) + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)
