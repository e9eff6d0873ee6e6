"""Token counts: Arrow batches in, lengths out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, pick, slices, text_bytes
from .tokens import counter

CONTEXT = 512


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = CONTEXT,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per document: id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Tokens are counted as the ``tokenizers`` library does for the whole text, without added special tokens;
    special strings inside a text are read as the library's default reads them. Batches are cut to about
    ``slice_bytes`` of text, a long text is split where a pre-token must end. No shuffle takes place.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows each give a row. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    path = vocabulary or default_vocabulary()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = counter(path)
        for part in slices(batches, 1, slice_bytes):
            texts = part.column(1)
            sizes = text_bytes(texts)
            n = memo.results([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
