"""Fixtures shared by the tests of the corpus operators."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names clash with each other and with what the operators return.
CLASH = DOC + ", Text string, n_tokens string, score string, sequence_id string, component_id string, kept string"


def frame(spark, rows, clash: bool = False):
    """A documents table of (doc_id, text[, lang[, source]]) rows."""
    full = [(tuple(r) + (None,) * 4)[:4] + (len(r[1]) if r[1] is not None else None,) for r in rows]
    if clash:
        spark.conf.set("spark.sql.caseSensitive", "true")
        full = [r + ("x", None, "y", "z", None, "w") for r in full]
        made = spark.createDataFrame(full, CLASH)
        spark.conf.set("spark.sql.caseSensitive", "false")
        return made
    return spark.createDataFrame(full, DOC)


def odd_texts() -> list[str | None]:
    """Null, empty, white space, other scripts, special strings, repeated and very long texts."""
    rng = random.Random(5)
    words = ["the", "of", "Größe", "naïve", "x1y2", "don't", "we'll", "!!", "123", "日本語", "한국", " ", "ſecret", "<|endoftext|>", "a\tb"]
    gaps = [" ", " ", " ", "  ", "\n", " \n", "\n ", "  ", "\x1f ", "\r\n", ""]
    mixed = ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(1, 120))) for _ in range(60)]
    return [None, "", " ", "\n\n", "a", "a" * 5000, "ab1" * 60000, "word " * 30000, "<|endoftext|>", "x<|endoftext|> y", *mixed, *mixed[:5]]


def sf_documents(spark, sf_dir: str = SF):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
