from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberlog.llm import queries, token_files

from .helpers import DOC, SF, frame, odd_texts, sf_documents


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(token_files.default_vocabulary())


def brute(tokenizer, docs):
    """Digests of (doc_id, text), ids of whole texts one after the other."""
    out, start = [], 0
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def told(result):
    assert result.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    return sorted((tuple(r) for r in result.collect()), key=lambda r: r[1])


@pytest.mark.parametrize("clash", [False, True])
def test_odd_texts_against_the_library(spark, tokenizer, clash):
    docs = list(enumerate(odd_texts()))
    assert told(token_files.token_files(frame(spark, docs[::-1], clash))) == brute(tokenizer, docs)


def test_query_against_the_library(spark, tokenizer):
    docs = sorted((r.doc_id, r.text) for r in sf_documents(spark).collect())
    assert told(queries.op13_token_files(spark, SF)) == brute(tokenizer, docs)


def test_other_vocabularies_and_files(spark, tmp_path):
    """A byte-level vocabulary, ids read back as lists, several shards."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = list(enumerate(odd_texts()))
    out = str(tmp_path / "files")
    token_files.write_ids(frame(spark, docs), out, vocabulary=path, end_id=0)
    other = Tokenizer.from_file(path)
    got = sorted(token_files.read_ids(spark, out).collect(), key=lambda r: r.start)
    assert [r.ids for r in got] == [other.encode(t or "", add_special_tokens=False).ids + [0] for _, t in docs]


def test_null_and_repeated_ids_and_empty_tables(spark, tokenizer):
    docs = [(None, "b"), (None, None), (3, "same"), (3, "same"), (3, "other one"), (9, "")]
    got = told(token_files.token_files(frame(spark, docs)))
    assert [r[0] for r in got] == [None, None, 3, 3, 3, 9]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(tokenizer, docs))
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert told(token_files.token_files(spark.createDataFrame([], DOC))) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=60), min_size=1, max_size=5))
def test_encoding_by_stretches_equals_whole_texts(texts):
    encoder = token_files._ENCODERS.setdefault("fuzz", token_files.IdEncoder(token_files.default_vocabulary(), 50))
    assert encoder.by_words
    found = encoder.encode(texts, np.dtype("<u2"))
    assert found == encoder.batch(texts, np.dtype("<u2"))


def test_latin_words_and_marks_equal_whole_texts(spark):
    """Each distinct stretch of the documents, and every short mix of letters, accents and marks."""
    rng = random.Random(9)
    signs = "aZéÀßÿ×÷ªµ'.,-_<|>!`~^3 \u0301İſǅ"
    words = sorted({w for r in sf_documents(spark, "/root/testdata/sf0.01").select("text").collect() for w in (r.text or "").split()})
    words += ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 9))) for _ in range(20_000)]
    encoder = token_files.IdEncoder(token_files.default_vocabulary(), 5000)
    for a in range(0, len(words), 7000):
        part = words[a : a + 7000]
        assert encoder.encode(part, np.dtype("<u2")) == encoder.batch(part, np.dtype("<u2"))


def best_cost(counts, limit):
    """Least total bits of a length-limited code, by dynamic programming over the sizes of levels."""
    counts = sorted(counts, reverse=True)
    n = len(counts)
    before = np.concatenate([[0], np.cumsum(counts)])
    best = {(0, 1): 0}
    for _ in range(limit):
        after: dict[tuple[int, int], int] = {}
        for (done, open_), cost in best.items():
            for leaves in range(0, min(2 * open_, n - done) + 1):
                rest = 2 * open_ - leaves
                if rest > n - done - leaves and rest:
                    continue
                key, price = (done + leaves, rest), cost + int(before[n] - before[done])
                if price < after.get(key, 1 << 60):
                    after[key] = price
        for key, cost in best.items():
            if key[1] == 0:
                after[key] = min(cost, after.get(key, cost))
        best = after
    return min(v for (done, open_), v in best.items() if done == n and open_ == 0)


def test_code_lengths_are_the_best_within_the_limit():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randrange(2, 12)
        counts = np.array([int(rng.paretovariate(0.4)) for _ in range(n)])
        limit = rng.randrange((n - 1).bit_length(), 9)
        lengths = token_files.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -lengths) == 1
        assert int((lengths * counts).sum()) == best_cost(counts.tolist(), limit)


def test_code_is_canonical_and_prefix_free():
    symbols = np.array([9, 4, 7, 1, 30])
    code = token_files.Code(symbols, token_files.code_lengths(np.array([50, 2, 2, 9, 1]), 18))
    words = [format(w, f"0{n}b") for w, n in zip(code.words.tolist(), code.lengths.tolist())]
    assert words == sorted(words) and not any(b.startswith(a) for a, b in zip(words, words[1:]))
    assert code.symbols.tolist() == [9, 1, 7, 4, 30] or code.symbols.tolist() == [9, 1, 4, 7, 30]
    with pytest.raises(ValueError):
        token_files.code_lengths(np.ones(5, np.int64), 2)


@pytest.mark.parametrize("n,symbols", [(1, 1), (511, 3), (512, 40_000), (513, 2), (70_000, 40_000)])
def test_shards_round_trip_from_any_block(monkeypatch, n, symbols):
    monkeypatch.setattr(token_files, "CHUNK_BLOCKS", 7)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n) - 1, symbols - 1).astype("<u2")
    found, counts = np.unique(ids, return_counts=True)
    code = token_files.Code(found.astype(np.int64), token_files.code_lengths(counts, 18))
    cuts = np.sort(rng.integers(0, n, 5))
    texts = [x.tobytes() for x in np.split(ids, cuts)]
    shard = token_files.write_shard(code, pa.array(range(6)), texts, np.dtype("<u2"))
    index, pieces = token_files.read_shard(code, shard)
    assert index.column(1).to_pylist() == [len(t) // 2 for t in texts]
    assert np.concatenate(list(pieces)).tolist() == ids.tolist()
    head = token_files._HEAD.unpack_from(shard)
    marks = np.frombuffer(shard, "<u8", head[6], token_files._HEAD.size).astype(np.int64)
    data = np.frombuffer(shard, np.uint8, head[5], token_files._HEAD.size + 8 * head[6] + head[7])
    for k in {0, head[6] // 2, head[6] - 1}:
        part = ids[512 * k : 512 * (k + 1)]
        assert code.unpack(data, marks[k : k + 1], 512)[: len(part)].tolist() == part.tolist()
    with pytest.raises(ValueError):
        token_files.read_shard(token_files.Code(np.array([1, 2, 3]), np.array([1, 2, 2])), shard)
