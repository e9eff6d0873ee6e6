from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import queries, suffix_dedup

from .helpers import SF, frame, odd_texts, sf_documents


def brute(texts, length):
    """(bytes, removed, runs, hash) of each text, from counts of all its strings."""
    data = [(t or "").encode() for t in texts]
    counts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if counts[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def spliced(rng, n=80):
    """Texts that share passages of lengths around the limit, at text borders and inside."""
    letters = "abcdefgh é\n"
    fresh = lambda k: "".join(rng.choice(letters) for _ in range(k))
    passages = [fresh(rng.randrange(20, 260)) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p))
            parts += [fresh(rng.choice([0, 1, 5, 60])), rng.choice([p, p[cut:], p[:cut]])]
        out.append("".join(parts))
    return out


def check(got, texts, length):
    want = brute(texts, length)
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], (r.doc_id, (texts[r.doc_id] or "")[:80])


@pytest.mark.parametrize("length,gram,hot", [(200, 72, 100_000), (60, 24, 100_000), (60, 60, 100_000), (60, 24, 3)])
def test_against_brute_force(spark, length, gram, hot):
    rng = random.Random(length + gram + hot)
    texts = spliced(rng) + [t for t in odd_texts() if len(t or "") < 6000] + ["ab" * 300, "xyz" * 70 + "q"]
    got = suffix_dedup.repeated_strings(frame(spark, list(enumerate(texts)), hot == 3), length, gram, hot=hot).collect()
    check(got, texts, length)


def test_long_texts_are_cut_safely(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 500)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 16)
    texts = spliced(random.Random(11), 30)
    texts += ["".join(texts[:9]), "".join(texts[5:14])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(suffix_dedup.repeated_strings(rows, 60, 24).collect(), texts, 60)


def test_null_ids_repeated_rows_and_empty(spark):
    long = "".join(random.Random(1).choice("abcd") for _ in range(500))
    rows = [(None, long), (1, "x" + long), (1, "x" + long), (2, None), (2, "short"), (3, "")]
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.repeated_strings(frame(spark, rows)).collect())
    assert got == Counter({(None, 500, 500, 1): 1, (1, 501, 501, 1): 2, (2, 0, 0, 0): 1, (2, 5, 0, 0): 1, (3, 0, 0, 0): 1})
    assert suffix_dedup.repeated_strings(frame(spark, [])).count() == 0


def test_kept_text_and_spans(spark):
    shared = "".join(random.Random(2).choice("abcd") for _ in range(300))
    rows = [(1, "start " + shared + " end"), (2, shared), (3, "é" + shared[:210] + "|")]
    got = {r.doc_id: r for r in suffix_dedup.repeated_strings(frame(spark, rows), with_text=True).collect()}
    assert bytes(got[1].kept) == b"start  end" and got[1].spans == [6, 306]
    assert bytes(got[2].kept) == b"" and got[3].spans == [2, 212] and bytes(got[3].kept) == "é|".encode()


def test_multikey_order():
    rng = np.random.default_rng(4)
    matrix = rng.integers(0, 2, (300, 21)).astype(np.uint8)
    matrix[100:200] = matrix[:100]
    order, common = suffix_dedup.multikey_order(matrix)
    rows = [bytes(matrix[i]) for i in order]
    assert rows == sorted(rows)
    for i, c in enumerate(common):
        a, b = rows[i], rows[i + 1]
        assert a[:c] == b[:c] and (c == 21 or a[c] != b[c])


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in sf_documents(spark).collect())
    want = dict(zip([d for d, _ in docs], brute([t for _, t in docs], 200)))
    got = queries.op3_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_texts_that_cancel_out_in_polynomials(spark):
    """Two texts with a common middle; their differences on both sides cancel out in a sum of bytes times powers."""
    p = np.array([1], np.int64)
    for i, m in enumerate((1, 3, 3, 3, 3, 1)):
        factor = np.zeros((1 << i) + 1, np.int64)
        factor[0], factor[-1] = -1, 1
        for _ in range(m):
            p = np.convolve(p, factor)
    p = np.pad(p, (0, 128 - len(p)))
    base = 0x9E3779B97F4A7C15
    assert sum(int(c) * (pow(base, k, 1 << 64) + pow(base, k + 200, 1 << 64)) for k, c in enumerate(p)) % (1 << 64) == 0
    low, high = (bytes((60 + np.maximum(s * p, 0)).astype(np.uint8)) for s in (1, -1))
    middle = bytes(65 + i % 23 for i in range(72))
    texts = [(a + middle + a).decode() for a in (low, high)]
    assert max(map(max, (t.encode() for t in texts))) < 127 and not {texts[0][i : i + 200] for i in range(129)} & {texts[1][i : i + 200] for i in range(129)}
    got = suffix_dedup.repeated_strings(frame(spark, list(enumerate(texts)))).collect()
    assert [r.n_removed for r in got] == [0, 0]
