from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import queries, resampling
from emberlog.runtime import materialize

from .helpers import DOC, SF, frame, odd_texts, sf_documents

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, max_n=1, buckets=10_000, least=20, num=10, den=100, seed=2024):
    """doc index -> (n_features, weight, score, rank), by dictionaries."""
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in docs for g in grams(t, max_n)[1])
    t = Counter(bucket(g) for x in target for g in grams(x, max_n)[1])
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    out, able = [], []
    for i, (doc, text) in enumerate(docs):
        n, found = grams(text, max_n)
        weight = 0
        for b in map(bucket, found):
            weight += math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets))))
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([len(found), weight, score, None])
        if n >= least:
            able.append((-score, doc is not None, doc or 0, i))
    for k, (*_, i) in enumerate(sorted(able)[: len(able) * num // den]):
        out[i][3] = k + 1
    return [tuple(r) for r in out]


def rows_of(result):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n_features, r.weight, r.score, r["rank"] or 0) for r in result.collect())


def wanted(docs, told):
    return sorted((d is not None, d or 0, *r[:3], r[3] or 0) for (d, _), r in zip(docs, told))


@pytest.mark.parametrize("max_n,clash", [(1, False), (3, True)])
def test_odd_texts_against_brute_force(spark, max_n, clash):
    docs = list(enumerate(odd_texts())) + [(None, "of the x1y2 " * 9), (3, "naïve THE of " * 30)]
    target = ["Größe, of THE", None, "", "x1y2 the-the"]
    made = frame(spark, docs, clash)
    got = resampling.resample(made, frame(spark, list(enumerate(target))), max_n=max_n, num=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert rows_of(got) == wanted(docs, brute(docs, target, max_n, num=40))


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in sf_documents(spark).collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert rows_of(queries.op11_resampling(spark, SF)) == wanted(docs, brute(docs, target))


def test_ties_repeats_and_empty_tables(spark):
    docs = [(7, "a b c " * 10)] * 40 + [(8, "")]
    got = resampling.resample(frame(spark, docs), frame(spark, []))
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4]
    assert len({(r.weight, r.score) for r in got.collect() if r.doc_id == 7}) == 1
    assert resampling.resample(spark.createDataFrame([], DOC), frame(spark, docs)).collect() == []


def test_target_texts_are_preferred(spark):
    rng = random.Random(3)
    near, far = [f"near{i}" for i in range(50)], [f"far{i}" for i in range(50)]
    docs = [(i, " ".join(rng.choices(near if i % 10 == 0 else far, k=100))) for i in range(1000)]
    target = [(i, " ".join(rng.choices(near, k=100))) for i in range(50)]
    made = frame(spark, docs, clash=True)
    ranks = materialize(resampling.resample(made, frame(spark, target)))
    assert {r.doc_id for r in ranks.where("rank IS NOT NULL").collect()} == {i for i in range(1000) if i % 10 == 0}
    drawn = resampling.drawn_documents(made, ranks)
    assert drawn.columns == made.columns and drawn.count() == 100


def test_table_tells_equal_hashes_apart(monkeypatch):
    """All n-grams get one hash; bytes decide, whatever their length."""
    words = ["a", "b", "ab", "abcdefgh", "abcdefgi", "abcdefghi", "x" * 30, "x" * 29 + "y", "a"]
    text = " ".join(words).encode()
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = ends - [len(w) for w in words]
    for digest in (lambda b: 5, lambda b: len(b)):
        table = resampling.GramTable(text + bytes(8), begins, ends, 10_000, digest)
        assert table.bucket[table.slot].tolist() == [zlib.crc32(w.encode()) % 10_000 for w in words]
        assert table.counts[table.slot].tolist() == [words.count(w) for w in words]


def test_long_texts_take_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 1000)
    import pyarrow as pa

    texts = pa.array(["one two three " * 3000, None, "one", "two three"])
    total, owners = np.zeros(100, np.int64), []
    for table, owner in resampling.tables(resampling.Words(texts), 2, 100):
        total += table.histogram(100)
        owners.extend(owner.tolist())
    want = Counter(zlib.crc32(g.encode()) % 100 for t in texts.to_pylist() for g in grams(t, 2)[1])
    assert {b: n for b, n in enumerate(total.tolist()) if n} == dict(want)
    assert Counter(owners) == Counter({0: 17999, 2: 1, 3: 3})
