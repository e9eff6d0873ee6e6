from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

import corpus_pipeline
from emberlog.llm import language, mixing, ngram_join, queries

from .helpers import SF, frame, odd_texts, sf_documents
from .test_line_dedup import brute as brute_lines
from .test_ngram_join import brute as brute_join


@pytest.mark.parametrize("seed", range(8))
def test_schedule_stays_within_a_block(seed):
    rng = random.Random(seed)
    shares = mixing.quantise([rng.random() ** 3 + 0.001 for _ in range(rng.randrange(1, 30))], 400)
    assert sum(shares) == 400 and min(shares) >= 1
    got = mixing.schedule(shares)
    assert Counter(s for s, _ in got) == dict(enumerate(shares))
    assert mixing.deviation([s for s, _ in got] * 2, shares) < 1
    blocks = defaultdict(list)
    for s, j in got:
        blocks[s].append(j)
    assert all(b == list(range(len(b))) for b in blocks.values())


def sources(rng, n=400):
    names = ["hot"] * 10 + ["a", "b", "c", None]
    return [(i, "w" * rng.randrange(0, 900), "en", rng.choice(names)) for i in range(n)]


def by_source(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.source].append(r)
    return out


@pytest.mark.parametrize("clash,buckets", [(False, 20_000), (True, 7)])
def test_mixture_holds_target_weights(spark, monkeypatch, clash, buckets):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", buckets)
    rows = sources(random.Random(1))
    weights = {"hot": 0.4, "a": 0.3, "b": 0.2, None: 0.1}
    got = mixing.mix_sources(frame(spark, rows, clash), weights, block_bytes=1000, resolution=50).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in rows]
    groups = by_source(got)
    assert all(r.slot is None and not r.in_mix for r in groups["c"])
    turns = {}
    for name, docs in groups.items():
        if name == "c":
            continue
        total = sum(r.n_bytes + 1 for r in docs)
        assert max(r.block for r in docs) <= total // 1000
        slot = {}
        for r in docs:
            assert slot.setdefault(r.block, r.slot) == r.slot and turns.setdefault(r.slot, name) == name
        assert [slot[b] for b in sorted(slot)] == sorted(slot.values())
        # Blocks are runs of the bytes: what lies in blocks below b is at least b * 1000 less one document.
        for b in slot:
            below = sum(r.n_bytes + 1 for r in docs if r.block < b)
            assert b * 1000 <= below < b * 1000 + 1000
    end = 1 + max(r.slot for r in got if r.in_mix)
    shares = {n: round(w * 50) for n, w in weights.items()}
    for name, q in shares.items():
        slots = {r.slot for r in groups[name] if r.in_mix}
        for t in range(1, end):
            assert abs(len([s for s in slots if s < t]) - Fraction(t * q, 50)) < 1
    assert min(max(r.slot for r in groups[n]) for n in weights) <= end + 50


def test_mixing_edge_cases(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark, [])).count() == 0
    odd = [(i, t, None, "s" if i % 3 else None) for i, t in enumerate(odd_texts())] + [(1, "", None, "s")] * 3 + [(None, None)]
    got = mixing.mix_sources(frame(spark, odd, True)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd)
    assert all(r.slot is not None for r in got)
    with pytest.raises(ValueError):
        mixing.mix_sources(frame(spark, odd), {"s": -1.0})


def test_mixing_query(spark):
    docs = sf_documents(spark).collect()
    got = queries.op4_mixing(spark, SF).collect()
    assert {r.doc_id: (r.source, r.n_bytes) for r in got} == {r.doc_id: (r.source, len(r.text.encode())) for r in docs}
    assert any(r.in_mix for r in got)


def test_single_source_is_kept_whole(spark):
    rows = [(i, "some words here", "en", "only") for i in range(30)]
    assert mixing.mixture(frame(spark, rows)).count() == 30


def test_mixture_goes_on_when_a_source_has_run_dry(spark):
    """One stray document of a source of its own takes no other document out of the mixture."""
    rows = [(i, "w" * 900, "en", "ab"[i % 2]) for i in range(400)] + [(1000, "stray", "en", "c"), (1001, "stray", "en", None)]
    docs = frame(spark, rows, True)
    got = [r[0] for r in mixing.mixture(docs, block_bytes=1000).collect()]
    assert sorted(got) == sorted(r[0] for r in rows)
    slot = {r.doc_id: r.slot for r in mixing.mix_sources(docs, block_bytes=1000).collect()}
    assert [slot[d] for d in got] == sorted(slot.values())
    assert [r[0] for r in mixing.mixture(docs, {"c": 1.0}).collect()] == [1000]


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, held against a plain version of it."""
    docs = sf_documents(spark)
    columns = docs.columns
    kept = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, spark.createDataFrame(kept, docs.schema), SF)
        if name != "packing":
            assert result.columns == columns
        rows = result.collect()
        before = {r.doc_id: r for r in kept}
        if name == "language_id":
            model = language.fit(docs.where(~language.held_out()).select("text", "lang"))
            told = {d: model.predict(r.text) for d, r in before.items()}
            assert {r.doc_id for r in rows} == {d for d, (lang, p) in told.items() if lang != "und" and p >= 0.5}
        elif name == "line_dedup":
            gone = brute_lines([(d, r.text) for d, r in before.items()])
            want = {}
            for d, r in before.items():
                text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[d][1])
                if not gone[d][1] or re.search(r"[^\x20\x09-\x0D]", text):
                    want[d] = text
            assert {r.doc_id: r.text for r in rows} == want
            assert all(r.n_chars == len(r.text) for r in rows)
        elif name == "ngram_jaccard_join":
            groups = brute_join([(d, r.text) for d, r in before.items()], 5, 80, 100)
            assert {r.doc_id for r in rows} == {d for d, _, c, _ in groups if d == c}
        elif name == "mixing":
            slot = {r.doc_id: r.slot for r in mixing.mix_sources(spark.createDataFrame(kept, docs.schema)).collect()}
            assert sorted(r.doc_id for r in rows) == sorted(before)
            assert [slot[r.doc_id] for r in rows] == sorted(slot.values())
        else:
            assert {r.doc_id for r in rows} == set(before)
        if name != "packing":
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in rows) or name == "line_dedup"
            kept = rows
    assert len(kept) > 30


def test_pipeline_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 30 and "sequence_id" in got.columns


def test_pipeline_stages_take_odd_tables(spark):
    odd = [(i, t, "en", "s") for i, t in enumerate(odd_texts())] + [(None, None), (1, "twice"), (1, "twice")]
    for rows in (odd, []):
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, frame(spark, rows, True), SF).count()
