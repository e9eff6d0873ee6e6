from __future__ import annotations

import random
import re

import numpy as np
import pytest

from emberlog.llm import clusters, ngram_join, queries

from .helpers import SF, frame, odd_texts, sf_documents


def shingles(text, k):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows, k, num, den):
    """{position: (set size, component id, linked other sets)} by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    linked = [set() for _ in rows]
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (n := len(a & b)) and den * n >= num * (len(a) + len(b) - n):
                up[root(i)] = root(j)
                if a != b:
                    linked[i].add(b)
                    linked[j].add(a)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None) if sets[i] else d, len(linked[i])))
    return sorted(out, key=str)


def thue_morse(n):
    """A word of n letters in which the number's odd bits decide, and the word with the letters exchanged."""
    word = "".join("ab"[k.bit_count() & 1] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def edits(rng, n_bases=12, copies=14):
    """Texts in families: each copy changes some words of the family's text or of another copy."""
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n_bases):
        family = [[rng.choice(words) for _ in range(rng.choice([1, 2, 4, 7, 11, 14, 30, 90, 250]))]]
        for _ in range(copies):
            new = list(rng.choice(family))
            for _ in range(rng.randrange(0, 1 + max(1, len(new) // 25))):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice([[], [rng.choice(words)], [rng.choice(words), new[at]]])
                new = new or ["x"]
            family.append(new)
        out += [" ".join(f) for f in family]
    return out


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100), (1, 60, 100)])
def test_against_all_pairs(spark, k, num, den):
    rng = random.Random(k)
    texts = edits(rng) + [t for t in odd_texts() if len(t or "") < 9000] + ["A b C d", "a B c D"]
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts))
    got = ngram_join.ngram_join(frame(spark, rows, k == 5), k, num, den).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, k, num, den)


def test_split_clusters_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MEMBERS", 7)
    rng = random.Random(4)
    texts = edits(rng, 3, 60)
    rows = list(enumerate(texts))
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, 3, 90, 100)


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (4, "A B C D"), (None, None), (9, "")]
    got = ngram_join.ngram_join(frame(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, 3, 90, 100)
    assert ngram_join.ngram_join(frame(spark, [])).count() == 0
    assert ngram_join.keep_firsts(frame(spark, [])).count() == 0


def test_keep_firsts(spark):
    rng = random.Random(8)
    rows = list(enumerate(edits(rng, 6, 10) + ["", None, "  "]))
    docs = frame(spark, rows, True)
    kept = ngram_join.keep_firsts(docs)
    assert kept.columns == docs.columns
    want = {d for d, n, c, _ in brute(rows, 5, 80, 100) if d == c}
    assert {r[0] for r in kept.collect()} == want


@pytest.mark.parametrize("num", [60, 80, 90])
def test_similar_sets_share_a_key(num):
    """The pigeonhole, on random pairs at the threshold: a shared key that is a whole segment in one of the two."""
    rng = np.random.default_rng(num)
    plan = ngram_join.bands(3000, num, 100)
    for _ in range(400):
        size = int(rng.integers(1, 1500))
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        b = a.copy()
        while True:
            c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 2**64, 1, dtype=np.uint64)))
            n = len(np.intersect1d(a, c))
            if 100 * n < num * (len(a) + len(c) - n):
                break
            b = c
        if np.array_equal(a, b):
            continue
        keys = []
        for one in (a, b):
            own = next(x.number for x in plan if x.high >= len(one))
            mine = {}
            for band in plan[: own + 1]:
                if band.partner >= len(one) and band.most:
                    for key, whole in zip(*ngram_join.band_keys(one, band)):
                        mine[int(key)] = mine.get(int(key), False) or bool(whole)
            keys.append(mine)
        assert any(keys[0][k] or keys[1][k] for k in keys[0].keys() & keys[1].keys())


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    up = {n: n for e in edges for n in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = clusters.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    ends = {n for a, b in edges if a != b for n in (a, b)}
    assert {r.node: r.root for r in got} == {n: root(n) for n in ends}


def test_firsts_of_rows_without_an_id_and_with_one_id(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(1, text(1)), (None, text(1)), (None, text(2)), (None, text(3)), (None, text(3)), (7, text(1)), (7, text(4)), (8, text(5)), (8, text(5))]
    rows += [(9, None), (9, None), (None, "")]
    kept = ngram_join.keep_firsts(frame(spark, rows, True)).collect()
    want = [(1, text(1)), (None, text(2)), (None, text(3)), (7, text(4)), (8, text(5)), (9, None), (9, None), (None, "")]
    assert sorted(((r[0], r[1]) for r in kept), key=str) == sorted(want, key=str)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in sf_documents(spark).collect()]
    got = queries.op9_ngram_join(spark, SF).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got), key=str) == brute(rows, 3, 90, 100)


def test_words_that_cancel_out_in_polynomials(spark):
    for n in (1024, 4096):
        word, other = thue_morse(n)
        rows = [(1, word), (2, other), (3, f"{word} x y"), (4, f"{other} x y")]
        assert all(r.component_id == r.doc_id for r in ngram_join.ngram_join(frame(spark, rows)).collect())
        assert ngram_join.keep_firsts(frame(spark, rows)).count() == 4


def test_a_shared_passage_does_not_group_unlike_sets():
    rng = np.random.default_rng(3)

    def made(n):
        return rng.integers(0, 1 << 64, n, dtype=np.uint64)

    passage, big_passage = made(80), made(800)
    sets = [np.unique(np.concatenate([passage, made(320)])) for _ in range(30)]
    sets += [np.unique(np.concatenate([big_passage, made(6000)])) for _ in range(6)]
    sets += [np.unique(np.concatenate([s[:-10], made(10)])) for s in sets]
    sketches = [np.frombuffer(ngram_join.sketch(s), np.uint8) for s in sets]
    heads = ngram_join.near_sketches(sketches, np.array([len(s) for s in sets]), 80, 100, None, np.zeros(len(sets), np.int64))
    half = len(sets) // 2
    assert (heads[:half] == heads[half:]).all() and len(set(heads.tolist())) == half
