from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from emberlog.llm import fingerprints, language, quality, queries

from .helpers import SF, frame, odd_texts, sf_documents

SF01 = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = {r.doc_id: r for r in sf_documents(spark, SF01).collect()}
    rows = queries.op1_language(spark, SF01).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    right = [r.lang_pred == docs[r.doc_id].lang for r in held]
    assert len(held) > 200 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("clash", [False, True])
def test_language_edge_cases(spark, clash):
    english, french = "the cat sat on the mat with a hat " * 3, "le chat est sur la table avec un chapeau " * 3
    rows = [(i, english if i % 2 else french, "en" if i % 2 else "fr") for i in range(40)]
    rows += [(None, english, None), (100, None, "en"), (101, "12 34 !!", "en"), (102, "", "fr"), (103, english * 20000, None), (5, english, "en")]
    got = language.identify(frame(spark, rows, clash)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "en" and by[2].lang_pred == "fr" and by[None].lang_pred == "en"


def test_language_without_labels_or_rows(spark):
    assert [r.lang_pred for r in language.identify(frame(spark, [(1, "some text")])).collect()] == ["und"]
    assert language.identify(frame(spark, [])).count() == 0


def test_keep_known_keeps_columns_and_clean_documents(spark):
    docs = sf_documents(spark)
    kept = language.keep_known(docs)
    assert kept.schema == docs.schema
    assert kept.count() > 0.97 * docs.count()


def test_ftrl_zeroes_what_does_not_help():
    rng = np.random.default_rng(1)
    model = language.Ftrl(50, 2, l1=1.0)
    for _ in range(400):
        y = int(rng.integers(2))
        model.step(np.array([y, 2 + int(rng.integers(48)), 50]), np.array([1.0, 1.0, 1.0]), y)
    w = model.weights()
    assert (w[2:50] == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1]


def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@pytest.mark.parametrize("clash", [False, True])
def test_quality_statistics_against_brute_force(spark, clash):
    rng = random.Random(3)
    texts = odd_texts() + [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(200))) for _ in range(30)]
    texts += ["# a\n\n a\n a \n# a\n" * 5, "x y z x y z x", "\x0b\x0ca b\rc", " a b " * 3]
    rows = quality.quality(frame(spark, list(enumerate(texts)), clash)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in STATS) == brute_statistics(texts[r.doc_id]), texts[r.doc_id][:60]
        assert not (r.base_failed and r.kept)


def test_quality_query(spark):
    docs = {r.doc_id: r.text for r in sf_documents(spark, SF01).collect()}
    rows = queries.op8_quality(spark, SF01).collect()
    assert {r.doc_id: tuple(r[c] for c in STATS) for r in rows} == {d: brute_statistics(t) for d, t in docs.items()}
    passed = [r for r in rows if not r.base_failed]
    assert sum(r.kept for r in passed) > 0.7 * len(passed)
    assert all(r.kept for r in passed if not r.n_symbols and not r.n_dup_lines and not r.n_repeat_words)


def test_quality_finds_outliers_of_their_group(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(80, 300)), "en", "s") for i in range(300)]
    rows += [(1000 + i, text(100).replace(" ", " %% ## "), "en", "s") for i in range(30)]
    kept = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(30))


def test_quality_takes_cut_up_prose_and_leaves_repeated_lines(spark):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randrange(80, 300)), "en", "s") for i in range(300)]
    rows += [(1000 + i, text(rng.randrange(60, 200)).replace(" ", " | "), "en", "s") for i in range(20)]
    rows += [(2000 + i, "\n".join([text(60), line := text(9), line]), "en", "s") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality.quality(frame(spark, rows)).collect()}
    assert not any(kept[1000 + i] for i in range(20))
    assert all(kept[i] for i in range(300)) and all(kept[2000 + i] for i in range(20))


def test_chi2():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.95, 5), 5) - 0.95) < 1e-9
    assert abs(quality.chi2_quantile(0.95, 5) - 11.0705) < 1e-3


def weighted_jaccard(a, b):
    x, y = Counter(re.findall(r"[^\x20\x09-\x0D]+", a.lower())), Counter(re.findall(r"[^\x20\x09-\x0D]+", b.lower()))
    union = sum((x | y).values())
    return sum((x & y).values()) / union if union else 1.0


@pytest.mark.parametrize("clash", [False, True])
def test_fingerprints_of_edits(spark, clash):
    texts = [t for t in odd_texts() if len(t or "") < 20000]
    ids = random.Random(2).sample(range(10**6), len(texts))
    rows = fingerprints.fingerprint_edits(frame(spark, list(zip(ids, texts)), clash)).collect()
    assert len(rows) == len(texts)
    order = sorted(zip(ids, texts))
    following = {i: order[(k + 1) % len(order)][1] or "" for k, (i, _) in enumerate(order)}
    text = {i: t or "" for i, t in order}
    prints, errors = {}, []
    for r in rows:
        t, n = text[r.doc_id], len(text[r.doc_id])
        new = t[: n - n // 2] + following[r.doc_id][: n // 2]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(new.encode()).hexdigest())
        prints.setdefault(t, set()).add(r.fingerprint)
        errors.append(r.near_next - weighted_jaccard(t, following[r.doc_id]))
        errors.append(r.near_edited - weighted_jaccard(t, new))
    assert all(len(p) == 1 for p in prints.values())
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.25


def test_fingerprint_draws_follow_weighted_jaccard(spark):
    sampler = fingerprints.Sampler(4096)
    import pyarrow as pa

    a, b = "x " * 30 + "y " * 5 + "z z w v u", "x " * 10 + "y " * 9 + "z q r"
    one, two = sampler.signatures(pa.array([a, b]))
    assert abs((one == two).mean() - weighted_jaccard(a, b)) < 0.03


def test_fingerprints_null_ids_ties_and_empty(spark):
    rows = [(None, "a b c"), (3, "d e f g"), (3, "d e f g"), (3, "a"), (7, None)]
    got = fingerprints.fingerprint_edits(frame(spark, rows)).collect()
    order = ["a b c", "a", "d e f g", "d e f g", ""]  # null id first, equal ids by text
    want = Counter(hashlib.sha256((t[: len(t) - len(t) // 2] + order[(i + 1) % 5][: len(t) // 2]).encode()).hexdigest() for i, t in enumerate(order))
    assert Counter(r.edited_sha256 for r in got) == want
    assert fingerprints.fingerprint_edits(frame(spark, [])).count() == 0
    assert fingerprints.fingerprints(frame(spark, rows)).count() == 5
    only = fingerprints.fingerprint_edits(frame(spark, [(1, "one two")])).first()
    assert only.near_next == 1.0


def test_fingerprint_query(spark):
    docs = sorted((r.doc_id, r.text) for r in sf_documents(spark).collect())
    got = {r.doc_id: r for r in queries.op7_fingerprints(spark, SF).collect()}
    for k, (i, t) in enumerate(docs):
        new = t[: len(t) - len(t) // 2] + docs[(k + 1) % len(docs)][1][: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
