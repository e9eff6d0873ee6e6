from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from emberlog.llm import clusters, line_dedup, queries

from .helpers import SF, frame, odd_texts, sf_documents
from .test_ngram_join import edits, thue_morse


def words(line):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return frozenset(re.findall(r"[^\x20\x09-\x0D]+", lower))


def brute(rows, num=80, den=100, least=1):
    """{id: (lines, removed)} by comparing each line with all lines at earlier places."""
    lines, out = [], {}
    for d, text in rows:
        parts = (text or "").split("\n") if text else []
        out[d] = (len(parts), [])
        lines += [(d is not None, d or 0, i, words(p)) for i, p in enumerate(parts) if len(words(p)) >= least]
    lines.sort(key=lambda x: x[:3])
    seen: dict[frozenset, tuple] = {}
    for known, d, i, s in lines:
        here, hit = (known, d, i), False
        for other, place in seen.items():
            n = len(s & other)
            if place < here and den * n >= num * (len(s) + len(other) - n):
                hit = True
                break
        seen.setdefault(s, here)
        if hit and i not in out[d if known else None][1]:
            out[d if known else None][1].append(i)
    return {d: (n, sorted(r)) for d, (n, r) in out.items()}


def documents(rng, n=60):
    families = edits(rng, 10, 12)
    junk = ["", " ", "a b", "of the", "Of The", "one line that everyone has got here", "ONE line that everyone has got here"]
    return ["\n".join(rng.choice(families + junk) for _ in range(rng.randrange(0, 9))) for _ in range(n)]


@pytest.mark.parametrize("num,hot", [(80, 1 << 15), (60, 8)])
def test_against_all_pairs(spark, monkeypatch, num, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(num)
    texts = documents(rng) + [t for t in odd_texts() if len(t or "") < 9000]
    rows = list(zip(rng.sample(range(-(10**6), 10**6), len(texts)), texts))
    got = line_dedup.repeated_lines(frame(spark, rows, num == 60), num).collect()
    assert {r.doc_id: (r.n_lines, r.removed) for r in got} == brute(rows, num)
    assert all(r.n_removed == len(r.removed) for r in got)


@pytest.mark.parametrize("num,den", [(80, 100), (1, 1)])
def test_short_lines_against_all_pairs(spark, num, den):
    rng = random.Random(7)
    short = ["a", "A", "of the", "the of the", "a b c d", "a b c d e", "a b c d f", "x y z", "x y", "--- ---", " ", ""]
    rows = [(i, "\n".join(rng.choice(short) for _ in range(rng.randrange(1, 6)))) for i in range(12)]
    got = line_dedup.repeated_lines(frame(spark, rows), num, den, least_words=1).collect()
    assert {r.doc_id: (r.n_lines, r.removed) for r in got} == brute(rows, num, den, 1)


def test_pipeline_and_query_remove_short_repeats(spark, tmp_path):
    docs = frame(spark, [(1, "short line\nown words of one"), (2, "short line\nother words of two"), (3, "Short line")])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_line_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.removed for r in got} == {1: [], 2: [0], 3: [0]}
    kept = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: r.text for r in kept} == {1: "short line\nown words of one", 2: "other words of two"}


def test_rows_without_an_id_and_with_one_id(spark):
    """Each row is judged by itself; of identical rows one stays."""
    one, two, three = "first words stand here alone\nsame line for everyone here", "second text\nother words of two here now", "same line for everyone here\nwords only three has got"
    rows = [(None, one), (None, two), (None, three), (5, "of five"), (5, "another of id five"), (6, "twice the same"), (6, "twice the same")]
    kept = sorted(r.text for r in line_dedup.drop_repeated_lines(frame(spark, rows), least_words=1).collect())
    # One of the two null rows that share a line loses it, whichever comes first by hash.
    either = [[one, "words only three has got"], ["first words stand here alone", three]]
    rest = [two, "of five", "another of id five", "twice the same"]
    assert kept in [sorted(x + rest) for x in either]
    got = line_dedup.repeated_lines(frame(spark, rows), least_words=1).collect()
    assert sorted(r.removed for r in got if r.doc_id == 6) == [[], [0]]
    assert sum(r.n_removed for r in got) == 2


def test_split_clusters(spark, monkeypatch):
    monkeypatch.setattr(clusters, "MEMBERS", 6)
    rng = random.Random(5)
    rows = list(enumerate(documents(rng, 80)))
    got = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.removed) for r in got} == brute(rows)


def test_null_ids_repeated_rows_and_empty(spark):
    text = "a line of six plain words\nx\n\nA LINE of six plain words"
    rows = [(7, text), (7, text), (None, "a line of six plain words"), (3, None), (2, "")]
    got = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert len(got) == 5
    assert {r.doc_id: (r.n_lines, r.removed) for r in got if r.doc_id != 7} == {d: x for d, x in brute(rows).items() if d != 7}
    assert sorted(r.removed for r in got if r.doc_id == 7) == [[0, 1, 3], [0, 3]]  # the second of the rows loses every line with a word
    assert line_dedup.repeated_lines(frame(spark, [])).count() == 0


def test_texts_without_repeated_lines(spark):
    shared = "this line is shared by many documents"
    rows = [(1, f"{shared}\nfirst own line"), (2, f"second own line\n{shared}\n"), (3, shared), (4, "alone"), (5, None), (6, f" \n{shared} \n")]
    docs = frame(spark, rows, True)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    assert {r[0]: (r[1], r[4]) for r in kept.collect()} == {
        1: (rows[0][1], len(rows[0][1])),
        2: ("second own line\n", 16),
        4: ("alone", 5),
        5: (None, None),
    }


def test_words_that_cancel_out_in_polynomials(spark):
    """Thue-Morse words and their complements: no two of these lines have a word in common."""
    for n in (1024, 4096):
        word, other = thue_morse(n)
        rows = [(1, word), (2, other), (3, f"{word} x"), (4, f"{other} x")]
        assert all(r.removed == [] for r in line_dedup.repeated_lines(frame(spark, rows)).collect())
        assert corpus_pipeline.dedup_lines(spark, frame(spark, rows), SF).count() == 4


def test_one_line_in_every_slice(spark, monkeypatch):
    """Copies of a line from many slices are one row when lines are compared."""
    monkeypatch.setattr(line_dedup, "SLICE", 200)
    rng = random.Random(4)
    same = "seven plain words that all documents share"
    rows = [(i, f"{same}\n" + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12))) for i in range(400)]
    got = line_dedup.repeated_lines(frame(spark, rows)).collect()
    assert {r.doc_id: r.removed for r in got} == {i: [0] if i else [] for i in range(400)}
    keys = np.repeat(np.arange(3), 400)
    batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(1200, 9)), *[pa.array(np.zeros(1200, np.int64))] * 3], list("abcde"))
    left = line_dedup.without_copies(next(line_dedup.runs_of_keys(iter([batch]))))
    assert [c.tolist() for c in left[:2]] == [[0, 1, 2], [9, 9, 9]]


def test_star_edges():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    a, b = line_dedup.star_edges(u, v)
    forest, other = clusters.Forest(500), clusters.Forest(500)
    for x, y in zip(u, v):
        forest.link(int(x), int(y))
    for x, y in zip(a, b):
        other.link(int(x), int(y))
    assert [forest.root(i) for i in range(500)] == [other.root(i) for i in range(500)]


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in sf_documents(spark).collect()]
    got = queries.op10_line_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_lines, r.removed) for r in got} == brute(rows)


def test_only_pairs_with_room_behind_the_shared_token_are_candidates(spark):
    def row(token, size, position, node):
        return (token << 32) | (size << 16) | position, node, 0, 0

    wide = line_dedup.WIDE
    rows = [row(1, 20, 0, 1), row(1, 20, 1, 2), row(2, 20, 3, 3), row(2, 20, 3, 4), row(3, wide, wide, 5), row(3, wide, wide, 6)]
    frame = spark.createDataFrame(rows, "key bigint, node bigint, low bigint, high bigint")
    edges = {frozenset(r) for r in line_dedup.candidate_edges(frame, 80, 100).collect()}
    assert edges == {frozenset({1, 2}), frozenset({5, 6})}


def test_only_wanted_lines_are_read_again():
    texts = pa.array(["a b\nc\n\nd e f", "", None, "\n", "x\n", "last", "q\nr\n"])
    wanted = pa.array([[0, 3], [], [], [], [0], [0], [1]], pa.list_(pa.int32()))
    assert line_dedup.chosen_lines(texts, wanted).to_pylist() == ["a b\n", "d e f", "x\n", "last", "r\n"]
    whole, part = line_dedup.read_lines(texts, 1), line_dedup.read_lines(line_dedup.chosen_lines(texts, wanted), 1)
    kept = [k for k, (d, n) in enumerate(zip(whole.doc, whole.number)) if n in wanted[int(d)].as_py()]
    assert whole.node[kept].tolist() == part.node.tolist()
