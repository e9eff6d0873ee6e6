from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from emberlog.llm import merkle, queries
from emberlog.runtime import materialize

from .helpers import DOC, SF, frame, odd_texts, sf_documents

COLUMNS = merkle.COLUMNS
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests, arity):
    """Root and, for each digest, its steps: (siblings before, siblings after)."""
    steps, place, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i, p in enumerate(place):
            run = level[p // arity * arity : p // arity * arity + arity]
            steps[i].append((run[: p % arity], run[p % arity + 1 :]))
            place[i] = p // arity
        level = [sha("".join(level[k : k + arity])) for k in range(0, len(level), arity)]
    return level[0], steps


def brute(rows, arity=16, every=5):
    by_source = {}
    for r in rows:
        by_source.setdefault(r["source"], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    lows = []
    for source in order:
        ranked = sorted(by_source[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        lows.append((ranked, *tree([leaf(r, r["text"]) for r in ranked], arity)))
    root, tops = tree([low[1] for low in lows], arity) if lows else (None, [])
    out = []
    for (ranked, subroot, steps), top in zip(lows, tops):
        for r, own in zip(ranked, steps):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % every == 0
            text = r["text"].translate(_LOWER) if hit and r["text"] is not None else r["text"]
            now = leaf(r, text)
            for before, after in own + top:
                now = sha("".join([*before, now, *after]))
            proof = sha("".join(x for before, after in own + top for x in before + after))
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def told(result):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert result.columns == names
    return sorted((tuple(r[n] for n in names) for r in result.collect()), key=str)


@pytest.mark.parametrize("arity,clash", [(2, True), (3, False), (16, False)])
def test_trees_against_brute_force(spark, arity, clash):
    """Sources of one to many rows, null sources and ids, repeated rows and ids, null and empty texts."""
    texts = odd_texts()
    rows = [(i, t, "en" if i % 3 else None, [None, "src", "Src", "ü", "z"][min(i % 11, 4)]) for i, t in enumerate(texts)]
    rows += [(5, "A", "x", "one"), (7, "B", "x", "src"), (7, "B", "x", "src"), (7, "C", "x", "src"), (None, "D", "x", "z"), (None, None, None, None)]
    docs = frame(spark, rows, clash)
    want = brute([dict(zip(DOC_NAMES, (r + (len(r[1]) if r[1] is not None else None,)))) for r in rows], arity)
    assert told(merkle.tamper_report(docs, arity=arity)) == want
    assert len({r[6] for r in want}) == 2


DOC_NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def test_query_against_brute_force(spark):
    want = brute([r.asDict() for r in sf_documents(spark).collect()])
    assert told(queries.op12_merkle_manifest(spark, SF)) == want


def test_empty_and_single_tables(spark):
    assert merkle.tamper_report(spark.createDataFrame([], DOC)).collect() == []
    assert merkle.manifest(spark.createDataFrame([], DOC)).root is None
    one = merkle.tamper_report(frame(spark, [(1, "Text")])).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == sha("")


def test_many_sources(spark):
    """As many trees as rows: the tree of subroots has several levels, too."""
    rows = [(i, f"text {i}", "en", f"s{i}") for i in range(600)]
    want = brute([dict(zip(DOC_NAMES, r + (len(r[1]),))) for r in rows])
    assert told(merkle.tamper_report(frame(spark, rows))) == want


def test_stored_manifest_tells_changes(spark, tmp_path):
    rows = [(i, f"text {i}", "en", f"s{i % 3}") for i in range(100)]
    made = merkle.manifest(frame(spark, rows), arity=2)
    path = str(tmp_path / "manifest")
    merkle.write_manifest(made, path)
    now = frame(spark, [r if r[0] != 5 else (5, "other", "en", "s2") for r in rows if r[0] != 9] + [(200, "new", "en", "s1")])
    state = {r.doc_id: r.state for r in merkle.verify_manifest(spark, path, now).collect()}
    assert {d: s for d, s in state.items() if s != "same"} == {5: "changed", 9: "missing", 200: "new"} and len(state) == 101
    nodes = spark.read.parquet(f"{path}/nodes")
    assert nodes.where((F.length("run") > 64) | (F.lower(F.sha2(F.lower(F.hex("run")), 256)) != F.col("digest"))).count() == 0


def test_a_hot_source_is_spread(spark):
    """Places inside a source come from a range sort of all rows, not from a window over the source."""
    rows = frame(spark, [(i, "x", "en", "hot") for i in range(20_000)]).repartition(8)
    keyed = rows.select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("digest"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    plan = merkle.with_position(materialize(keyed), [F.col("source"), F.col("doc_id")], "at")
    sizes = [r.n for r in plan.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert plan.where("doc_id != at").count() == 0 and max(sizes) < 10_000
