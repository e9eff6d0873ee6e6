"""Merkle manifests of datasets: a tree of digests per source, levels built by sibling self-joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.runtime import lookup_join, materialize

from .common import pick, with_position

ARITY = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<run:binary,slot:int>>"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and the value, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hex(binary: Column | str) -> Column:
    return F.lower(F.hex(binary))


def grow(nodes: DataFrame, arity: int) -> DataFrame:
    """Parents of all nodes (tree, at, left, digest) of trees that still have several, with the ``run`` they cover.

    ``at`` is a node's place in its tree's level and ``left`` the level's size. Nodes find their siblings by an
    equijoin on computed places, and the node in slot zero gives the parent row.
    """
    live = nodes.where("left > 1").select("tree", "at", "left", "digest")
    sibling = live.select("tree", F.col("at").alias("_at"), F.col("digest").alias("_digest"))
    up = [(F.col("at") / arity).cast("bigint").alias("at"), F.ceil(F.col("left") / arity).alias("left")]
    if arity == 2:
        pairs = live.withColumn("_at", F.col("at").bitwiseXOR(F.lit(1).cast("bigint"))).join(sibling, ["tree", "_at"], "left")
        whole = pairs.where("at % 2 = 0").select("tree", *up, F.concat("digest", F.coalesce("_digest", F.lit(b""))).alias("run"))
    else:
        offsets = F.expr(f"sequence(0, cast(least({arity - 1}, left - 1 - at) as int))")
        heads = live.where(F.col("at") % arity == 0).select("tree", "at", "left", F.explode(offsets).alias("slot"))
        met = heads.withColumn("_at", F.col("at") + F.col("slot")).join(sibling, ["tree", "_at"])
        runs = met.groupBy("tree", "at", "left").agg(F.array_sort(F.collect_list(F.struct("slot", "_digest"))).alias("_run"))
        joined = F.aggregate("_run", F.lit(b""), lambda a, x: F.concat(a, x["_digest"]))
        whole = runs.select("tree", *up, joined.alias("run"))
    return whole.withColumn("digest", F.unhex(F.sha2(_hex("run"), 256)))


def levels(leaves: DataFrame, largest: int, arity: int) -> list[DataFrame]:
    """Stored levels from the leaves up, until the largest tree has one node."""
    out = [leaves]
    while largest > 1:
        out.append(materialize(grow(out[-1], arity)))
        largest = -(-largest // arity)
    return out


def tops(built: list[DataFrame]) -> DataFrame:
    """(tree, digest): the node that remains of each tree."""
    rows = [level.where("left = 1").select("tree", "digest") for level in built]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out


def paths(built: list[DataFrame], arity: int, above: DataFrame) -> DataFrame:
    """The leaves with what ``above`` (tree, path, ...) knows of their tree and ``path``: runs and slots up to the root.

    Paths are handed down level by level, so leaves of one run share one stored path.
    """
    extra = [c for c in above.columns if c not in ("tree", "path")]
    down = None
    for k in range(len(built) - 1, -1, -1):
        level = built[k]
        mine = level.where("left = 1").join(above, "tree")
        if down is not None:
            step = F.array(F.struct(F.col("_run").alias("run"), (F.col("at") % arity).cast("int").alias("slot")))
            parents = down.select("tree", F.col("at").alias("_up"), F.col("run").alias("_run"), F.col("path").alias("_path"), *extra)
            rows = level.where("left > 1").withColumn("_up", (F.col("at") / arity).cast("bigint")).join(parents, ["tree", "_up"])
            rows = rows.withColumn("path", F.concat(step, "_path")).drop("_up", "_run", "_path")
            mine = mine.unionByName(rows)
        down = materialize(mine) if k else mine
    return down


def fold(path: Column | str, digest: Column) -> Column:
    """Root that follows from a leaf's digest (hex) and the siblings on its path."""
    place = lambda run, slot, own: F.overlay(_hex(run), own, slot * 64 + 1, F.lit(64))
    return F.aggregate(path, digest, lambda own, s: F.sha2(place(s["run"], s["slot"], own), 256))


def siblings(path: Column | str) -> Column:
    """Hex digests of all siblings on a path, from the leaf's level up, left to right."""
    rest = F.transform(path, lambda s: F.overlay(_hex(s["run"]), F.lit(""), s["slot"] * 64 + 1, F.lit(64)))
    return F.array_join(rest, "")


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with ``leaf``, ``subroot`` (hex) and ``path``; ``nodes``: (source, level, at, digest, run)
    of all inner nodes of the sources' trees; ``root``: hex, None for an empty table.
    """

    leaves: DataFrame
    nodes: DataFrame
    root: str | None


def build(rows: DataFrame, arity: int = ARITY) -> Manifest:
    """Manifest of rows (doc_id, source, digest, ...), where ``digest`` is the binary digest of the row.

    Leaves of a source ascend by id, ties by digest; sources ascend bytewise, null first. The place of a row comes
    from one range sort over source and id, so a source with most of the rows is spread over many tasks.
    """
    if arity < 2:
        raise ValueError("a run needs at least two places")
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    keyed = rows.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    placed = with_position(keyed, order, "_rank")
    trees = materialize(placed.groupBy("_key").agg(F.min("_rank").alias("tree"), F.count(F.lit(1)).alias("left"), F.first("source").alias("_source")))
    leaves = materialize(
        lookup_join(placed, trees.select("_key", "tree", "left"), "_key", "inner", F.col("_rank"))
        .withColumn("at", F.col("_rank") - F.col("tree"))
        .drop("_key", "_rank")
    )
    own = levels(leaves, trees.agg(F.max("left")).first()[0] or 0, arity)
    heads = materialize(tops(own))
    n = heads.count()
    ranked = with_position(heads, [F.col("tree")], "at")
    top_leaves = materialize(
        ranked.select(F.lit(0).cast("bigint").alias("tree"), "at", F.lit(n).cast("bigint").alias("left"), "digest", F.col("tree").alias("_tree"))
    )
    upper = levels(top_leaves, n, arity)
    last = tops(upper).first()
    start = top_leaves.sparkSession.createDataFrame([(0, [])], f"tree bigint, path {_STEPS}")
    known = paths(upper, arity, start).select(F.col("_tree").alias("tree"), _hex("digest").alias("subroot"), "path")
    found = paths(own, arity, materialize(known)).withColumn("leaf", _hex("digest")).drop("tree", "at", "left", "digest")
    inner = [level.select("tree", F.lit(k + 1).alias("level"), "at", _hex("digest").alias("digest"), "run") for k, level in enumerate(own[1:])]
    nodes = leaves.select("tree", F.lit(0).alias("level"), "at", _hex("digest").alias("digest"), F.lit(None).cast("binary").alias("run")).limit(0)
    for more in inner:
        nodes = nodes.union(more)
    sources = trees.select("tree", F.col("_source").alias("source"))
    return Manifest(found, lookup_join(nodes, sources, "tree", "inner").drop("tree"), last and last.digest.hex())


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, arity: int = ARITY, id_col: str = "doc_id", source_col: str = "source") -> Manifest:
    """Merkle manifest of a table over the named columns.

    ``leaves`` has one row per document: id, source, ``leaf``, ``subroot`` and ``path``, which proves the row. Nulls
    in any column, also in id and source, have a digest of their own. Repeated rows are leaves each. An empty
    table has no rows and no root. Columns that are not named do not count, whatever they are called.
    """
    picked = pick(docs, id_col, source_col, *columns).toDF("doc_id", "source", *[f"_v{i}" for i in range(len(columns))])
    values = [F.col(f"_v{i}") for i in range(len(columns))]
    return build(picked.select("doc_id", "source", F.unhex(leaf_digest(values)).alias("digest")), arity)


def write_manifest(made: Manifest, path: str) -> None:
    """Store a manifest: proofs, inner nodes, and the root as one row."""
    spark = made.leaves.sparkSession
    made.leaves.write.parquet(f"{path}/proofs")
    made.nodes.write.parquet(f"{path}/nodes")
    spark.createDataFrame([(made.root,)], "root string").write.parquet(f"{path}/root")


def verify_manifest(spark: SparkSession, path: str, docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, state) of a table against a stored manifest: ``same``, ``changed``, ``missing`` or ``new``.

    Each row is folded with its stored proof. An id needs to be unique and not null here.
    """
    root = spark.read.parquet(f"{path}/root").first().root
    proofs = spark.read.parquet(f"{path}/proofs").select("doc_id", "path")
    values = [F.col(f"_v{i}") for i in range(len(columns))]
    picked = pick(docs, id_col, *columns).toDF("doc_id", *[f"_v{i}" for i in range(len(columns))])
    now = picked.select("doc_id", leaf_digest(values).alias("_now"))
    both = proofs.join(now, "doc_id", "full")
    state = (
        F.when(F.col("_now").isNull(), "missing")
        .when(F.col("path").isNull(), "new")
        .when(fold("path", F.col("_now")) == F.lit(root), "same")
        .otherwise("changed")
    )
    return both.select("doc_id", state.alias("state"))


def tamper_report(docs: DataFrame, every: int = 5, arity: int = ARITY) -> DataFrame:
    """One row per document: its leaf, subroot, root and proof, and the root folded from a tampered copy.

    The copy of every document whose id's checksum is a multiple of ``every`` has its capital letters A-Z
    lowered; all others are unchanged, as are null texts and rows without an id. ``verified`` tells whether the
    folded root is the root.
    """
    rows = pick(docs, *COLUMNS)
    values = [F.col(c) for c in COLUMNS]
    capital = "".join(map(chr, range(65, 91)))
    lowered = [F.translate(c, capital, capital.lower()) if name == "text" else c for name, c in zip(COLUMNS, values)]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    claimed = F.when(hit, F.unhex(leaf_digest(lowered)))
    made = build(rows.select("doc_id", "source", F.unhex(leaf_digest(values)).alias("digest"), claimed.alias("claimed")), arity)
    root = F.lit(made.root)
    folded = fold("path", F.coalesce(_hex("claimed"), F.col("leaf")))
    told = made.leaves.select("doc_id", "leaf", "subroot", root.cast("string").alias("root"), F.sha2(siblings("path"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
