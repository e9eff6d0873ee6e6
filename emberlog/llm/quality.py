"""Quality rules: text statistics, and robust multivariate outliers among them. Columns only, no Python on rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.runtime import broadcast_if_small, materialize

from .common import pick

# White space and symbols of the word and symbol counts.
SPACES = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
NOT_SYMBOL = r"[^#*$%&|<>]+"
LEAST_WORDS = 50

#: Transformed statistics, and the least standard deviation that an estimate may have in each of them: wide where
#: clean documents differ much (length, a repeated line in a short text), narrow where junk stands out (symbols).
VECTOR = {"v_length": 1.2, "v_word": 0.06, "v_symbols": 0.1, "v_lines": 0.2, "v_repeats": 0.2}
SUBSET = 0.75
STEPS = 4
LEAST_GROUP = 100
#: A usual cut; the floors of VECTOR keep clean documents within it.
TAIL = 1e-3


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    a, h = k / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = 1
    while term > total * 1e-16:
        term *= h / (a + n)
        total += term
        n += 1
    return total * math.exp(-h + a * math.log(h) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if chi2_cdf(x, k) < p else (low, x)
    return (low + high) / 2


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *keep: str) -> DataFrame:
    """Base statistics of each whole text; one scan, no shuffle.

    Three-word windows are compared by 64-bit hashes within their text. Texts without a repeated window, found
    by a distinct count, skip the positions.
    """
    rows = pick(docs, id_col, text_col, *keep).withColumnRenamed(id_col, "doc_id")
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    first = rows.select(
        "doc_id",
        *keep,
        hashes.alias("_words"),
        (F.length(F.regexp_replace(text, SPACES, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("_distinct_lines"),
    )
    h = F.col("_words")
    ahead = lambda k: F.slice(h, F.lit(k + 1), F.greatest(F.size(h) - 2, F.lit(0)))
    windows = F.zip_with(F.zip_with(ahead(0), ahead(1), lambda a, b: F.xxhash64(a, b)), ahead(2), lambda a, b: F.xxhash64(a, b))
    second = first.select("*", windows.alias("_windows"))
    w = F.col("_windows")
    # Positions of repeated windows: sort (hash, position), keep those with an equal neighbour, then cover 3 words each.
    ordered = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    shift = lambda a, first: F.concat(F.array(first), F.slice(a, 1, F.size(a) - 1))
    third = second.select(
        "*",
        F.when(F.size(F.array_distinct(w)) < F.size(w), ordered).alias("_ordered"),
    )
    o = F.col("_ordered")
    none = F.lit(None).cast("struct<h:bigint,i:int>")
    before = shift(o, none)
    after = F.concat(F.slice(o, 2, F.size(o)), F.array(none))
    marked = F.zip_with(
        F.zip_with(o, before, lambda a, b: F.struct(a.alias("x"), a["h"].eqNullSafe(b["h"]).alias("same"))),
        after,
        lambda a, b: F.when(a["same"] | a["x"]["h"].eqNullSafe(b["h"]), a["x"]["i"]),
    )
    places = F.array_sort(F.filter(marked, lambda i: i.isNotNull()))
    fourth = third.select("*", F.when(o.isNotNull(), places).alias("_places"))
    p = F.col("_places")
    gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeats = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long")
    return fourth.select(
        "doc_id",
        *keep,
        F.size(h).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("_distinct_lines")).alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        "n_lines",
    )


def failed_base() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector(stats: DataFrame) -> DataFrame:
    """Statistics on scales where ordinary documents are roughly normal; shares by square root, sizes by logarithm."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    made = {
        "v_length": F.log(n),
        "v_word": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "v_symbols": F.sqrt(F.col("n_symbols") / n),
        "v_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "v_repeats": F.sqrt(F.col("n_repeat_words") / n),
    }
    return stats.select("*", *[c.alias(k) for k, c in made.items()])


NAMES = list(VECTOR)
PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i + 1)]


def _estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, covariance (with floors on the diagonal) and size of each group; sums are combined before the shuffle."""
    x = [F.col(n) for n in NAMES]
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)],
        *[F.covar_pop(x[i], x[j]).alias(f"c{i}{j}") for i, j in PAIRS],
    )
    floors = list(VECTOR.values())
    return sums.select(
        *keys,
        "n",
        *[F.col(f"m{i}") for i in range(len(x))],
        *[(F.greatest(F.col(f"c{i}{j}"), F.lit(floors[i] ** 2)) if i == j else F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i, j in PAIRS],
    )


def _factors(estimates: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l and the logarithm of the determinant; computed once a group, stored as columns."""
    out = estimates
    for i, j in PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        value = F.sqrt(F.greatest(rest, F.lit((0.3 * list(VECTOR.values())[i]) ** 2))) if i == j else rest / F.col(f"l{j}{j}")
        out = out.withColumn(f"l{i}{j}", value)
    logs = [F.log(F.col(f"l{i}{i}")) for i in range(len(NAMES))]
    return out.withColumn("log_det", 2 * sum(logs[1:], logs[0]))


def _solve(rows: DataFrame) -> DataFrame:
    """Adds d2, the squared distance by the group's m and l columns: one forward substitution."""
    out = rows
    for i, name in enumerate(NAMES):
        z = F.col(name) - F.col(f"m{i}")
        for k in range(i):
            z = z - F.col(f"l{i}{k}") * F.col(f"_z{k}")
        out = out.withColumn(f"_z{i}", z / F.col(f"l{i}{i}"))
    squares = [F.col(f"_z{i}") * F.col(f"_z{i}") for i in range(len(NAMES))]
    return out.withColumn("d2", sum(squares[1:], squares[0]))


MODEL = ["log_det", *[f"m{i}" for i in range(len(NAMES))], *[f"l{i}{j}" for i, j in PAIRS]]


def robust_estimates(points: DataFrame, subset: float = SUBSET, steps: int = STEPS) -> DataFrame:
    """Minimum-covariance-determinant location and scatter of every group, as one row a group.

    ``points`` has the columns lang, source and those of VECTOR. Groups are (lang, source), lang over all sources,
    and all rows, told by ``level`` 0 to 2. Two starts are refined: medians with interquartile ranges, and means
    with the full covariance. Each concentration step keeps the share ``subset`` of a group's rows with the least
    distances and estimates anew; the start with the smaller determinant wins. A row counts in three groups;
    sums, sketches of quantiles and counts are combined before each shuffle, so a hot group is never gathered.
    """
    groups = F.array(
        *[
            F.struct(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
            for level, lang, source in (
                (0, F.col("lang"), F.col("source")),
                (1, F.col("lang"), F.lit(None).cast("string")),
                (2, F.lit(None).cast("string"), F.lit(None).cast("string")),
            )
        ]
    )
    own = ["level", "g_lang", "g_source"]
    leveled = points.select(*NAMES, F.explode(groups).alias("_g")).select(*NAMES, "_g.*")
    quartiles = leveled.groupBy(*own).agg(
        F.count(F.lit(1)).alias("n"), *[F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i, c in enumerate(NAMES)]
    )
    floors = list(VECTOR.values())
    diagonal = quartiles.select(
        *own,
        F.lit(0).alias("start"),
        "n",
        *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(len(NAMES))],
        *[
            (F.greatest(((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2, F.lit(floors[i] ** 2)) if i == j else F.lit(0.0)).alias(f"c{i}{j}")
            for i, j in PAIRS
        ],
    )
    classic = _estimates(leveled, own).withColumn("start", F.lit(1))
    model = materialize(_factors(diagonal.unionByName(classic)).select(*own, "start", "n", *MODEL))
    both = leveled.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    keys = [*own, "start"]
    for _ in range(steps):
        measured = _solve(_with_model(both, model, keys)).select(*keys, *NAMES, "d2")
        bounds = measured.groupBy(*keys).agg(F.percentile_approx("d2", subset, 2000).alias("most"))
        bounds = materialize(bounds)
        inner = _with_bound(measured, bounds, keys).where(F.col("d2") <= F.col("most"))
        model = materialize(_factors(_estimates(inner, keys)).select(*keys, "n", *MODEL))
    best = model.groupBy(*own).agg(F.min_by(F.struct(*MODEL), F.struct("log_det", "start")).alias("_m"))
    sizes = quartiles.select(*own, "n")
    return materialize(_null_safe(best, sizes, own).select(*own, "n", "_m.*"))


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on keys that may be null; the right side's keys go."""
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return left.join(renamed, on).drop(*[f"_k_{k}" for k in keys])


def _with_model(rows: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    return _null_safe(rows, broadcast_if_small(model.select(*keys, *MODEL), 20_000), keys)


def _with_bound(rows: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    return _null_safe(rows, broadcast_if_small(bounds, 20_000), keys)


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    tail: float = TAIL,
    least_group: int = LEAST_GROUP,
) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, ``distance``, ``kept``.

    Documents that pass the base rules are measured against the robust estimate of their language and source, or,
    where that group has fewer than ``least_group`` such documents, of their language, or of all. A document goes
    if its squared distance exceeds the chi-squared quantile of 1 - ``tail``, after the scatter is corrected for
    the subset it was estimated on.

    Null and empty texts have no words and fail the base rules. Null language or source is a value of its own.
    Repeated rows each get a row. An empty table gives an empty result. Extra columns are ignored.
    """
    rows = pick(docs, id_col, text_col, lang_col, source_col).toDF("doc_id", "text", "lang", "source")
    stats = text_statistics(rows, "doc_id", "text", "lang", "source").withColumn("base_failed", failed_base())
    points = materialize(vector(stats))
    model = robust_estimates(points.where(~F.col("base_failed")).select("lang", "source", *NAMES))
    p = len(NAMES)
    factor = SUBSET / chi2_cdf(chi2_quantile(SUBSET, p), p + 2)
    cutoff = chi2_quantile(1 - tail, p)
    usable = model.where((F.col("n") >= least_group) | (F.col("level") == 2))
    fields = F.struct(*MODEL)
    fine = usable.where("level = 0").select("g_lang", "g_source", fields.alias("_m0"))
    middle = usable.where("level = 1").select("g_lang", fields.alias("_m1"))
    coarse = usable.where("level = 2").select(fields.alias("_m2"))
    found = points
    for side, on in (
        (fine, [("lang", "g_lang"), ("source", "g_source")]),
        (middle, [("lang", "g_lang")]),
    ):
        side = broadcast_if_small(side, 20_000)
        found = found.join(side, [F.col(a).eqNullSafe(side[b]) for a, b in on], "left").drop("g_lang", "g_source")
    found = found.join(F.broadcast(coarse), F.lit(True), "left")  # one row
    chosen = F.coalesce("_m0", "_m1", "_m2")
    measured = _solve(found.withColumn("_m", chosen).select(*points.columns, "_m.*"))
    d2 = F.when(~F.col("base_failed"), F.col("d2") / F.lit(factor))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return measured.select(*names, d2.alias("distance"), (~F.col("base_failed") & F.coalesce(d2 <= F.lit(cutoff), F.lit(True))).alias("kept"))
