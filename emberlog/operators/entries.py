"""LINES -> ENTRIES and the filters on both."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..formats import DEFAULT_REGISTRY, FormatRegistry
from ..formats.base import Line, pick_stamp
from ..functions.levels import level_rank
from ..functions.text import is_blank
from ..functions.times import stamp_instant, stamp_wall_clock
from ..functions.variants import member, parse_json
from ..runtime import broadcast_if_small, lookup_join, materialize, settle
from ..schema import ENTRIES, ENTRY_FIELDS, FALLBACK_FORMAT, LEVELS


def drop_blank(df: DataFrame) -> DataFrame:
    return df.where(~is_blank(F.col("raw")))


def attach_format(lines: DataFrame, formats: DataFrame, fallback: str = FALLBACK_FORMAT) -> DataFrame:
    """Give every line the format of its source; lines of a source that is not listed get ``fallback``.

    ``formats`` holds one row per source. Spellings of the same local path (``file:/``, ``file:///``) are equal.
    """
    side = formats.select(_path_key("source_path").alias("_source"), F.col("format").alias("_found"))
    salt = F.xxhash64("raw") if "line_id" not in lines.columns else F.col("line_id")
    joined = lookup_join(lines.withColumn("_source", _path_key("source_path")), side, "_source", "left", salt)
    return joined.withColumn("format", F.coalesce("_found", F.lit(fallback))).drop("_source", "_found")


def _path_key(name: str) -> Column:
    return F.regexp_replace(F.col(name), "^file:/+", "file:/")


def _per_format(names: list[str], make: Callable[[str], Column]) -> Column:
    """One expression per format, chosen by the column ``format``; only the chosen one is evaluated."""
    if len(names) == 1:
        return make(names[0])
    chain = F.when(F.col("format") == names[0], make(names[0]))
    for name in names[1:]:
        chain = chain.when(F.col("format") == name, make(name))
    return chain


def parse_marked(lines: DataFrame, names: list[str], registry: FormatRegistry = DEFAULT_REGISTRY) -> DataFrame:
    """Parse lines that already carry ``format``, in one pass over them.

    ``names`` lists the formats that occur; the plan holds expressions for those only. Step by step the
    line is cut into groups, read as JSON, and mapped to fields, so each costly step runs once per line.
    """
    raw = F.col("raw")
    formats = {name: registry.get(name) for name in names}
    stored: dict[str, dict[str, Column]] = {name: {} for name in names}
    staged = lines

    def line(name: str) -> Line:
        return Line(formats[name], raw, **stored[name])

    def store(frame: DataFrame, piece: str, made: dict[str, Column], kind: str, step: int = 0) -> DataFrame:
        """Compute one piece for the formats that have it and let later steps refer to the column."""
        column = f"_{piece}_{step}"
        for name in made:
            stored[name][piece] = F.col(column)
        none = F.lit(None).cast(kind)
        return frame.withColumn(column, _per_format(names, lambda n: made.get(n, none)))

    if any(f.trims for f in formats.values()):
        staged = store(staged, "text", {n: f.text_of(raw) for n, f in formats.items()}, "string")
    if any(f.shapes for f in formats.values()):
        made = {n: f.groups_of(line(n).text) for n, f in formats.items() if f.shapes}
        staged = store(staged, "groups", made, "array<string>")
    if any(f.openers for f in formats.values()):
        made = {n: f.doc_of(line(n).text) for n, f in formats.items() if f.openers}
        staged = store(staged, "doc", made, "variant")
    cells = {n: f.cells_of(line(n)) for n, f in formats.items()}
    for i in range(max(len(found) for found in cells.values())):
        made = {n: found[i] for n, found in cells.items() if i < len(found)}
        staged = store(staged, f"cell_{i}", made, "variant")
    for step in range(max(len(f.steps) for f in formats.values())):
        words = {n: f.words_of(line(n), step) for n, f in formats.items()}
        for word in sorted({w for made in words.values() for w in made}):
            made = {n: found[word] for n, found in words.items() if word in found}
            staged = store(staged, f"word_{word}", made, "string", step)
    ready = {name: line(name) for name in names}
    columns = {name: formats[name].columns(ready[name]) for name in names}

    def field(key: str, default: Column | None = None) -> Column:
        return F.when(F.col("parsed"), _per_format(names, lambda n: columns[n][key])).otherwise(default)

    parsed = F.coalesce(_per_format(names, lambda n: formats[n].parsed(ready[n])), F.lit(False))
    staged = staged.withColumn("parsed", parsed & ~is_blank(raw)).withColumn("level", field("level", F.lit("INFO")))
    staged = settle(staged, "parsed", "level")
    stamps = {n: f.stamps_of(ready[n]) for n, f in formats.items()}
    candidates = max(len(found) for found in stamps.values())
    for i in range(candidates):
        made = {n: found[i] for n, found in stamps.items() if i < len(found)}
        staged = store(staged, f"stamp_{i}", made, "string")
    staged = staged.withColumn("_stamp", pick_stamp([F.col(f"_stamp_{i}_0") for i in range(candidates)]))
    ok, stamp = F.col("parsed"), F.col("_stamp")
    fields = {
        "event_ts": F.when(ok, stamp_instant(stamp)),
        "event_ts_local": F.when(ok, stamp_wall_clock(stamp)),
        "level": F.col("level"),
        "message": field("message", raw),
        "source": field("source"),
        "status": field("status"),
        "metadata": field("metadata"),
    }
    keep = [c for c in ("source_path", "block_start", "line_id", "raw") if c in lines.columns]
    return staged.select(*keep, "format", "parsed", *[fields[key].alias(key) for key in ENTRY_FIELDS])


def parse_entries(
    lines: DataFrame,
    formats: DataFrame | None = None,
    fmt: str | None = None,
    names: list[str] | None = None,
    keep_failed: bool = True,
    registry: FormatRegistry = DEFAULT_REGISTRY,
) -> DataFrame:
    """LINES -> ENTRIES, each source in its own format, or all in ``fmt``.

    Blank lines are dropped. A line that does not parse stays with ``parsed`` false, level INFO and the
    line as message, unless ``keep_failed`` is false. ``names`` saves the small job that looks up which
    formats occur in ``formats``.
    """
    content = drop_blank(lines)
    if fmt is not None:
        entries = parse_marked(content.withColumn("format", F.lit(fmt)), [fmt], registry)
    else:
        if names is None:
            names = sorted({*formats_in_use(formats), FALLBACK_FORMAT})
        entries = parse_marked(attach_format(content, formats), names, registry)
    return entries if keep_failed else entries.where("parsed")


def formats_in_use(formats: DataFrame) -> list[str]:
    """Distinct format names: at most one per registered format, so safe on the driver."""
    return sorted(r["format"] for r in formats.select("format").where("format is not null").distinct().collect())


def parse_python(
    lines: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
) -> DataFrame:
    """Escape hatch: a Python function over batches of LINES that yields batches of ENTRIES."""
    return lines.mapInPandas(fn, ENTRIES)


def explode_batches(lines: DataFrame) -> DataFrame:
    """One line for each record of a batch, where a line holds several; other lines stay as they are.

    CloudWatch batches become batches of one event with the group and stream of the whole, Azure arrays become
    their objects. Records keep the ``line_id`` of their line and get its ``record`` number. Parsers read the first
    record of a batch only; call this before them to read all.
    """
    opens = F.regexp_replace(F.col("raw"), "^\\s+", "")
    doc = F.when(opens.startswith("{") & F.contains("raw", F.lit('"logEvents"')) | opens.startswith("["), parse_json(F.col("raw")))
    events = F.try_variant_get("_doc", "$.logEvents", "array<variant>")
    objects = F.try_variant_get("_doc", "$", "array<variant>")
    context = F.concat_ws(
        "",
        F.lit("{"),
        *[
            F.when(member(F.col("_doc"), key).isNotNull(), F.concat(F.lit(f'"{key}":'), F.to_json(member(F.col("_doc"), key)), F.lit(",")))
            for key in ("logGroup", "logStream")
        ],
        F.lit('"logEvents":['),
    )
    records = (
        F.when(F.size(events) > 0, F.transform(events, lambda e: F.concat("_context", F.to_json(e), F.lit("]}"))))
        .when(F.size(objects) > 0, F.transform(objects, lambda e: F.to_json(e)))
        .otherwise(F.array("raw"))
    )
    read = lines.withColumn("_doc", doc).withColumn("_context", context)
    rest = [c for c in lines.columns if c != "raw"]
    return read.select(*rest, F.posexplode(records).alias("record", "raw"))


def min_level(entries: DataFrame, level: str = "ERROR", limit: int = 20, unknown_as_lowest: bool = False) -> DataFrame:
    """First entries at or above a level, in file order.

    Words outside the five levels, and a missing level, are dropped; with ``unknown_as_lowest`` they rank as the lowest.
    """
    floor = LEVELS.index(level)
    rank = level_rank(F.col("level"))
    if unknown_as_lowest:
        rank = F.coalesce(rank, F.lit(0))
    hits = entries.where(F.col("parsed") & (rank >= floor))
    return hits.orderBy("source_path", "line_id").limit(limit)


def _java_pattern(pattern: str) -> str:
    """A Python pattern in Java's spelling: named groups, references to them, and the end anchor."""
    names: dict[str, str] = {}

    def name(found: re.Match) -> str:
        return names.setdefault(found, f"g{len(names) + 1}")

    out, i, in_class = [], 0, False
    while i < len(pattern):
        rest = pattern[i:]
        group = re.match(r"\(\?P<(\w+)>", rest)
        reference = re.match(r"\(\?P=(\w+)\)", rest)
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append("\\z" if pattern[i + 1] == "Z" and not in_class else pattern[i : i + 2])
            i += 2
        elif not in_class and group:
            out.append(f"(?<{name(group[1])}>")
            i += group.end()
        elif not in_class and reference:
            out.append(f"\\k<{name(reference[1])}>")
            i += reference.end()
        else:
            if in_class and pattern[i] in "[&":  # plain characters in a Python class, operators in a Java one
                out.append("\\")
            elif pattern[i] == "[":
                in_class = True
                if rest.startswith(("[]", "[^]")):  # a bracket that comes first stands for itself
                    lead = rest[: rest.index("]")]
                    out.append(lead + "\\]")
                    i += len(lead) + 1
                    continue
            elif pattern[i] == "]":
                in_class = False
            out.append(pattern[i])
            i += 1
    return "".join(out)


def regex_filter(df: DataFrame, pattern: str | None, column: str = "raw") -> DataFrame:
    """Keep lines in which the Python pattern is found; an empty pattern, or one Python rejects, keeps all.

    Patterns are respelled for Java. One that Java still rejects (a conditional group, say) is matched by Python
    over Arrow batches.
    """
    if not pattern:
        return df
    try:
        compiled = re.compile(pattern)
    except re.error:
        return df
    java = _java_pattern(pattern)
    try:
        df.sparkSession.range(1).select(F.lit("").rlike(java)).collect()
    except PySparkException:

        @F.pandas_udf("boolean")
        def found(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: t is not None and compiled.search(t) is not None)

        return df.where(found(F.col(column)))
    return df.where(F.col(column).rlike(java))


def level_in(entries: DataFrame, levels: list[str]) -> DataFrame:
    return entries.where(F.upper(F.coalesce(F.col("level"), F.lit("INFO"))).isin(*levels))


def number_lines(lines: DataFrame) -> DataFrame:
    """Add ``line_no``, the 0-based number of a line in its source.

    Call it on LINES as read, before any filter: inside one block line ids have no gaps. Only the line
    count of each block is shuffled, never the lines.
    """
    blocks = lines.groupBy("source_path", "block_start").agg(
        F.count(F.lit(1)).alias("_n"), F.min("line_id").alias("_first")
    )
    earlier = (
        Window.partitionBy("source_path").orderBy("block_start").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = blocks.select(
        "source_path",
        "block_start",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return (
        lines.join(broadcast_if_small(materialize(offsets)), ["source_path", "block_start"])
        .withColumn("line_no", F.col("line_id") + F.col("_shift"))
        .drop("_shift")
    )


def from_line(entries: DataFrame, n: int) -> DataFrame:
    """Skip the first ``n`` lines of a source; needs ``line_no``."""
    return entries.where(F.col("line_no") >= n)


def replay_rows(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """What a replay shows per entry. ``totals`` is (source_path, total_lines); entries carry ``line_no``."""
    joined = entries.join(broadcast_if_small(totals.select("source_path", "total_lines")), "source_path")
    return joined.select(
        "source_path",
        F.col("raw").alias("line"),
        F.coalesce(F.nullif(F.col("level"), F.lit("")), F.lit("INFO")).alias("level"),
        F.col("event_ts_local").alias("ts"),
        F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("raw")).alias("message"),
        "source",
        "parsed",
        "line_no",
        (F.col("line_no") / F.greatest(F.col("total_lines"), F.lit(1))).alias("progress"),
    )
