"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import flat, pick, slices

# The base patterns and their least lengths.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character over a window of 20 from which a string of the class counts as random.
THRESHOLDS = {"digits": 3.1, "hex": 3.2, "letters": 4.05, "alnum": 3.8, "base64": 3.8}
#: Strings that look random and are none: placeholders (with the value given to a ``your_`` name), counting runs,
#: identifiers made of words. Only the stretch that a pattern matches is suppressed.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|dummy|(?<![A-Za-z0-9])your[_-](?:[A-Za-z_-]+=[A-Za-z0-9]+)?",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"^[-_/=+]*[A-Za-z]{1,19}(?:[-_/=+]+[A-Za-z]{1,19})+[-_/=+]*$",
    r"^[-_=+/]*(.)\1*[-_=+/]*$",
)


class _Scan:
    def __init__(self, window: int, thresholds: dict[str, float], allow: tuple[str, ...]) -> None:
        self.window, self.thresholds = window, thresholds
        self.allow = [re.compile(p) for p in allow]
        self.assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
        self.access = re.compile(ACCESS)
        self.hex = re.compile(f"{HEX[:-1]}{{{HEX_LEAST},}}")
        self.candidate = re.compile(f"[A-Za-z0-9+/_=-]{{{window},}}")
        self.terms = [n * math.log2(n) if n else 0.0 for n in range(window + 2)]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    @staticmethod
    def kind_of(text: str) -> str:
        if text.isdigit():
            return "digits"
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
            return "hex"
        if text.isalpha():
            return "letters"
        return "alnum" if text.isalnum() else "base64"

    def stretches(self, text: str) -> list[tuple[int, int]]:
        """What is left of a candidate without the stretches that the allow-list matches, if a window fits in."""
        parts = [(0, len(text))]
        for p in self.allow:
            left = []
            for a, b in parts:
                start = a
                for m in p.finditer(text[a:b]):
                    left.append((start, a + m.start()))
                    start = a + m.end()
                left.append((start, b))
            parts = left
        return [(a, b) for a, b in parts if b - a >= self.window]

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        """Maximal runs covered by windows at or above their threshold, see :func:`scan_secrets`."""
        out: list[tuple[int, int, int]] = []
        for m in self.candidate.finditer(text):
            for a, b in self.stretches(m[0]):
                out += [(m.start() + a + i, 3, m.start() + a + j) for i, j in self.runs(m[0][a:b])]
        return out

    def runs(self, s: str) -> list[tuple[int, int]]:
        """Runs of windows at or above the threshold of their own class, if digits or hex, or of the class of ``s``."""
        out: list[tuple[int, int]] = []
        w, terms = self.window, self.terms
        # Entropy of a window is log2(w) - sum(n log2 n) / w; the sum changes in two terms for each step.
        most = {k: (math.log2(w) - x) * w + 1e-9 for k, x in self.thresholds.items()}
        own = most[self.kind_of(s)]
        counts: dict[str, int] = {}
        total, first, stop = 0.0, -1, -1
        no_digit = no_lower = no_upper = -1  # the last characters that are not of the class
        for i, c in enumerate(s):
            if not "0" <= c <= "9":
                no_digit = i
                if not "a" <= c <= "f":
                    no_lower = i
                if not "A" <= c <= "F":
                    no_upper = i
            n = counts.get(c, 0)
            counts[c] = n + 1
            total += terms[n + 1] - terms[n]
            if i >= w:
                gone = s[i - w]
                n = counts[gone]
                counts[gone] = n - 1
                total += terms[n - 1] - terms[n]
            if i < w - 1:
                continue
            limit = own
            if no_digit <= i - w:
                limit = max(limit, most["digits"])
            elif min(no_lower, no_upper) <= i - w:
                limit = max(limit, most["hex"])
            if total <= limit:
                if i - w + 1 > stop:
                    if first >= 0:
                        out.append((first, stop))
                    first = i - w + 1
                stop = i + 1
        if first >= 0:
            out.append((first, stop))
        return out


_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[[ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"]] = True


def suspects(texts: pa.Array, least: int) -> np.ndarray:
    """Which texts need a scan: they hold ``:`` or ``=`` or AKIA, or a run of ``least`` candidate characters."""
    data, starts = flat(texts)
    flagged = pc.match_substring(pc.fill_null(texts, ""), "AKIA").to_numpy(zero_copy_only=False).astype(bool)
    if not len(data):
        return flagged
    marks = np.flatnonzero((data == 58) | (data == 61))
    flagged[np.searchsorted(starts, marks, side="right") - 1] = True
    stops = np.concatenate([[-1], np.flatnonzero(~_RUN_BYTES[data]), [len(data)]])
    runs = np.flatnonzero(np.diff(stops) > least)
    first = np.searchsorted(starts, stops[runs] + 1, side="right") - 1
    last = np.searchsorted(starts, stops[runs + 1] - 1, side="right") - 1
    flagged[first[first == last]] = True
    for i, j in zip(first[first != last], last[first != last]):  # a run over the border of two texts
        flagged[i : j + 1] = True
    return flagged


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    thresholds: dict[str, float] | None = None,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """One row per document: id, and ``found``, an array of (start, kind, end, value) in order of start.

    Kinds are the three base patterns (0 assign, 1 access, 2 hex; leftmost matches that do not overlap, too
    short ones dropped) and 3 entropy: runs of candidate characters in which each window of ``window`` characters
    reaches the entropy set for its character class: that of digits or hex if the window holds nothing else, or that
    of the candidate. Stretches of the candidate that the allow-list matches are cut out, and what is left on either
    side is scanned by itself.
    Offsets are code points, ends exclusive. Texts that cannot hold a match are told apart by two vector passes
    over their bytes. No shuffle takes place.

    Null and empty texts have no findings. Repeated rows each give a row. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    limits = THRESHOLDS | (thresholds or {})
    least = min(HEX_LEAST, window)
    item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _Scan(window, limits, allow)
        for part in slices(batches):
            found: list[list[dict]] = [[] for _ in range(part.num_rows)]
            texts = part.column(1)
            for i in np.flatnonzero(suspects(texts, least)):
                text = texts[int(i)].as_py()
                rows = sorted(scan.base(text) + scan.entropy(text))
                found[i] = [{"start": a, "kind": k, "end": b, "value": text[a:b]} for a, k, b in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(item))], ["doc_id", "found"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"
    return rows.mapInArrow(run, f"doc_id {kind}, found {found}")


def digest(found: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and all spans, from the findings of :func:`scan_secrets`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out: list[tuple] = []
            for rows in part.column(1).to_pylist():
                spans = [(r["start"], r["kind"], r["end"]) for r in rows]
                base = joined([s for s in spans if s[1] < 3])
                counts = [sum(s[1] == k for s in spans) for k in range(3)]
                out.append((*counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            cols = list(zip(*out)) if out else [[]] * 5
            arrays = [pa.array(list(c), pa.int64()) for c in cols[:3]] + [pa.array(list(c), pa.string()) for c in cols[3:]]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names)

    kind = found.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} bigint" for k in KINDS[:3])
    return found.mapInArrow(run, f"doc_id {kind}, {counts}, base_sha256 string, spans string")
