"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, place, slices
from .words import mix

DIM = 1 << 15
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 1500
CHUNK = 1 << 20
UNKNOWN = "und"
_SALTS = {n: np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) & (2**64 - 1)) for n in range(1, 8)}
_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTERS


def gram_counts(text: str | None, dim: int = DIM) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed character n-grams of the lower-cased letters, other characters being word borders, and their counts.

    None if the text has no letter. Long texts are read in chunks, so that memory stays bounded by the chunk.
    """
    total, some = None, False
    text = text or ""
    for i in range(0, len(text), CHUNK):
        code = np.frombuffer(text[i : i + CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        if not letter.any():
            continue
        some = True
        code = np.concatenate([[0], np.where(letter, code, 0), [0]]).astype(np.uint64)
        code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
        for n in ORDERS:
            if len(code) < n:
                continue
            h = code[: len(code) - n + 1]
            for k in range(1, n):
                h = h * np.uint64(0x100000001B3) + code[k : len(code) - n + 1 + k]
            got = np.bincount((mix(h ^ _SALTS[n]) >> np.uint64(64 - int(math.log2(dim)))).astype(np.int64), minlength=dim)
            total = got if total is None else total + got
    if not some:
        return None
    where = np.flatnonzero(total)
    return where, total[where]


def lists_of(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as arrays of their own."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [x.copy() for x in np.split(values, ends[:-1])]


def weigh(where: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF with logarithmic counts, scaled to length 1."""
    x = (1.0 + np.log(counts)) * idf[where]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader (proximal) for multinomial logistic regression, L1 and L2 penalties.

    Each coordinate keeps z and n; its weight is 0 while |z| stays within the L1 penalty.
    """

    def __init__(self, dim: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.001) -> None:
        self.z, self.n = np.zeros((dim + 1, classes)), np.zeros((dim + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, rows: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax(x @ w)
        p[label] -= 1.0
        g = x[:, None] * p[None, :]
        n = self.n[rows]
        more = n + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = more


@dataclass
class Model:
    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        got = gram_counts(text, len(self.idf))
        if got is None or not self.classes:
            return UNKNOWN, 0.0
        z = weigh(*got, self.idf) @ self.weights[got[0]] + self.weights[-1]
        p = softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.classes[best], float(p[best])


def train_on(samples: list[tuple[int, str, np.ndarray, np.ndarray]], idf: np.ndarray, epochs: int) -> Model:
    """Fit on the bounded sample (text hash, label, n-grams, counts): a fifth of the texts sets the temperature."""
    classes = sorted({s[1] for s in samples})
    if not classes:
        return Model([], idf, np.zeros((len(idf) + 1, 0)), 1.0)
    number = {c: i for i, c in enumerate(classes)}
    ready = [
        (h % 5 == 0, number[c], np.append(w, np.int32(len(idf))), np.append(weigh(w, n, idf), 1.0).astype(np.float32))
        for h, c, w, n in sorted(samples, key=lambda s: (s[0], s[1]))
    ]
    fit = [r for r in ready if not r[0]] or ready
    model = Ftrl(len(idf), len(classes))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            _, label, rows, x = fit[i]
            model.step(rows, x, label)
    weights = model.weights()
    held = [r for r in ready if r[0]] or ready
    z = np.array([x @ weights[rows] for _, _, rows, x in held])
    y = np.array([r[1] for r in held])
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    low, high = math.log(0.5), math.log(20.0)
    for _ in range(60):  # the loss has one minimum in the temperature
        a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
        low, high = (low, b) if loss(math.exp(a)) <= loss(math.exp(b)) else (a, high)
    return Model(classes, idf, weights, math.exp((low + high) / 2))


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, epochs: int = 3, dim: int = DIM) -> Model:
    """Fit on rows (text, lang).

    Document frequencies cover all rows. The weights are fitted on a sample of at most ``sample_per_lang``
    different texts of each language, those with the lowest text hash; one task holds that sample as sparse
    vectors of at most ``dim`` entries. What reaches the driver is one vector of ``dim`` frequencies and the
    ``dim`` x languages weights.
    """

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(dim + 1, np.int64)
        for part in slices(batches, 0):
            for text in part.column(0).to_pylist():
                got = gram_counts(text, dim)
                if got is not None:
                    total[got[0]] += 1
                    total[dim] += 1
        where = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(total[where])], ["gram", "n"])

    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = rows.select("text").mapInArrow(frequencies, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    df = np.zeros(dim + 1)
    for r in counted.collect():
        df[r.gram] = r.n
    idf = np.log((1.0 + df[dim]) / (1.0 + df[:dim])) + 1.0

    hashed = rows.select("lang", F.xxhash64("text").alias("hash"), "text")
    ranked = hashed.select("lang", "hash").distinct()
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("hash")))
    limits = ranked.where(F.col("place") <= sample_per_lang).groupBy("lang").agg(F.max("hash").alias("most")).collect()
    if not limits:
        return train_on([], idf, epochs)
    table = F.from_json(F.lit(json.dumps({r.lang: r.most for r in limits})), "map<string,bigint>")
    chosen = hashed.where(F.col("hash") <= F.element_at(table, F.col("lang")))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            out = [(*r, *got) for r in zip(*map(pa.Array.to_pylist, part.columns)) if (got := gram_counts(r[2], dim)) is not None]
            arrays = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64())]
            arrays += [pa.array([o[i].astype(np.int32) for o in out], pa.list_(pa.int32())) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "hash", "grams", "counts"])

    kinds = "lang string, hash bigint, grams array<int>, counts array<int>"
    sample = chosen.mapInArrow(vectors, kinds).dropDuplicates(["lang", "hash"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for part in batches:
            grams, counts = (lists_of(part.column(i)) for i in (2, 3))
            samples += zip(part.column(1).to_pylist(), part.column(0).to_pylist(), grams, counts)
        model = train_on(samples, idf, epochs)
        fields = [json.dumps(model.classes), model.weights.astype(np.float32).tobytes(), model.temperature]
        kinds = [pa.string(), pa.binary(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([f], k) for f, k in zip(fields, kinds)], ["classes", "weights", "temperature"])

    made = sample.coalesce(1).mapInArrow(train, "classes string, weights binary, temperature double").first()
    classes = json.loads(made.classes)
    weights = np.frombuffer(made.weights, np.float32).reshape(dim + 1, len(classes))
    return Model(classes, idf.astype(np.float32), weights, made.temperature)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``; from the text alone, without a shuffle.

    ``und`` with score 0 for null texts, texts without letters, and when nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dim x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [shared.value.predict(t) for t in part.column(1).to_pylist()]
            arrays = [part.column(0), part.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("held_out", held_out())
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = SAMPLE_PER_LANG
) -> DataFrame:
    """Learn from the labelled documents that are not held out, predict all.

    Rows with null text or label are not learned from. Repeated rows each get a row; their text counts once in
    the sample. An empty table gives an empty result. Extra columns are ignored, whatever their names.
    """
    rows = pick(docs, id_col, text_col, lang_col).toDF("doc_id", "text", "lang")
    model = fit(rows.where(~held_out()).select("text", "lang"), sample_per_lang)
    return predict(rows, model)


def keep_known(docs: DataFrame, least_score: float = 0.5, sample_per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """The documents whose language is told with at least ``least_score``; all columns stay as they are."""
    rows = pick(docs, "doc_id", "text", "lang")
    model = fit(rows.where(~held_out()).select("text", "lang"), sample_per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text_at = place(docs.columns, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_at):
            got = [shared.value.predict(t) for t in part.column(text_at).to_pylist()]
            yield part.filter(pa.array([lang != UNKNOWN and p >= least_score for lang, p in got], pa.bool_()))

    numbered = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
