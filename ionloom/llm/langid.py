"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: 1- to 3-grams of the lower-cased text, hashed to a fixed number of columns; term counts go through
log1p, are weighted by inverse document frequency and scaled to length one. Document frequencies are
counted over every training document of the corpus. Weights are fitted by follow-the-regularised-leader
(per-coordinate rates, L1 and L2 penalties) on a bounded sample of training rows, which is taken by a
hash of the identifier and the same for any partitioning; a temperature is then fitted on rows of the
sample kept back from the fit.

Defined results
* null text, or a text without a letter: ``und`` with score 0;
* empty training data: every text is ``und`` with score 0;
* very long texts are read whole, in blocks; ties go to the language first in order;
* repeated rows and repeated identifiers: predicted one by one;
* other columns are carried along; the model never sees them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UND = "und"
BITS = 14
#: Characters of a text hashed at a time.
BLOCK = 1 << 19


@dataclass(frozen=True)
class Options:
    """``sample``: training rows fitted at most. ``alpha``, ``beta``: FTRL rates. ``l1``, ``l2``: penalties."""

    sample: int = 4000
    kept_back: float = 0.2
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.2
    l2: float = 0.2
    seed: int = 17


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n-grams of a code point array."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.empty(0, np.int64)
    h = np.full(size, 0x9E3779B97F4A7C15 + n, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : i + size]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def counts(text: str) -> np.ndarray:
    """Counts of the hashed 1- to 3-grams of the whole lower-cased text."""
    out = np.zeros(1 << BITS, np.float64)
    lower = text.lower()
    for at in range(0, len(lower), BLOCK):
        block = lower[at : at + BLOCK + 2]
        codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = min(BLOCK, len(codes))
        for n in (1, 2, 3):
            out += np.bincount(_hash(codes, n)[:own], minlength=1 << BITS)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def _sparse(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = counts(text)
    columns = np.flatnonzero(c)
    return columns, np.log1p(c[columns])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of one task's rows: one row per column that occurs, and one for the rows."""
    total = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for text in batch.column(0):
            value = text.as_py()
            if has_letter(value):
                total[:-1] += counts(value) > 0
                total[-1] += 1
    columns = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(columns, pa.int64()), pa.array(total[columns], pa.int64())], names=["column", "documents"])


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Per column the number of texts that hold it, then the number of texts; the size is fixed by ``BITS``."""
    rows = texts.mapInArrow(_frequencies, "column long, documents long").groupBy("column").agg(F.sum("documents").alias("documents"))
    out = np.zeros((1 << BITS) + 1, np.float64)
    for column, documents in rows.collect():
        out[column] = documents
    return out


@dataclass(frozen=True)
class Model:
    """``weights``: columns by languages, the last row the bias."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def logits(self, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        x = values * self.idf[columns]
        norm = np.sqrt(x @ x)
        return (x / norm if norm else x) @ self.weights[columns] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UND, 0.0
        p = _softmax(self.logits(*_sparse(text)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_languages: int, o: Options) -> np.ndarray:
    """Weights by follow-the-regularised-leader with elastic net; the bias is not penalised."""
    z = np.zeros(((1 << BITS) + 1, n_languages))
    n = np.zeros_like(z)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = -(zi - np.sign(zi) * o.l1) / ((o.beta + np.sqrt(n[at])) / o.alpha + o.l2)
        w[np.abs(zi) <= o.l1] = 0.0
        w[-1] = -z[-1] / ((o.beta + np.sqrt(n[-1])) / o.alpha)
        return w

    for epoch in range(o.epochs):
        for i in np.random.default_rng(o.seed + epoch).permutation(len(rows)):
            columns, x = rows[i]
            at = np.append(columns.astype(np.int64), 1 << BITS)
            xs = np.append(x, 1.0)
            w = weights(at)
            p = _softmax(xs @ w)
            p[labels[i]] -= 1.0
            g = np.outer(xs, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / o.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange((1 << BITS) + 1))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by a golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -float(np.log(np.maximum(p, 1e-12)).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(training: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", options: Options = Options()) -> Model:
    """Fit on rows with a text and a language; at most ``options.sample`` of them reach the driver."""
    usable = training.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(doc).cast("string").alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang")
    )
    frequency = document_frequencies(usable.select("text"))
    idf = np.log((1.0 + frequency[-1]) / (1.0 + frequency[:-1])) + 1.0
    order = F.xxhash64("doc", F.lit(options.seed))
    # Rows below a hash threshold are about 1.3 times the sample; only those are sorted.
    wanted = int(2**32 * 1.3 * options.sample / max(usable.count(), 1))
    near = usable.where(F.pmod(order, F.lit(2**32)) <= F.lit(wanted))
    chosen = near.orderBy(order, "lang", F.xxhash64("text")).limit(options.sample)
    # Read row by row into small arrays: the driver holds the sample once, six bytes a feature.
    names, rows = [], []
    for r in chosen.mapInArrow(_features, "lang string, columns binary, values binary").toLocalIterator():
        columns = np.frombuffer(r["columns"], np.uint16).copy()
        x = np.frombuffer(r["values"], np.float32) * idf[columns]
        names.append(r["lang"])
        rows.append((columns, (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)))
    languages = tuple(sorted(set(names)))
    if not languages:
        return Model((), idf, np.zeros(((1 << BITS) + 1, 0)), 1.0)
    y = np.array([languages.index(n) for n in names])
    split = len(rows) - int(options.kept_back * len(rows))
    weights = _ftrl(rows[:split], y[:split], len(languages), options)
    kept = np.array([x @ weights[c] + weights[-1] for c, x in rows[split:]]).reshape(-1, len(languages))
    return Model(languages, idf, weights, _temperature(kept, y[split:]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, columns, values = [], [], []
        for text, name in zip(batch.column("text"), batch.column("lang")):
            value = text.as_py()
            if has_letter(value):
                c, v = _sparse(value)
                lang.append(name.as_py())
                columns.append(c.astype(np.uint16).tobytes())
                values.append(v.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(columns, pa.binary()), pa.array(values, pa.binary())], names=["lang", "columns", "values"])


def predict(df: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """Add the predicted language and its calibrated probability; one pass, no shuffle."""

    schema = T.StructType([f for f in df.schema.fields if f.name not in (pred, score)] + [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    others = [f.name for f in df.schema.fields if f.name not in (pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column(text)]
            arrays = [batch.column(c) for c in others]
            arrays += [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*others, pred, score])

    return df.mapInArrow(run, schema)


def rejected(pred: Column, score: Column, least: float = 0.5) -> Column:
    """Texts without a recognised language, or recognised with less than ``least`` probability."""
    return (pred == UND) | (score < least)
