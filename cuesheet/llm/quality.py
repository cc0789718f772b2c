"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.common import held, save
from cuesheet.llm.words import words

NAMES = (
    "length", "upper", "symbol", "again", "distinct", "word_length", "stop", "digit", "lone_symbol", "lines", "accent",
)
_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | (_ASCII >= 97) & (_ASCII <= 122) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_STOP = np.isin(_ASCII, list(b".,;:?!'\"()-"))
_SYMBOL = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~_DIGIT & ~_STOP
_LEAD = (_ASCII < 128) | (_ASCII >= 192)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text. Null and empty texts have the row of zero counts.

    Every share is (count + a) / (size + b) before its logarithm, so short texts stay near the middle and every
    value is finite.
    """
    out = np.empty((len(column), len(NAMES)))
    for w in words(column):
        at = slice(w.first, w.first + w.texts)
        n = w.count.astype(float)
        base = w.base()

        def count(flags: np.ndarray, w=w, base=base) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(flags[w.data], dtype=np.int64)))
            per = np.concatenate(([0], np.cumsum(total[w.end] - total[w.start])))
            return np.diff(per[base]).astype(float)

        chars, letters = count(_LEAD), count(_LETTER & _LEAD)
        h = w.hashes(lower=True)
        same = w.doc[1:] == w.doc[:-1]
        again = np.bincount(w.doc[1:], same & (h[1:] == h[:-1]), w.texts)
        order = np.lexsort((h, w.doc))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | ~same
        lone = (w.end - w.start == 1) & _SYMBOL[w.data[w.start]]
        newlines = np.concatenate(([0], np.cumsum(w.data == 10)))
        lines = np.bincount(w.doc[1:], same * (newlines[w.start[1:]] - newlines[w.end[:-1]]), w.texts)
        distinct = np.bincount(w.doc, fresh, w.texts)
        part = out[at]
        part[:, 0] = np.log1p(n)
        part[:, 1] = np.log((count(_UPPER) + 1) / (letters + 30))
        part[:, 2] = np.log((count(_SYMBOL) + 0.5) / (chars + 200))
        part[:, 3] = np.log((again + 0.5) / (n + 20))
        part[:, 4] = np.log((distinct + 5) / (n + 5)) / np.log(n + 10)
        part[:, 5] = np.log((chars + 25) / (n + 5))
        part[:, 6] = np.log((count(_STOP) + 2) / (n + 20))
        part[:, 7] = np.log((count(_DIGIT) + 0.5) / (chars + 200))
        part[:, 8] = np.log((np.bincount(w.doc, lone, w.texts) + 0.5) / (n + 40))
        part[:, 9] = np.log((lines + 2) / (n + 40))
        part[:, 10] = np.log((chars - letters - count(_DIGIT) + 5) / (chars + 50))
    return out


@dataclass(frozen=True)
class Model:
    """prior: log odds of label 1. Means and the Cholesky factors of the shrunk covariances, by class, kept inverted."""

    prior: float
    mean: np.ndarray | None = None
    inverse: np.ndarray | None = None
    logdet: np.ndarray | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        if self.mean is not None:
            dens = [-0.5 * (((x - m) @ i.T) ** 2).sum(1) - d for m, i, d in zip(self.mean, self.inverse, self.logdet, strict=True)]
            margin = margin + dens[1] - dens[0]
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def _discriminant(n: np.ndarray, total: np.ndarray, square: np.ndarray, pool: float, ridge: float) -> Model:
    if min(n) < 2:
        return Model(float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    mean = total / n[:, None]
    cov = square / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    scale = np.diag(np.diag(pooled) + 1e-9)
    shrunk = (1 - ridge) * ((1 - pool) * cov + pool * pooled) + ridge * scale
    factor = np.linalg.cholesky(shrunk)
    return Model(
        float(np.log(n[1] / n[0])), mean, np.linalg.inv(factor), np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1)
    )


def features(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in NAMES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in x.T)], ["doc_id", *NAMES])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def fit(table: DataFrame, labels: DataFrame, held_out: int = 0, pool: float = 0.05, ridge: float = 0.02) -> Model:
    """Fit on all labelled rows whose crc32(doc_id) mod 5 is not held_out, by one aggregate of first and second moments.

    Labels of one document that contradict each other, and null labels, teach nothing. With fewer than two rows
    of a class the model is the prior alone.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("z"))
    known = known.where("y = z and y in (0, 1)").select("doc_id", "y")
    rows = table.where(~held("doc_id", held_out)).join(known, "doc_id")
    pairs = [(a, b) for i, a in enumerate(NAMES) for b in NAMES[i:]]
    sums = rows.groupBy("y").agg(
        F.count("*").alias("n"), *(F.sum(c).alias(c) for c in NAMES), *(F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in pairs)
    ).collect()
    d = len(NAMES)
    n, total, square = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for r in sums:
        n[r["y"]] = r["n"]
        total[r["y"]] = [r[c] for c in NAMES]
        for a, b in pairs:
            i, j = NAMES.index(a), NAMES.index(b)
            square[r["y"], i, j] = square[r["y"], j, i] = r[f"{a}*{b}"]
    return _discriminant(n, total, square, pool, ridge)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: int = 0) -> DataFrame:
    """Columns doc_id, held_out, score (0 to 1), predicted, one row per row of docs; no documents, no rows.

    Texts are read once; the statistics, a few numbers per document, are kept as a table for fitting and scoring.
    """
    table = save(features(docs))
    model = fit(table, labels, held_out)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy() for c in NAMES])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = table.mapInArrow(run, schema)
    return scored.select(
        "doc_id", held("doc_id", held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the classifier doesn't reject."""
    table = save(features(docs, text))
    model = fit(table, labels)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column(place))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
