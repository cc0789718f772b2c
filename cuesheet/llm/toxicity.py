"""Toxicity: a linear classifier whose score must not move when an identity term is swapped for another.

Features are words and their beginnings of three to six bytes, each as a rate in the document. A labelled sentence
that names a group is also read with every other name of the same set in its place; the squared change of the log
odds is added to the loss (logit pairing), so weight that merely follows a group's name is taken away from the name
and its beginnings, and neutral mentions are no longer pulled up. The loss is convex and its pairing term is a quadratic
form, so a few Newton steps fit it.

Defined cases. A null text is an empty one; a text without features has the score of the intercept, also when it is
empty. A null doc_id counts as the id ''. Contradicting or null labels of a document teach nothing, repeated labels
count once, repeated documents are scored each by itself. Without both classes the score is the smoothed share of
label 1. No documents, no rows. Other columns of documents and labels are not read, so their names can't clash. A text
is cut into spans of about 4 MB together with its neighbours; one longer text is a span of its own and needs some ten
times its size in memory.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.llm.common import held, read, save
from cuesheet.llm.words import Words, hashes, words

#: Interchangeable names of groups; a swap stays inside its set.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("woman", "man"), ("women", "men"), ("girl", "boy"), ("girls", "boys"),
    ("transgender", "cisgender"), ("disabled", "able-bodied"), ("old", "young"),
    ("muslime", "christen", "juden"), ("frau", "mann"), ("frauen", "männer"),
    ("musulmans", "chrétiens", "juifs"), ("femme", "homme"), ("femmes", "hommes"),
    ("musulmanes", "cristianos", "judíos"), ("mujer", "hombre"), ("mujeres", "hombres"),
)
PREFIXES = (3, 4, 5, 6)
_BYTES = np.arange(256)
INSIDE = (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128)
_LOWER = _BYTES.astype(np.uint8)
_LOWER[65:91] += 32
SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")


def _lead(w: Words, start: np.ndarray) -> np.ndarray:
    """The first three bytes of words as one number."""
    a = _LOWER[w.data]
    return a[start].astype(np.uint32) << np.uint32(16) | a[start + 1].astype(np.uint32) << np.uint32(8) | a[start + 2]


def _keys(w: Words, start: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per kind of feature: which of the words have it, and its hash. Kinds differ in a mark mixed into the hash."""
    out = [(np.arange(len(start)), hashes(w.data, start, end, lower=True))]
    for k in PREFIXES:
        have = np.flatnonzero(end - start >= k)
        out.append((have, hashes(w.data, start[have], start[have] + k, lower=True) ^ np.uint64(0x9E3779B97F4A7C15 * k % 2**64)))
    return out


def _rate(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.log1p(count * 100.0 / (size + 20.0))


def _long(w: Words) -> np.ndarray:
    return np.flatnonzero(w.end - w.start >= PREFIXES[0])


def sparse(column: pa.Array) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Per span of texts: the words, and for each (document, feature) pair its document, its hash and its value."""
    for w in words(column, inside=INSIDE):
        at = _long(w)
        start, end, doc = w.start[at], w.end[at], w.doc[at]
        found = _keys(w, start, end)
        docs, keys = np.concatenate([doc[i] for i, _ in found]), np.concatenate([h for _, h in found])
        order = np.lexsort((keys, docs))
        docs, keys = docs[order], keys[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(keys)))
        yield w, docs[first], keys[first], _rate(count, w.count[docs[first]])


def dense(column: pa.Array, features: np.ndarray) -> np.ndarray:
    """One row of the values of the given (sorted) features per text; texts are read whole."""
    out = np.zeros((len(column), len(features)))
    if not len(features):
        return out
    for w, doc, key, value in sparse(column):
        i = np.minimum(np.searchsorted(features, key), len(features) - 1)
        hit = features[i] == key
        out[w.first + doc[hit], i[hit]] = value[hit]
    return out


def swaps(text: str | None, identities: Sequence[Sequence[str]] = IDENTITIES) -> list[str]:
    """The text with every identity term of one sentence replaced by another of its set, for all sentences and others.

    Matching ignores case and takes whole words; a sentence without such a term yields nothing.
    """
    if not text:
        return []
    sets = {t: group for group in identities for t in group}
    term = re.compile(r"(?<![^\W_])(" + "|".join(sorted(map(re.escape, sets), key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)
    out = []
    for s in SENTENCE.finditer(text):
        named = {m.group(1).lower() for m in term.finditer(s.group())}
        most = max((len(sets[t]) for t in named), default=1)
        for k in range(1, most):
            turn = lambda m, k=k: (g := sets[m.group(1).lower()])[(g.index(m.group(1).lower()) + k) % len(g)]
            out.append(text[: s.start()] + term.sub(turn, s.group()) + text[s.end() :])
    return out


@dataclass(frozen=True)
class Model:
    """features: sorted hashes; weight per feature; bias. leads: which first three bytes any feature has."""

    features: np.ndarray
    weight: np.ndarray
    bias: float
    leads: np.ndarray

    def logits(self, column: pa.Array) -> np.ndarray:
        """The same as dense() times the weights; words whose first three bytes no feature has are passed over."""
        out = np.full(len(column), self.bias)
        if not len(self.features):
            return out
        table = np.zeros(1 << 24, bool)
        table[self.leads] = True
        for w in words(column, inside=INSIDE):
            at = _long(w)
            at = at[table[_lead(w, w.start[at])]]
            start, end, doc = w.start[at], w.end[at], w.doc[at]
            total = np.zeros(w.texts)
            cells = []
            for have, key in _keys(w, start, end):
                i = np.minimum(np.searchsorted(self.features, key), len(self.features) - 1)
                hit = self.features[i] == key
                cells.append(doc[have][hit] * len(self.features) + i[hit])
            cell, count = np.unique(np.concatenate(cells), return_counts=True)
            d, f = cell // len(self.features), cell % len(self.features)
            np.add.at(total, d, self.weight[f] * _rate(count, w.count[d]))
            out[w.first : w.first + w.texts] += total
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(column), -500, 500)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, change: np.ndarray, ridge: float, pairing: float, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of the weighted logistic loss + ridge/2 |w|^2 + pairing/2 * mean |change w|^2."""
    a = np.column_stack([x, np.ones(len(x))])
    fixed = np.diag(np.append(np.full(x.shape[1], ridge), 1e-6))
    if len(change):
        c = np.column_stack([change, np.zeros(len(change))])
        fixed += pairing * len(x) / len(c) * (c.T @ c)
    w = np.zeros(a.shape[1])
    w[-1] = np.log((weight @ y + 0.5) / (weight @ (1 - y) + 0.5))
    loss = lambda w: weight @ np.logaddexp(0, np.where(y == 1, -1, 1) * (a @ w)) + w @ fixed @ w / 2
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + fixed + 1e-9 * np.eye(len(w)), a.T @ (weight * (p - y)) + fixed @ w)
        size = 1.0
        while size > 1e-6 and not loss(w - size * step) <= now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * (1 + abs(now)):
            break
    return w


def known(labels: DataFrame, held_out: int, column: str = "toxic") -> DataFrame:
    """doc_id and y of the labelled rows that may teach: not held out, labels 0 or 1 that don't contradict each other."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("y")).where("y is not null and doc_id is not null")
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z and y in (0, 1)")
    return rows.where(~held("doc_id", held_out, 4)).select("doc_id", "y")


def _drawn(rows: DataFrame, counts: dict[int, int], most: int) -> DataFrame:
    """At most `most` rows of each class, those of the smallest hash of doc_id: a fixed sample of bounded size."""
    h = F.xxhash64("doc_id")
    out = None
    for y, n in sorted(counts.items()):
        bound = -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, 2.0 * most / n + 50 / n)))
        part = rows.where((F.col("y") == y) & (h <= F.lit(min(bound, 2**63 - 1)))).orderBy(h, "doc_id").limit(most)
        out = part if out is None else out.unionByName(part)
    return out


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def fit(
    docs: DataFrame, labels: DataFrame, held_out: int = 2, rows: int = 4000, size: int = 256, ridge: float = 0.3,
    pairing: float = 10.0, identities: Sequence[Sequence[str]] = IDENTITIES, text: str = "text",
) -> Model:
    """Fit on a bounded sample of the labelled rows whose crc32(doc_id) mod 4 is not held_out.

    rows bounds the sample: at most that many documents of each class, weighted back to the classes' true shares.
    size features with the largest standardised difference between the classes are kept. The sample's ids (bounded)
    are broadcast; its features are counted in the cluster, and size columns of at most 2 * rows rows are fitted
    on the driver.
    """
    rows_known = save(known(labels, held_out))
    counts = {r["y"]: r["count"] for r in rows_known.groupBy("y").count().collect()}
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5)))
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), prior, np.zeros(0, np.int64))
    if min(counts.get(0, 0), counts.get(1, 0)) < 2:
        return nothing
    drawn = save(_drawn(rows_known, counts, rows))
    sample = save(_texts(docs, text).join(F.broadcast(drawn), "doc_id"))
    taken = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if min(taken.get(0, 0), taken.get(1, 0)) < 2:
        return nothing
    features, leads = _select(sample, taken, counts, size)
    x, y, change = _design(sample, features, identities)
    scale = np.sqrt((x**2).mean(0)) + 1e-9
    share = np.where(y == 1, counts[1] / max((y == 1).sum(), 1), counts[0] / max((y == 0).sum(), 1))
    share = share * len(y) / share.sum()
    w = newton(x / scale, y, share, change / scale, ridge, pairing)
    return Model(features, w[:-1] / scale, float(w[-1]), leads)


def _select(sample: DataFrame, taken: dict[int, int], counts: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The features of the largest |difference of class means| / deviation, and the first three bytes of each."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(2).to_numpy(zero_copy_only=False)
            for w in words(b.column(1), inside=INSIDE):
                at = _long(w)
                start, end, doc = w.start[at], w.end[at], w.doc[at]
                lead = _lead(w, start)
                found = _keys(w, start, end)
                docs, keys = np.concatenate([doc[i] for i, _ in found]), np.concatenate([h for _, h in found])
                leads = np.concatenate([lead[i] for i, _ in found])
                order = np.lexsort((docs, keys))
                docs, keys, leads = docs[order], keys[order], leads[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
                first = np.flatnonzero(fresh)
                if not len(first):
                    continue
                value = _rate(np.diff(np.append(first, len(keys))), w.count[docs[first]])
                one = y[w.first + docs[first]] == 1
                keys, leads = keys[first], leads[first]
                new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                add = lambda v, new=new: np.add.reduceat(v, new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[new].view(np.int64)), pa.array(leads[new].astype(np.int64)), pa.array(add(one.astype(np.int64))),
                     pa.array(add((~one).astype(np.int64))), pa.array(add(value * one)), pa.array(add(value * ~one)),
                     pa.array(add(value**2 * one)), pa.array(add(value**2 * ~one))],
                    ["key", "lead", "d1", "d0", "s1", "s0", "q1", "q0"],
                )

    sums = sample.select("doc_id", "text", "y").mapInArrow(partial, "key long, lead long, d1 long, d0 long, s1 double, s0 double, q1 double, q0 double")
    sums = sums.groupBy("key").agg(F.min("lead").alias("lead"), *(F.sum(c).alias(c) for c in ("d1", "d0", "s1", "s0", "q1", "q0")))
    n1, n0 = float(taken[1]), float(taken[0])
    p1 = counts[1] / (counts[1] + counts[0])
    m1, m0 = F.col("s1") / n1, F.col("s0") / n0
    square = p1 * F.col("q1") / n1 + (1 - p1) * F.col("q0") / n0
    mean = p1 * m1 + (1 - p1) * m0
    strength = F.abs(m1 - m0) / F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)) + 1e-9)
    best = sums.where("d1 + d0 >= 4").orderBy(strength.desc(), "key").limit(size).collect()
    keys = np.array([r["key"] for r in best], np.int64).view(np.uint64)
    return np.sort(keys), np.unique(np.array([r["lead"] for r in best], np.int64))


def _design(sample: DataFrame, features: np.ndarray, identities: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the features of the sample's documents, their labels, and the changes that swaps make.

    A document stands once per id. Every swap is a row of changes; those that change no feature are left out, and
    more rows than features are replaced by the triangle of the same quadratic form, so a document's part is bounded.
    """
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType()), T.StructField("x", T.BinaryType()), T.StructField("c", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = dense(b.column(1), features)
            changes = []
            for i, t in enumerate(b.column(1).to_pylist()):
                other = swaps(t, identities)
                gram = np.zeros((0, len(features)))
                if other:
                    gram = dense(pa.array(other, pa.large_string()), features) - x[i]
                    gram = gram[np.abs(gram).max(1) > 0] / np.sqrt(len(other))
                    gram = np.linalg.qr(gram, "r") if len(gram) > gram.shape[1] else gram  # the same quadratic form
                changes.append(gram.astype(np.float64).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(changes, pa.binary())], kind.names)

    found = sample.select("doc_id", "text", "y").mapInArrow(run, kind).groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("y", "x", "c"))).collect()
    d = len(features)
    x = np.array([np.frombuffer(r["x"]) for r in found]).reshape(len(found), d)
    change = [np.frombuffer(r["c"]).reshape(-1, d) for r in found if r["c"]]
    return x, np.array([r["y"] for r in found], float), np.concatenate(change) if change else np.zeros((0, d))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: int = 2, text: str = "text", **fitting) -> DataFrame:
    """Columns doc_id, held_out, score (0 to 1), predicted: one row per row of docs, in one pass without a shuffle."""
    model = fit(docs, labels, held_out, text=text, **fitting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1)))], ["doc_id", "score"])

    scored = _texts(docs, text).mapInArrow(run, "doc_id long, score double")
    hit: Column = (F.col("score") >= threshold).cast("int")
    return scored.select("doc_id", held("doc_id", held_out, 4).alias("held_out"), "score", hit.alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
