"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question asked again with other values has the same
template. Windows of the template are hash-joined with those of the benchmark; what was put into the slots then
tells whether a match is a copy, a consistent re-parameterisation or a coincidence.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuesheet.llm.common import by_id, read, save
from cuesheet.llm.words import mix

#: Template words of a window; shorter items are matched whole.
WINDOW = 5
#: Share of an item's windows that one alignment must hold.
SHARE = 0.5
#: Windows with fewer words outside slots say too little as templates, unless they are a whole item; an item of only such
#: windows is matched word for word.
PLAIN = 3
#: The same for the broad reading of windows that have PLAIN words in the usual one.
LOOSE = 2
#: Benchmarks of up to so many distinct windows are also sent to the tasks as a filter before the join.
FILTER = 500_000

# fixed values: units of measure, lower case
UNITS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g gram grams kg kilogram kilograms oz ounce "
    "ounces lb lbs pound pounds ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h "
    "hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent "
    "kmh mph celsius fahrenheit kelvin watt watts volt volts joule joules newton newtons hz degrees".split()
)
# fixed values: number words
COUNTS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
)
_NUMBER = re.compile(rb"[$\xc2\xa3\xe2\x82\xac#+-]*\d[\d.,:/]*(?:st|nd|rd|th|%|[a-z]{0,3})$")
_TRIM = b".,;:!?\"'()[]{}<>*%$&#@|~`_=+-"


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word, 11)


_K = np.uint64(0x9E3779B97F4A7C15)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size word hashes."""
    n = len(h) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size):
        out = out * _K + h[k : k + max(n, 0)]
    return mix(out)


@dataclass
class Reading:
    """Word hashes of many texts' templates; what a slot held (0 elsewhere)."""

    word: np.ndarray
    slot: np.ndarray

    def plain(self, n: int) -> np.ndarray:
        """Words outside slots of every window of n."""
        total = np.concatenate(([0], np.cumsum(self.slot == 0)))
        return total[n:] - total[: max(len(total) - n, 0)]


class Canonical:
    """Templates and slots of texts' words; remembers what it found out about frequent words.

    A word loses its outer punctuation and its capitals; words of punctuation only vanish. A slot is a number
    (digits with signs, separators or a short suffix), a unit that follows a number, or a name: a word with one
    capital at its front that doesn't begin a sentence. The broad reading also takes a capital at the start of a
    sentence for a name, and number words for numbers; the literal one takes no word for a name.
    """

    def __init__(self, limit: int = 300_000):
        self.limit, self.known, self.rows = limit, {}, []

    def of(self, texts: list[list[bytes]]) -> tuple[Reading, Reading, Reading, np.ndarray, np.ndarray]:
        """The usual, the broad and the literal reading, the plain words' hashes, and every word's text."""
        if len(self.known) > self.limit:
            self.known, self.rows = {}, []
        known, rows = self.known, self.rows
        for w in {w for raw in texts for w in raw}.difference(known):
            known[w] = len(rows)
            rows.append(self._look(w))
        used = np.fromiter((known[w] for raw in texts for w in raw), np.int64)
        distinct, at = np.unique(used, return_inverse=True)
        look = [rows[k] for k in distinct.tolist()]
        low, kind, stop, name, count = (np.array([r[k] for r in look], t)[at] for k, t in enumerate((np.uint64, np.int8, bool, bool, bool)))
        text = np.repeat(np.arange(len(texts)), [len(raw) for raw in texts])
        stops, at = np.concatenate(([0], np.cumsum(stop))), np.flatnonzero(kind)
        low, kind, name, count, text = low[at], kind[at], name[at], count[at], text[at]
        first = np.ones(len(at), bool)
        first[1:] = text[1:] != text[:-1]
        fresh = first.copy()
        fresh[1:] |= stops[at[1:]] > stops[at[:-1]]

        def reading(number: np.ndarray, named: np.ndarray) -> Reading:
            unit = np.zeros(len(at), bool)
            unit[1:] = (kind[1:] == 2) & number[:-1] & ~first[1:]
            named = named & ~number & ~unit
            word = np.where(number, np.uint64(_NUMBER_HASH), np.where(unit, np.uint64(_UNIT_HASH), np.where(named, np.uint64(_NAME_HASH), low)))
            return Reading(word, np.where(number | unit | named, low, np.uint64(0)))

        number = kind == 1
        return reading(number, name & ~fresh), reading(number | count, name), reading(number, np.zeros(len(at), bool)), low, text

    @staticmethod
    def _look(w: bytes) -> tuple[int, int, bool, bool, bool]:
        """(hash, 0 nothing 1 number 2 unit 3 word, ends a sentence, could be a name, number word)"""
        bare, stop = w.strip(_TRIM), w.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b":")
        if not bare:
            return 0, 0, w[-1:] in (b".", b"!", b"?"), False, False
        chars = bare.decode("utf-8", "replace")
        lower = chars.lower()
        low = bare.lower() if bare.isascii() else lower.encode()
        if _NUMBER.match(low):
            return _hash(low), 1, stop, False, False
        return _hash(low), 2 if lower in UNITS else 3, stop, chars[0].isupper() and len(chars) > 1 and chars[1:] == chars[1:].lower(), lower in COUNTS


_NUMBER_HASH, _UNIT_HASH, _NAME_HASH = (_hash(x) for x in (b"\x01number", b"\x01unit", b"\x01name"))
_EXACT = np.uint64(_hash(b"\x01exact"))
#: Readings of a window: usual, broad, literal, and of windows with too few plain words every word as it stands.
USUAL, BROAD, LITERAL, EXACT = range(4)
PLACES = "id long, place int, size int, window long, slots binary, reading int, own long"
_PLACES = pa.schema([("id", pa.int64()), ("place", pa.int32()), ("size", pa.int32()), ("window", pa.int64()), ("slots", pa.binary()), ("reading", pa.int32()), ("own", pa.int64())])
#: Words of the texts that are looked at together.
SPAN = 200_000


def _spans(batches: Iterable[pa.RecordBatch], one: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    for b in batches:
        keys, texts, n = [], [], 0
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            keys.append(key)
            texts.append((text.as_py() or "").encode().split())
            n += len(texts[-1])
            if one or n > SPAN:
                yield keys, texts
                keys, texts, n = [], [], 0
        if keys:
            yield keys, texts


def _places(batches: Iterable[pa.RecordBatch], size: int, sizes: list[int] | None, wanted) -> Iterator[pa.RecordBatch]:
    """A row per template window and reading that differs. sizes: of the items' windows (None: each text is an item,
    whole if shorter). own: the window's hash in its first reading, by which an item's windows are counted."""
    canonical = Canonical()
    for keys, texts in _spans(batches, sizes is None):
        usual, broad, literal, low, text = canonical.of(texts)
        begin = np.searchsorted(text, np.arange(len(texts)))
        for n in [min(size, len(low))] if sizes is None else sizes:
            if not 0 < n <= len(low):
                continue
            inside = text[n - 1 :] == text[: len(text) - n + 1]
            own = windows(usual.word, n)
            good = inside & (usual.plain(n) >= PLAIN) if n == size else inside
            rows = [(USUAL, own, usual, good)]
            if n == size:
                h = windows(broad.word, n)
                rows.append((BROAD, h, broad, good & (h != own) & (broad.plain(n) >= LOOSE)))
            h = windows(literal.word, n)
            good_literal = inside & (literal.plain(n) >= PLAIN) if n == size else inside
            rows.append((LITERAL, h, literal, (good if sizes is None else good_literal) & (h != own)))
            if n == size:
                exact = windows(low, n) ^ _EXACT
                # an item that has other windows isn't measured by these
                dense = inside & (usual.plain(n) < PLAIN) if sizes is not None or not good.any() and (usual.slot == 0).any() else np.zeros(len(own), bool)
                rows.append((EXACT, exact, Reading(low, np.zeros_like(low)), dense))
            for reading, h, of, ok in rows:
                at = np.flatnonzero(ok)
                at = at[wanted(h[at])] if wanted else at
                if not len(at):
                    continue
                slots = of.slot[at[:, None] + np.arange(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([keys[k] for k in text[at].tolist()], pa.int64()), pa.array((at - begin[text[at]]).astype(np.int32)), pa.array(np.full(len(at), n, np.int32)),
                    pa.array(h[at].view(np.int64)), pa.array([x.tobytes() for x in slots], pa.binary()), pa.array(np.full(len(at), reading, np.int32)),
                    pa.array((h if reading == EXACT else own)[at].view(np.int64))], schema=_PLACES)


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id",
            item_text: str = "text", size: int = WINDOW, share: float = SHARE) -> DataFrame:
    """Contaminated documents: doc_id, item_id, n_windows (of the item, found), share, kind (copy or template).

    One row per document and item of which some alignment (place in the document minus place in the item) holds at
    least `share` of the item's different windows, each item value in a slot always meeting one document value.
    kind is copy if no slot differs. Places may drift by inserted or lost words: alignments within `size` of the
    next one count as one. Items without a word, null texts and null items match nothing; rows with a null id are
    left out of the result, rows that repeat an id count as one document. No document or no item, no rows.

    Texts are read once. The windows of the benchmark, if there are at most FILTER of them, also go to the tasks to
    keep windows that occur in no item out of the shuffle; a larger benchmark is joined without that filter.
    """
    def keyed(df: DataFrame, k: str, t: str) -> DataFrame:
        return df.select(F.col(k).cast("long").alias("id"), F.col(t).cast("string").alias("text")).where("id is not null")

    first = save(keyed(benchmark, item, item_text).mapInArrow(lambda it: _places(it, size, None, None), PLACES))
    items = first.groupBy(F.col("id").alias("item_id"), "window", "size", "own", F.col("reading").alias("kind")).agg(F.min(F.struct("place", "slots")).alias("x"))
    n_item = first.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("own").alias("n_item"))
    items = save(items.join(n_item, "item_id").select("item_id", "n_item", "window", "size", "own", "kind", F.col("x.place").alias("ip"), F.col("x.slots").alias("was")))
    shapes = sorted(r["size"] for r in items.select("size").distinct().collect())
    distinct = items.select("window").distinct()
    wanted = None
    if distinct.count() <= FILTER:
        keys = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r["window"] for r in distinct.collect()], np.int64)))

        def wanted(hashed: np.ndarray) -> np.ndarray:
            table, x = keys.value, hashed.view(np.int64)
            return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x if len(table) else np.zeros(len(x), bool)

    found = keyed(docs, key, text).mapInArrow(lambda it: _places(it, size, shapes, wanted), PLACES).drop("own")
    pairs = found.withColumnRenamed("id", "doc_id").join(items, ["window", "size"])
    pairs = pairs.select("doc_id", "item_id", "n_item", "own", "kind", (F.greatest("kind", "reading") == USUAL).alias("usual"), "was", "slots", (F.col("place") - F.col("ip")).alias("shift"))
    order = W.partitionBy("doc_id", "item_id").orderBy("shift")
    apart = F.coalesce((F.col("shift") - F.lag("shift").over(order) > size).cast("int"), F.lit(0))
    pairs = pairs.withColumn("apart", apart).withColumn("run", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    # of a window's readings the broad one says most about what changed
    rank = F.when(F.col("kind") == BROAD, -1).otherwise(F.col("kind"))
    differs = (F.col("was") != F.col("slots")).alias("differs")
    windows_found = pairs.groupBy("doc_id", "item_id", "run", "n_item", "own").agg(
        F.min(F.struct(rank.alias("rank"), differs, "was", "slots")).alias("x"), F.min(F.when(F.col("usual"), F.struct(differs, "was", "slots"))).alias("y"))
    runs = windows_found.groupBy("doc_id", "item_id", "run", "n_item").agg(
        F.count("*").alias("n"), F.count("y").alias("n_usual"), F.max("x.differs").alias("differs"), F.max("y.differs").alias("differs_usual"),
        F.collect_list(F.struct("x.was", "x.slots")).alias("slots"), F.collect_list(F.when(F.col("y").isNotNull(), F.struct("y.was", "y.slots"))).alias("slots_usual"),
    ).where(F.col("n") >= share * F.col("n_item"))

    def fits(pairs: list[dict]) -> bool:
        was = np.frombuffer(b"".join(s["was"] for s in pairs), np.uint64)
        now = np.frombuffer(b"".join(s["slots"] for s in pairs), np.uint64)
        return len(set(zip(was.tolist(), now.tolist(), strict=True))) == len(set(was.tolist()))

    def consistent(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                row = {k: r[k] for k in ("doc_id", "item_id")}
                if fits(r["slots"]):
                    out.append({**row, "n_windows": r["n"], "share": r["n"] / r["n_item"], "differs": r["differs"]})
                if r["n_usual"] >= share * r["n_item"] and fits(r["slots_usual"]):
                    out.append({**row, "n_windows": r["n_usual"], "share": r["n_usual"] / r["n_item"], "differs": r["differs_usual"]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("share", pa.float64()), ("differs", pa.bool_())]))

    out = runs.mapInArrow(consistent, "doc_id long, item_id long, n_windows long, share double, differs boolean")
    top = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_windows", "share", (~F.col("differs")).alias("copy"))).alias("x"))
    return top.select("doc_id", "item_id", "x.n_windows", "x.share", F.when(F.col("x.copy"), "copy").otherwise("template").alias("kind"))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, with all their columns, whose id has no match; rows with a null id stay."""
    return by_id(docs, key, matches(docs, benchmark, key=key, **how).select("doc_id"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
