"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words one edit apart have reduced words that are equal or one edit apart, so the
reduced vocabulary is joined with the one-edit neighbourhoods of its own reduced words, and only the pairs found
are compared letter by letter. Neighbourhoods are generated from one side of each unordered pair: a reduced word
yields all deletions, which meet the insertions of the other side, and all replacements by a smaller symbol. They
travel as 64-bit hashes; a collision adds a pair to compare and never loses one.

A reduced word that too many words share is not expanded into pairs. It and its reduced neighbours go on to
an alphabet of twice as many symbols, at last to the letters themselves, where a reduced word is one word.

Defined cases. A null text has no words; a null doc_id is the empty id before the colon. Repeated rows count as often
as they stand there. Ties between near words of equal n go to the smaller in code-point order. No words, no rows. Other
columns of documents are not read, so their names can't clash. A very long text is a span of its
own and needs some twenty times its size; a very long word is hashed in steps, and its neighbours are 8 bytes each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import attach, drop, read, save
from cuesheet.llm.words import mix, words

FLUSH = 300_000
STEPS = 64
_BYTES = np.arange(256)
_ASCII = (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]
#: Symbols of the first alphabet, and the most words a reduced word may stand for before it goes on to a finer one.
SYMBOLS, CROWD = 6, 64
#: Letters whose neighbourhoods are made at once.
CHUNK = 1 << 16


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF, which UTF-8 writes as C3 and one byte more."""
    after = np.append(False, data[:-1] == 0xC3)
    return _ASCII[data] | (data == 0xC3) | after


def _remainders() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, t >> np.uint32(1) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


def _crc32(data: np.ndarray, start: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """crc32 of every run, continued from before; longest runs first, so the runs that go on are always a prefix."""
    order = np.argsort(-size, kind="stable")
    at, length, state, table = start[order], size[order], before[order] ^ np.uint32(0xFFFFFFFF), _remainders()
    long = int(np.searchsorted(-length, -STEPS, "left"))  # the few longer than STEPS
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + length[i]].tobytes(), int(before[order[i]])) ^ 0xFFFFFFFF
    for j in range(int(length[long]) if long < len(length) else 0):
        to = int(np.searchsorted(-length, -j, "left"))
        part = state[long:to]
        state[long:to] = table[(part ^ data[at[long:to] + j]) & np.uint32(255)] ^ part >> np.uint32(8)
    out = np.empty(len(size), np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def spelled(ids: list[str], column: pa.Array, one_in: int = 97) -> Iterator[tuple[list[str], list[int]]]:
    """Per span of texts: words and their counts, where a word is a run of letters, A-Z lowered, without the letter
    that the crc32 of id and run names, if any. Runs are told apart by 64-bit hashes (see words)."""
    for w in words(column, inside=_letters):
        low = _LOWER[w.data]
        size = w.end - w.start
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids[w.first : w.first + w.texts]], np.uint32)
        crc = _crc32(low, w.start, size, before[w.doc])
        cut = np.flatnonzero(crc % one_in == 0)
        whole = np.flatnonzero(crc % one_in)
        _, first, count = np.unique(w.hashes(lower=True)[whole], return_index=True, return_counts=True)
        text = low.tobytes()
        found = [text[a:b].decode() for a, b in zip(w.start[whole][first].tolist(), w.end[whole][first].tolist(), strict=True)]
        counts = count.tolist()
        for a, b, h in zip(w.start[cut].tolist(), w.end[cut].tolist(), crc[cut].tolist(), strict=True):
            run = text[a:b].decode()
            found.append(run[: h % len(run)] + run[h % len(run) + 1 :])
            counts.append(1)
        yield found, counts


def vocabulary(docs: DataFrame, text: str = "text", shortest: int = 5, least: int = 3) -> DataFrame:
    """Columns word, n: words of at least `shortest` code points and `least` occurrences.

    Tasks count what they read and hand their counts on whenever they hold FLUSH different words.
    """

    def batch(counts: Counter) -> pa.RecordBatch:
        kept = {w: n for w, n in counts.items() if len(w) >= shortest}
        return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for found, n in spelled([i or "" for i in b.column(0).to_pylist()], b.column(1)):
                for w, k in zip(found, n, strict=True):
                    counts[w] += k
                if len(counts) > FLUSH:
                    yield batch(counts)
                    counts = Counter()
        yield batch(counts)

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least)


def alphabet(symbols: int) -> np.ndarray:
    """Symbol of every code point below 256; with as many symbols as letters every letter is its own."""
    out = np.zeros(256, np.int64)
    for i, c in enumerate(LETTERS):
        out[ord(c)] = i if symbols >= len(LETTERS) else (i * 40503 % 65536) * symbols // 65536
    return out


_R = 0x9E3779B97F4A7C15 // 8 * 8 + 5
_RI = pow(_R, -1, 1 << 64)


def _values(symbols: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _close(h: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h + np.uint64(0xA24BAED4963EE407) * np.asarray(length, np.uint64))


class Reduced:
    """Hashes of words over a reduced alphabet and of their neighbours, many words at once."""

    def __init__(self, symbols: int):
        self.count = min(symbols, len(LETTERS))
        self.symbol, self.value = alphabet(symbols), _values(self.count)

    def _terms(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Per letter: its symbol, its word, its power, the sum of the word's terms up to and with it; per word: length, whole sum."""
        size = np.array([len(w) for w in words], np.int64)
        s = self.symbol[np.frombuffer("".join(words).encode("latin-1"), np.uint8)]
        word, first = np.repeat(np.arange(len(words)), size), np.cumsum(size) - size
        powers = np.ones(int(size.max(initial=0)) + 1, np.uint64)
        powers[1:] = np.cumprod(np.full(len(powers) - 1, _R, np.uint64), dtype=np.uint64)
        power = powers[np.arange(len(s)) - first[word]]
        total = np.append(np.uint64(0), np.cumsum(self.value[s] * power, dtype=np.uint64))
        upto = total[1:] - total[first][word]
        return s, word, power, upto, size, total[first + size] - total[first]

    def own(self, words: list[str]) -> np.ndarray:
        *_, size, whole = self._terms(words)
        return _close(whole, size)

    def around(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word and hash of the one-edit neighbourhoods, one side of each unordered pair: deletions, smaller replacements, itself."""
        s, word, power, upto, size, whole = self._terms(words)
        run = np.append(True, (s[1:] != s[:-1]) | (word[1:] != word[:-1]))[: len(s)]
        at = np.flatnonzero(run)  # deleting any symbol of a run gives the same word
        own = self.value[s[at]] * power[at]
        gone = _close(upto[at] - own + (whole[word[at]] - upto[at]) * np.uint64(_RI), size[word[at]] - 1)
        place = np.repeat(np.arange(len(s)), s)
        to = np.arange(len(place)) - np.repeat(np.cumsum(s) - s, s)
        changed = _close(whole[word[place]] + (self.value[to] - self.value[s[place]]) * power[place], size[word[place]])
        return np.concatenate([np.arange(len(words)), word[at], word[place]]), np.concatenate([_close(whole, size), gone, changed])


def _with_key(words: DataFrame, symbols: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(reduced.own(b.column("word").to_pylist()).view(np.int64))], [*b.schema.names, "key"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long")


def _edges(classes: DataFrame, symbols: int) -> DataFrame:
    """Columns key, size, other, other_size of reduced words that are equal or one edit apart, each unordered pair once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reduced = Reduced(symbols)
        for b in batches:
            key, size, words = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            ends = np.cumsum([len(w) for w in words])
            at = 0
            while at < len(words):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
                word, near = reduced.around(words[at:to])
                yield pa.RecordBatch.from_arrays([pa.array(key[at:to][word]), pa.array(size[at:to][word]), pa.array(near.view(np.int64))], ["key", "size", "other"])
                at = to

    # the vocabulary is small beside its neighbourhoods, so it is dealt out first
    classes = classes.repartition(max(1, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    near = classes.select("key", "size", "word").mapInArrow(run, "key long, size long, other long")
    return near.join(classes.select(F.col("key").alias("other"), F.col("size").alias("other_size")), "other")


def near_pairs(words: DataFrame, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """Columns a, na, b, nb: every unordered pair of different words exactly one edit apart, once. words: word, n, distinct."""
    found, todo = None, words
    while True:
        last = symbols >= len(LETTERS)
        keyed = save(_with_key(todo, symbols))
        classes = save(keyed.groupBy("key").agg(F.count("*").alias("size"), F.min("word").alias("word")))
        edges = save(_edges(classes, symbols))
        light = edges if last else edges.where((F.col("size") <= crowd) & (F.col("other_size") <= crowd))
        one = keyed.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
        two = keyed.select(F.col("key").alias("other"), F.col("word").alias("b"), F.col("n").alias("nb"))
        pairs = light.select("key", "other").join(one, "key").join(two, "other")
        pairs = pairs.where(((F.col("key") != F.col("other")) | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        pairs = save(pairs.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"),
                                  F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb")))
        found = pairs if found is None else found.unionByName(pairs).distinct()
        crowded = edges.where((F.col("size") > crowd) | (F.col("other_size") > crowd))
        crowded = save(crowded.select("key").unionByName(crowded.select(F.col("other").alias("key"))).distinct())
        if last or crowded.isEmpty():
            return found
        todo = save(keyed.join(crowded, "key", "left_semi").select("word", "n"))
        drop(keyed, classes, edges, crowded)
        symbols *= 2


def roots(forms: DataFrame) -> DataFrame:
    """Columns word, root: the end of the chain word -> form, by pointer doubling; forms has word and a form that isn't null.

    n at least doubles along a chain, so a chain has at most 63 links and six rounds suffice.
    """
    now = save(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = save(attach(now, "root", on))
        moved = step.where(F.col("further").isNotNull()).isEmpty()
        if moved:
            return now
        after = save(step.select("word", F.coalesce("further", "root").alias("root")))
        drop(now, step)
        now = after


def variants(words: DataFrame, ratio: int = 2, symbols: int = SYMBOLS, crowd: int = CROWD) -> DataFrame:
    """Columns word, form, root, n, n_near, form_n: one row per word of a vocabulary (word, n)."""
    words = save(words.select("word", "n"))
    pairs = near_pairs(words, symbols, crowd)
    both = pairs.select(F.col("a").alias("word"), "na", F.col("b").alias("other"), "nb").unionByName(
        pairs.select(F.col("b").alias("word"), F.col("nb").alias("na"), F.col("a").alias("other"), F.col("na").alias("nb")))
    near = save(both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), F.col("other"))).alias("best"), F.first("na").alias("own")
    ).select("word", "n_near", F.when(-F.col("best.m") >= ratio * F.col("own"), F.col("best.other")).alias("form"), (-F.col("best.m")).alias("best_n")))
    ends = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("form").isNotNull(), F.col("best_n")).alias("form_n"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(read(spark, sf_dir, "documents")))


#: crc32 by its polynomial, bit by bit, over a table of 256 remainders that the first CTE derives.
SQL = """
WITH RECURSIVE
remainders AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents
),
bytes AS (
  SELECT run, list_transform(string_split(regexp_replace(hex(encode(id || ':' || run)), '(..)', '\\1 ', 'g'), ' ')[:-2], lambda x: CAST('0x' || x AS BIGINT)) AS b FROM runs
),
hashed AS (
  SELECT run, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]), 4294967295), 4294967295) AS h FROM bytes, remainders
),
spelled AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed
),
vocabulary AS (SELECT word, count(*) AS n FROM spelled WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
gaps AS (
  SELECT word, n, CAST(p AS INT) AS p, substr(word, 1, CAST(p AS INT) - 1) || substr(word, CAST(p AS INT) + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM vocabulary)
),
near AS (
  SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT DISTINCT a.word, a.n, v.word, v.n FROM gaps a JOIN vocabulary v ON a.rest = v.word
  UNION SELECT DISTINCT v.word, v.n, a.word, a.n FROM gaps a JOIN vocabulary v ON a.rest = v.word
),
best AS (SELECT word, n, count(*) AS n_near, min(struct_pack(k := -m, w := other)) AS top FROM near GROUP BY word, n),
formed AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN -b.top.k >= 2 * v.n THEN b.top.w END AS form,
    CASE WHEN -b.top.k >= 2 * v.n THEN -b.top.k END AS form_n
  FROM vocabulary v LEFT JOIN best b ON v.word = b.word
),
chain AS (
  SELECT word, word AS at_word, form AS next FROM formed
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.at_word AS root, CAST(f.n AS BIGINT) AS n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
