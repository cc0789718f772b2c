"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import base64
import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cuesheet.llm.common import save

CAPACITY = 2048
SEPARATOR = 0
CACHE = 400_000
_BREAK = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")
PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("task", T.IntegerType()), T.StructField("rank", T.LongType()),
])


class Encoder:
    """Byte-level BPE ids of a text as little-endian 32-bit numbers, through a bounded cache of its pieces.

    Before a space that follows a non-space, every earlier token has ended and no later one looks back, so the
    parts between such spaces can be encoded, and cached, alone. A text that spells a special token goes whole
    through the tokenizer file.
    """

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken

        vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        self.vocabulary = vocabulary
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.vocabulary)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cache) > CACHE:
            self.cache.clear()
        parts = _BREAK.split(text) if _RUN.search(text) else text.split(" ")
        cache = self.cache
        head = np.array(self.fast.encode_ordinary(parts[0]), "<u4").tobytes()
        try:
            return head + b"".join([cache[x] for x in parts[1:]])
        except KeyError:
            for x in parts[1:]:
                if x not in cache:
                    cache[x] = np.array(self.fast.encode_ordinary(" " + x), "<u4").tobytes()
            return head + b"".join([cache[x] for x in parts[1:]])


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of the pieces of one document; only a longer one is cut, its first piece may be shorter."""
    n = len(ids) // 4
    first = (n % capacity or capacity) if n > capacity else n
    yield 0, ids[: 4 * first]
    for at in range(first, n, capacity):
        yield at, ids[4 * at : 4 * (at + capacity)]


def _tokenise(batches: Iterable[pa.RecordBatch], keep_ids: bool, capacity: int, vocabulary: str | None) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, encoder, ranks = TaskContext.get().partitionId(), Encoder(vocabulary), defaultdict(int)
    zero = np.array([SEPARATOR], "<u4").tobytes()
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
        ("ids", pa.binary()), ("task", pa.int32()), ("rank", pa.int64()),
    ])
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            for k, (start, ids) in enumerate(cut(encoder.ids(text.as_py() or "") + zero, capacity)):
                n = len(ids) // 4
                rows.append((doc, k, start, n, zlib.crc32(ids), ids if keep_ids else None, task, ranks[n]))
                ranks[n] += 1
        cols = list(zip(*rows, strict=True)) or [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def fullest(available: dict[int, int], room: int) -> list[int]:
    """Lengths, longest first, whose sum is the largest that fits in room; a bitset holds the reachable sums.

    Lengths are taken in descending order and each keeps the sums reachable with it and those before it, so the
    way back finds the combination that leans on the longest lengths.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    full = 1 << room
    for n in sorted((n for n in available if n <= room and available[n]), reverse=True):
        for _ in range(min(available[n], room // n)):
            more = (reach | reach << n) & mask
            if more == reach:
                break
            steps.append((n, reach))
            reach = more
        if reach & full:
            break
    at, out = reach.bit_length() - 1, []
    for n, before in reversed(steps):
        if not before >> at & 1:
            out.append(n)
            at -= n
    return out


def patterns(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins) by minimum bin slack.

    Every bin starts with the longest length left and takes the combination that leaves least slack. A found
    combination is repeated while its lengths last, so the work follows the number of different lengths (at most
    the capacity) and not the number of pieces.
    """
    left, out = {n: c for n, c in histogram.items() if c > 0}, []
    while left:
        seed = max(left)
        left[seed] -= 1
        combination = sorted([seed, *fullest(left, capacity - seed)], reverse=True)
        left[seed] += 1
        need: dict[int, int] = defaultdict(int)
        for n in combination:
            need[n] += 1
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((combination, times))
    return out


def slots(found: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """Per length: rows (first rank, first sequence, slots a sequence, offset of the first) by first rank.

    A pattern lists equal lengths side by side. A length that occurs k times in a pattern takes k ranks a sequence; its copies stand side by side.
    """
    rank: dict[int, int] = defaultdict(int)
    out: dict[int, list] = defaultdict(list)
    sequence = 0
    for combination, times in found:
        offset, k = 0, 0
        while k < len(combination):
            n = combination[k]
            same = combination.count(n)
            out[n].append((rank[n], sequence, same, offset))
            rank[n] += same * times
            offset += n * same
            k += same
        sequence += times
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY, keep_ids: bool = False,
         vocabulary: str | None = None) -> DataFrame:
    """Pack every document into sequences of at most capacity tokens, gapless from offset 0.

    A document is its ids (null text: none) and one separator; rows with a null or repeated key are packed like
    any other. Columns: the key as doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids (little-endian
    unsigned 32-bit) if asked for. No document, no rows.

    One pass encodes the texts; the histogram of lengths, at most capacity rows, is packed on the driver and its
    slots, at most a few per length and pattern, go back with the second pass over the table of pieces.
    """
    made = save(
        docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(lambda it: _tokenise(it, keep_ids, capacity, vocabulary), PIECES)
    )
    per_task = made.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    first = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(slots(patterns(histogram, capacity)))

    def place(batches):
        for batch in batches:
            n, r = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for size in np.unique(n):
                at, rows = np.flatnonzero(n == size), table.value[size]
                hit = rows[np.searchsorted(rows[:, 0], r[at], "right") - 1]
                step = r[at] - hit[:, 0]
                seq[at] = hit[:, 1] + step // hit[:, 2]
                off[at] = hit[:, 3] + step % hit[:, 2] * size
            keep = [batch.column(c) for c in batch.schema.names if c != "_rank"]
            names = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    ranked = made.join(first, ["length", "task"]).select(*columns, (F.col("rank") + F.col("first")).alias("_rank"))
    schema = T.StructType([*(ranked.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)
