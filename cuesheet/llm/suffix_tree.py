"""Language-model scores from a probabilistic suffix tree over words.

A context (the last one to `depth` tokens, the mark before a text's first word included) is a candidate if it occurs
`least` times in training, an absolute count, so the tree grows with the corpus. It stays if the smoothed distribution
of its next token diverges from that of its longest kept suffix. A token is scored by its longest kept context,
interpolated with all shorter kept ones down to the unigram base.

The tree is cut by the last words of its contexts. All contexts that end in the same word lie in one shard, so a block
of documents sends each of its windows (context words, next token, text, probability so far) to one shard, which counts,
tests and scores the whole chain of suffixes and passes on what the windows add to the score of each text. A context
that owns more windows than a shard may hold is hot: it is counted in shards of the next token instead, and the windows
behind it are cut by one word more. At most HOT contexts of a length are hot, whatever the corpus; only they are collected.

The shards take turns: a pass sends the windows of one shard in PASSES, adds up their sums by text and frees its shuffles
before the next pass starts, so the windows of the whole corpus never lie on disk at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import drop, read, save
from cuesheet.llm.words import mix, words

#: Training occurrences that a context needs.
LEAST = 2
#: Longest context, in tokens.
DEPTH = 3
#: Tokens of documents for one shard of the tree; a context with more than twice as many is hot. At most so many are, of a length.
WINDOWS = 1_000_000
HOT = 100_000
#: Turns in which the shards are worked off.
PASSES = 4
#: Bits by which a kept context's next token must differ from its suffix's.
DIVERGENCE = 0.02
DISCOUNT = 0.75
HELD = 1
BLOCK_BYTES = 8 << 20
#: Distinct words, summed over the blocks, of one shard; its pairs are a few times as many.
SHARD = 250_000
END = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0x9E3779B97F4A7C15)

_BLOCK = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())),
    ("vocab", pa.binary()), ("train", pa.binary()), ("tokens", pa.binary()), ("types", pa.int64()),
])
_PART = pa.schema([
    ("r", pa.int32()), ("block", pa.int64()), ("depth", pa.int32()), ("token", pa.binary()), ("context", pa.binary()), ("count", pa.binary()), ("n", pa.int64()), ("id", pa.binary()),
])
PART = "r int, block long, depth int, token binary, context binary, count binary, n long, id binary"
_READY = pa.schema([
    ("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("held", pa.list_(pa.bool_())), ("sums", pa.list_(pa.binary())),
    ("tokens", pa.binary()), ("words", pa.list_(pa.binary())), ("hot", pa.list_(pa.binary())),
])
READY = "block long, ids array<long>, sizes array<int>, held array<boolean>, sums array<binary>, tokens binary, words array<binary>, hot array<binary>"
_ASK = pa.schema([("r", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("train", pa.int64()), ("columns", pa.list_(pa.binary()))])
ASK = "r int, block long, n long, train long, columns array<binary>"
REPLY = ["block", "depth", "r", "count", "n", "id"]


def _pack(a: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _narrow(a: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs."""
    top = int(a.max(initial=0))
    return _pack(a, next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << 8 * int(k[2])))


def _wide(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}" if n else "<u1").astype(np.int64)


def _squeeze(a: np.ndarray) -> bytes:
    """Numbers from 0 on or doubles, byte plane by byte plane, compressed."""
    real = a.dtype.kind == "f"
    raw = np.frombuffer(_pack(a, "<f8") if real else _narrow(a), np.uint8).reshape(len(a), -1 if len(a) else 1)
    return bytes([raw.shape[1], real]) + zstandard.ZstdCompressor(1).compress(raw.T.tobytes())


def _loose(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[2:]), np.uint8)
    raw = raw.reshape(blob[0], -1).T.tobytes()
    return np.frombuffer(raw, "<f8") if blob[1] else np.frombuffer(raw, f"<u{blob[0]}" if blob[0] < 8 else "<i8")


def _held(key) -> bool:
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == HELD


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task, seq = TaskContext.get().partitionId(), 0
    for b in batches:
        ids = b.column(0).to_pylist()
        for w in words(b.column(1), BLOCK_BYTES):
            mine = ids[w.first : w.first + w.texts]
            held = np.array([_held(x) for x in mine], bool)
            sizes = w.count + 1
            tokens = np.full(int(sizes.sum()), END, np.uint64)
            place = np.ones(len(tokens), bool)
            place[np.cumsum(sizes) - 1] = False
            tokens[place] = w.hashes(lower=True)
            vocab, local = np.unique(tokens, return_inverse=True)
            train = np.bincount(local[np.repeat(~held, sizes)], minlength=len(vocab))
            row = {"block": task << 24 | seq, "ids": mine, "sizes": sizes.tolist(), "held": held.tolist(), "vocab": _pack(vocab, "<u8"),
                   "train": _pack(train, "<i4"), "tokens": _squeeze(local), "types": len(vocab)}
            seq += 1
            yield pa.RecordBatch.from_pylist([row], _BLOCK)


def _shards(token: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the shards' slices of ascending token hashes; shard r holds hashes from r / n of the range on."""
    edges = np.array([(r << 64) // n for r in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(token, edges), [len(token)]))


@dataclass
class Level:
    """Contexts of one length, ascending by hash; parent: hash of the suffix that is one shorter."""

    hash: np.ndarray
    parent: np.ndarray
    n: np.ndarray = field(default_factory=lambda: np.zeros(0))
    types: np.ndarray = field(default_factory=lambda: np.zeros(0))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))


def _find(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of every x in an ascending table, -1 if it isn't there."""
    if not len(table):
        return np.full(len(x), -1, np.int64)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return np.where(table[at] == x, at, -1)


@dataclass
class Windows:
    """Rows, ascending by shard: the shard and the columns (context words' ids from the last on, token's id, twice the length
    of the first context that isn't hot and whether one was used, text's number, how often, probability so far). Texts of
    the training come first by number. count: training count of every row's token."""

    shard: np.ndarray
    columns: list[np.ndarray]
    count: np.ndarray

    def packed(self, i: int, j: int) -> list[bytes]:
        """Rows i to j. The token and, if it isn't the base, the probability are places in tables of their own."""
        *columns, p = (c[i:j] for c in self.columns)
        token = len(columns) - 4
        tokens, one, columns[token] = np.unique(columns[token], return_index=True, return_inverse=True)
        prior, place = np.unique(np.where(columns[token + 1] < 4, 0.0, p), return_inverse=True)
        return [_squeeze(x) for x in (*columns, place, tokens, self.count[i:j][one], prior)]


def _unpacked(blobs: list[bytes], model: Model) -> list[np.ndarray]:
    """The columns again, with the probability so far as the last one."""
    *columns, place, tokens, count, prior = map(_loose, blobs)
    token = len(columns) - 4
    local, p = columns[token], prior[place]
    columns[token] = tokens[local]
    return [*columns, np.where(columns[token + 1] < 4, model.unigram(count.astype(np.float64))[local], p)]


class Block:
    """A block's tokens with, for each depth, the pairs that it asks for."""

    def __init__(self, row: dict):
        self.vocab, self.sizes = np.frombuffer(row["vocab"], "<u8"), np.array(row["sizes"], np.int64)
        self.local = _loose(row["tokens"])
        self.held = np.array(row["held"], bool)
        base = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(len(self.local)) - np.repeat(base, self.sizes)

    def ready(self, got: dict[int, list[dict]], model: Model) -> dict[str, list[bytes]]:
        """What is known without the tree. sums: known tokens, tokens scored by a hot context, base and score of each text;
        words: ids and counts of the vocabulary; hot: per token the length of the first context that isn't hot and whether
        one was used, and the probabilities of the tokens behind hot contexts as places in a table."""
        count = np.concatenate([_counts(r["count"], r["n"]) for r in got[0]])
        ids = np.concatenate([_wide(r["id"], r["n"]) for r in got[0]])
        p = model.unigram(count)[self.local]
        base = np.cumsum(self.sizes) - self.sizes
        known, plain = np.add.reduceat((count > 0)[self.local], base, dtype=np.int64), np.add.reduceat(np.log10(p), base)
        first = np.full(len(p), 2, np.uint8)
        for d, level in enumerate(model.levels, 1):
            at, pair, _, context, _ = self.pairs(d, level)
            if not len(at):
                continue
            first[at] = 2 * (d + 1) + (first[at] & 1)
            here = level.kept[context[pair]]
            at, pair = at[here], pair[here]
            p[at] = interpolate(p[at], level, context[pair], np.concatenate([_counts(r["count"], r["n"]) for r in got[d]])[pair])
            first[at] |= 1
        used, score = np.add.reduceat(first & 1, base, dtype=np.int64), np.add.reduceat(np.log10(p), base)
        prior, place = np.unique(p[first >= 4], return_inverse=True)
        return {"sums": [_pack(known, "<i8"), _pack(used, "<i8"), _pack(plain, "<f8"), _pack(score, "<f8")],
                "words": [_squeeze(ids), _squeeze(count.astype(np.int64))], "hot": [_squeeze(first), _squeeze(prior), _squeeze(place)]}

    def windows(self, words: list[bytes], hot: list[bytes], model: Model, least: int, depth: int, shards: int, passes: int = 1, turn: int = 0) -> Windows:
        """What the block tells the tree: the windows of its texts for the shards whose turn it is, shard by shard."""
        ids, count = (_loose(x).astype(np.int64) for x in words)
        first, prior, place = map(_loose, hot)
        # places of the vocabulary by id, from 1 on; 0 ends a context: before the text, or a word too rare for any
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(1, len(ids) + 1)
        by_rank = np.concatenate(([0], ids[order]))
        word = np.where(count >= least, rank, 0).astype(np.int32)
        here = np.concatenate((word[self.local[-1:]], word[self.local]))  # the last token ends a text
        # the shard follows from the shortest context that isn't hot; a window that doesn't reach it has none
        back, h, reach = [], np.zeros(len(self.local), np.uint64), np.zeros(len(self.local), np.uint8)
        hashed = by_rank.astype(np.uint64)
        for d in range(1, depth + 1):
            before = np.zeros(len(self.local), np.int32)
            before[d - 1 :] = here[: len(here) - d]
            before[(self.place + 1 < d) | (reach < d - 1)] = 0
            reach += before > 0
            back.append(before)
            more = np.flatnonzero((first >> 1) >= d)
            h[more] = mix((h[more] + hashed[before[more]]) * _K)
        shard = (h % np.uint64(shards)).astype(np.int64)
        at = np.flatnonzero((reach >= first >> 1) & (shard % passes == turn))
        p = np.zeros(len(self.local))
        p[first >= 4] = prior[place]
        first, p, local, shard = first[at].astype(np.int64), p[at], self.local[at], shard[at]
        p = np.where(first < 4, model.unigram(count.astype(np.float64))[local], p)
        back, token = [b[at].astype(np.int64) for b in back], rank[local].astype(np.int64)
        number = np.empty(len(self.held), np.int64)
        number[np.argsort(self.held, kind="stable")] = np.arange(len(self.held))
        text = np.repeat(number.astype(np.int32), self.sizes)[at].astype(np.int64)
        bits = max(len(ids) + 1, len(number)).bit_length()
        codes = [shard]
        for k, x in enumerate([*back, token, text]):
            if k % (62 // bits) == 0:
                codes.append(np.zeros(len(at), np.int64))
            codes[-1] = codes[-1] << bits | x
        sort = np.lexsort(codes[::-1])
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = np.any([c[sort][1:] != c[sort][:-1] for c in codes], axis=0)
        one = sort[new]
        times = np.diff(np.flatnonzero(np.concatenate((new, [True]))))
        columns = [*(by_rank[b[one]] for b in back), by_rank[token[one]], first[one], text[one], times, p[one]]
        return Windows(shard[one], columns, count[local[one]])

    def pairs(self, depth: int, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions with a candidate context, their pair, then per pair: token, context, training count)."""
        h = np.concatenate(([END], self.vocab[self.local]))
        context = np.zeros(len(self.local), np.uint64)
        for back in range(depth, 0, -1):
            # the token `back` places before i is h[i + 1 - back]; places before the text's own end mark are not used
            before = np.roll(h, back - 1)[: len(self.local)]
            context = context * _K + before
        ok = self.place + 1 >= depth
        found = np.full(len(context), -1, np.int64)
        found[ok] = _find(level.hash, context[ok])
        at = np.flatnonzero(found >= 0)
        code = self.local[at].astype(np.int64) * len(level.hash) + found[at]
        code, pair = np.unique(code, return_inverse=True)
        count = np.bincount(pair[np.repeat(~self.held, self.sizes)[at]], minlength=len(code))
        return at, pair, self.vocab[code // max(1, len(level.hash))], code % max(1, len(level.hash)), count


def _send(block: int, depth: int, token: np.ndarray, context: np.ndarray, count: np.ndarray, shards: int) -> Iterator[dict]:
    cut = _shards(token, shards)
    for r in range(shards):
        i, j = cut[r], cut[r + 1]
        if i < j:
            yield {"r": r, "block": block, "depth": depth, "token": _pack(token[i:j], "<u8"), "context": _narrow(context[i:j]),
                   "count": _narrow(count[i:j]), "n": int(j - i)}


def _rows(table: pa.Table) -> list[dict]:
    return sorted(table.to_pylist(), key=lambda r: (r["depth"], r["block"]))


def _merge(table: pa.Table, shards: int) -> pa.Table:
    """Sum one shard's pairs. Out: per asking block the corpus counts of its pairs, and with block -1 the shard itself."""
    rows = _rows(table)
    token = np.concatenate([np.frombuffer(r["token"], "<u8") for r in rows])
    context = np.concatenate([_wide(r["context"], r["n"]) for r in rows])
    count = np.concatenate([_wide(r["count"], r["n"]) for r in rows])
    types, local = np.unique(token, return_inverse=True)
    width = int(context.max()) + 1
    code, pair = np.unique(local.astype(np.int64) * width + context, return_inverse=True)
    total = np.bincount(pair, count, len(code)).astype(np.int64)
    out, at = [], 0
    for r in rows:
        n = r["n"]
        out.append({"r": r["r"], "block": r["block"], "depth": r["depth"], "count": _narrow(total[pair[at : at + n]]), "n": n})
        at += n
    if rows[0]["depth"] == 0:
        # ids of words: frequent ones are small, and no other shard gives the same
        rank = np.empty(len(types), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(types))
        ids, at = rank * shards + rows[0]["r"] + 1, 0
        for o in out:
            o["id"] = _narrow(ids[pair[at : at + o["n"]]])
            at += o["n"]
    seen = total > 0
    out.append({"r": rows[0]["r"], "block": -1, "depth": rows[0]["depth"], "token": _pack(types[code[seen] // width], "<u8"),
                "context": _narrow(code[seen] % width), "count": _narrow(total[seen]), "n": int(seen.sum())})
    return pa.Table.from_pylist(out, _PART)


def _counts(blob: bytes, n: int) -> np.ndarray:
    return _wide(blob, n).astype(np.float64)


def interpolate(p: np.ndarray, level: Level, context: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Absolute discounting: what the discount takes from a context's seen tokens goes to its suffix's distribution."""
    n, types = level.n[context], level.types[context]
    return (np.maximum(count - DISCOUNT, 0) + DISCOUNT * types * p) / n


class Model:
    """Totals and the levels of hot contexts; small enough for a broadcast, since a level has at most HOT of them."""

    def __init__(self, tokens: int, types: int):
        self.tokens, self.types, self.levels = tokens, types, []

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.tokens + 0.5 * (self.types + 1))


def _chain(model: Model, shard: dict[int, dict], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the pairs of a shard at a depth: context, count, and the probability that the longest kept suffix gives."""
    uni, mine = shard[0], shard[depth]
    p = model.unigram(uni["count"][_find(uni["token"], mine["token"])])
    parents, at = [], mine["context"]
    for d in range(depth, 1, -1):
        level, shorter = model.levels[d - 1], model.levels[d - 2]
        at = _find(shorter.hash, level.parent[at])
        parents.append((d - 1, at))
    for d, context in reversed(parents):
        level, pairs = model.levels[d - 1], shard[d]
        width = len(level.hash)
        order = _find(uni["token"], pairs["token"]) * width + pairs["context"]
        hit = _find(order, _find(uni["token"], mine["token"]) * width + context)
        count = np.where(hit >= 0, pairs["count"][hit], 0)
        use = level.kept[context] & (context >= 0)
        p = np.where(use, interpolate(p, level, np.where(use, context, 0), count), p)
    return mine["context"], mine["count"], p


def _diverge(table: pa.Table, model: Model, depth: int) -> pa.Table:
    """Per context of the shard: seen part of the divergence in bits and the suffix's mass of the seen tokens."""
    shard = {r["depth"]: {"token": np.frombuffer(r["token"], "<u8"), "context": _wide(r["context"], r["n"]), "count": _counts(r["count"], r["n"])}
             for r in _rows(table)}
    schema = pa.schema([("context", pa.int64()), ("bits", pa.float64()), ("mass", pa.float64())])
    if depth not in shard or 0 not in shard:
        return pa.Table.from_pylist([], schema)
    context, count, parent = _chain(model, shard, depth)
    p = interpolate(parent, model.levels[depth - 1], context, count)
    bits, mass = (np.bincount(context, x) for x in (p * np.log2(p / parent), parent))
    at = np.flatnonzero(np.bincount(context))
    return pa.table([pa.array(at), pa.array(bits[at]), pa.array(mass[at])], schema=schema)


def _stats(batches, width: int):
    schema = pa.schema([("context", pa.int64()), ("n", pa.int64()), ("types", pa.int64())])
    for b in batches:
        for context, count, n in zip(b.column("context").to_pylist(), b.column("count").to_pylist(), b.column("n").to_pylist(), strict=True):
            c = _wide(context, n)
            total, types = np.bincount(c, _counts(count, n), width), np.bincount(c, minlength=width)
            at = np.flatnonzero(types)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at].astype(np.int64)), pa.array(types[at])], schema=schema)


def _longer(batches, level: Level, least: float):
    """Strings of a context and a token that are hot contexts themselves: hash, and hash without the first token."""
    schema = pa.schema([("hash", pa.int64()), ("parent", pa.int64())])
    for b in batches:
        for token, context, count, n in zip(*(b.column(c).to_pylist() for c in ("token", "context", "count", "n")), strict=True):
            t, c, k = np.frombuffer(token, "<u8"), _wide(context, n), _counts(count, n)
            good = (k >= least) & (t != END)
            t, c = t[good], c[good]
            yield pa.RecordBatch.from_arrays(
                [pa.array((level.hash[c] * _K + t).view(np.int64)), pa.array((level.parent[c] * _K + t).view(np.int64))], schema=schema)


def _asking(depth: int, level, shards: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                _, _, token, context, count = Block(r).pairs(depth, level.value)
                for x in _send(r["block"], depth, token, context, count, shards):
                    yield pa.RecordBatch.from_pylist([x], _PART)

    return run


def _only(model):
    """Hashes of words are only needed to find hot contexts, so those of other words become zero and compress."""
    def run(batches):
        for b in batches:
            k, hot = b.schema.get_field_index("vocab"), model.value.levels[0].hash if model.value.levels else np.zeros(0, np.uint64)
            vocab = (np.frombuffer(v, "<u8") for v in b.column(k).to_pylist())
            yield b.set_column(k, "vocab", pa.array([_pack(np.where(_find(hot, v) >= 0, v, np.uint64(0)), "<u8") for v in vocab], pa.binary()))

    return run


def _merging(shards: int):
    return lambda table: _merge(table, shards)


def _diverging(depth: int, model):
    return lambda table: _diverge(table, model.value, depth)


def _counting(width: int):
    return lambda batches: _stats(batches, width)


def _lengthening(level: Level, least: float):
    return lambda batches: _longer(batches, level, least)


def _replies(table: pa.Table) -> dict[int, list[dict]]:
    got: dict[int, list] = {}
    for r in sorted(table.to_pylist(), key=lambda r: (r["depth"], r["r"])):
        got.setdefault(r["depth"], []).append(r)
    return got


def _prepare(blocks: pa.Table, replies: pa.Table, model: Model) -> pa.Table:
    """A block with the answers to what it asked; no later step needs its words' hashes."""
    row = blocks.to_pylist()[0]
    ready = Block(row).ready(_replies(replies), model)
    return pa.Table.from_pylist([{k: row[k] for k in ("block", "ids", "sizes", "held", "tokens")} | ready], _READY)


def _telling(model, least: int, depth: int, shards: int, passes: int, turn: int):
    """A block's windows, one row per shard of this turn that has any."""
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                block = Block(row | {"vocab": b""})
                w = block.windows(row["words"], row["hot"], model.value, least, depth, shards, passes, turn)
                train = int((~block.held).sum())
                cut = [*np.flatnonzero(np.diff(w.shard, prepend=-1)), len(w.shard)]
                for at in range(0, len(cut) - 1, 64):
                    yield pa.RecordBatch.from_pylist([
                        {"r": int(w.shard[i]), "block": row["block"], "n": int(j - i), "train": train, "columns": w.packed(i, j)}
                        for i, j in pairwise(cut[at : at + 65])], _ASK)

    return run


def _tree(table: pa.Table, model: Model, least: int, depth: int, divergence: float) -> pa.Table:
    """One shard: count its windows, test its contexts from short to long, and sum what they add to the texts of each block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    *back, token, first, text, times, p = map(np.concatenate, zip(*(_unpacked(r.pop("columns"), model) for r in rows), strict=True))
    before = p
    fresh, first = 1 - (first & 1), first >> 1
    count = np.where(text < np.repeat([r["train"] for r in rows], [r["n"] for r in rows]), times, 0)
    _, token = np.unique(token, return_inverse=True)
    width = max(int(token.max()), *(int(b.max()) for b in back)) + 1
    group = np.zeros(len(token), np.int64)
    for b in back:
        _, group = np.unique(group * width + b, return_inverse=True)
    _, one, row = np.unique(group * width + token, return_index=True, return_inverse=True)
    count = np.bincount(row, count)
    back, token, first, p = [b[one] for b in back], token[one], first[one], p[one]
    used, group = np.zeros(len(one), bool), np.zeros(len(one), np.int64)
    for d, b in enumerate(back, 1):
        _, group = np.unique(group * width + b, return_inverse=True)
        _, at, pair = np.unique(group * width + token, return_index=True, return_inverse=True)
        c, context, parent = np.bincount(pair, count), group[at], p[at]
        seen = c > 0
        level = Level(np.zeros(0), np.zeros(0), np.bincount(context, c), np.bincount(context, seen))
        with np.errstate(divide="ignore", invalid="ignore"):
            q = interpolate(parent, level, context, c)
            bits = np.bincount(context, np.where(seen, q * np.log2(q / parent), 0))
            mass = np.bincount(context, np.where(seen, parent, 0))
            level.kept = (level.n >= least) & (diverges(level, bits, mass) >= divergence)
        use = level.kept[group] & (b > 0) & (d >= first)
        p, used = np.where(use, q[pair], p), used | use
    more, hit, at = (np.log10(p[row]) - np.log10(before)) * times, used[row] * fresh * times, 0
    out = []
    for r in rows:
        mine = slice(at, at + r["n"])
        texts, place = np.unique(text[mine], return_inverse=True)
        sums = [texts, np.bincount(place, hit[mine]).astype(np.int64), np.bincount(place, more[mine])]
        out.append({"r": r["r"], "block": r["block"], "n": len(texts), "columns": [_squeeze(x) for x in sums]})
        at += r["n"]
    return pa.Table.from_pylist(out, _ASK)


def _add(table: pa.Table) -> pa.Table:
    """The sums of all shards of a turn for a block's texts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["r"])
    parts = [[_loose(x) for x in r["columns"]] for r in rows]
    place, hit, add = map(np.concatenate, zip(*parts, strict=True))
    texts, place = np.unique(place, return_inverse=True)
    sums = [texts, np.bincount(place, hit).astype(np.int64), np.bincount(place, add)]
    return pa.Table.from_pylist([{"r": rows[0]["r"], "block": rows[0]["block"], "n": len(texts), "columns": [_squeeze(x) for x in sums]}], _ASK)


def diverges(level: Level, bits: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Divergence in bits: seen tokens' part, and that of the unseen, which all keep the same share of the suffix's probability."""
    rest = DISCOUNT * level.types / level.n
    return bits + np.maximum(0, 1 - mass) * rest * np.log2(rest)


def _hot(blocks: DataFrame, tables: list[DataFrame], model: Model, enough: float, depth: int, divergence: float, shards: int) -> None:
    """Add to the model the contexts that occur `enough` times, and to the tables their counts; one round for each length."""
    spark = blocks.sparkSession

    def frequent(batches):
        for b in batches:
            for token, count, n in zip(*(b.column(c).to_pylist() for c in ("token", "count", "n")), strict=True):
                t = np.frombuffer(token, "<u8")[_counts(count, n) >= enough]
                yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.zeros(len(t), np.int64))], ["hash", "parent"])

    found = tables[0].where("block = -1").mapInArrow(frequent, "hash long, parent long")
    for d in range(1, depth + 1):
        rows = found.distinct().collect()  # at most HOT
        if not rows:
            break
        hashes = np.array([r["hash"] for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        level = Level(hashes[order], np.array([r["parent"] for r in rows], np.int64).view(np.uint64)[order])
        sent = spark.sparkContext.broadcast(level)

        pairs = blocks.select("block", "sizes", "held", "vocab", "train", "tokens").mapInArrow(_asking(d, sent, shards), PART)
        tables.append(save(pairs.groupBy("r").applyInArrow(_merging(shards), PART)))
        merged, width = tables[-1].where("block = -1"), len(rows)
        level.n, level.types = np.zeros(width), np.zeros(width)
        for r in merged.mapInArrow(_counting(width), "context long, n long, types long").groupBy("context").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect():
            level.n[r["context"]], level.types[r["context"]] = r["n"], r["types"]
        model.levels.append(level)
        known = spark.sparkContext.broadcast(model)
        all_of = tables[0].where("block = -1")
        for t in tables[1:]:
            all_of = all_of.unionByName(t.where("block = -1"))
        bits, mass = np.zeros(width), np.zeros(width)
        parts = all_of.groupBy("r").applyInArrow(_diverging(d, known), "context long, bits double, mass double")
        for r in parts.groupBy("context").agg(F.sum("bits").alias("bits"), F.sum("mass").alias("mass")).collect():
            bits[r["context"]], mass[r["context"]] = r["bits"], r["mass"]
        with np.errstate(divide="ignore", invalid="ignore"):
            level.kept = (level.n > 0) & (diverges(level, bits, mass) >= divergence)
        found = merged.mapInArrow(_lengthening(level, enough), "hash long, parent long")


def score(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST, depth: int = DEPTH,
          divergence: float = DIVERGENCE, shard: int = SHARD, windows: int = WINDOWS, passes: int = PASSES) -> DataFrame:
    """Columns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_context; one row per row.

    Null texts are empty and have the end token alone; a null id counts as an empty text for the fold. n_context is
    the number of tokens scored with a kept context. A context needs `least` training occurrences. Without any training
    token every count is zero. `shard`, `windows` and `passes` say how the work is cut and don't change the model.
    """
    spark = docs.sparkSession
    one = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = save(one.mapInArrow(
        _blocks, "block long, ids array<long>, sizes array<int>, held array<boolean>, vocab binary, train binary, tokens binary, types long"))
    size = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    entries, length = blocks.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum(size), F.lit(0))).first()
    shards, parts = max(1, entries // shard), max(1, length // windows)

    def unigrams(batches):
        for b in batches:
            for r in b.to_pylist():
                vocab = np.frombuffer(r["vocab"], "<u8")
                for x in _send(r["block"], 0, vocab, np.zeros(len(vocab), np.int64), np.frombuffer(r["train"], "<i4"), shards):
                    yield pa.RecordBatch.from_pylist([x], _PART)

    tables = [save(blocks.select("block", "vocab", "train").mapInArrow(unigrams, PART).groupBy("r").applyInArrow(_merging(shards), PART))]

    def totals(batches):
        for b in batches:
            for count, n in zip(b.column("count").to_pylist(), b.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([int(_counts(count, n).sum())]), pa.array([n])], ["tokens", "types"])

    sums = tables[0].where("block = -1").mapInArrow(totals, "tokens long, types long")
    model = Model(*sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first())
    _hot(blocks, tables, model, max(model.tokens / HOT, 2 * windows, least), depth, divergence, shards)
    final = spark.sparkContext.broadcast(model)
    replies = tables[0].where("block >= 0").select(REPLY)
    for t in tables[1:]:
        replies = replies.unionByName(t.where("block >= 0").select(REPLY))
    coded = blocks.select("block", "ids", "sizes", "held", "tokens", "vocab").mapInArrow(
        _only(final), "block long, ids array<long>, sizes array<int>, held array<boolean>, tokens binary, vocab binary")
    ready = save(coded.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lambda a, b: _prepare(a, b, final.value), READY))
    drop(blocks, *tables)
    passes, sums = max(1, min(passes, parts)), []
    for turn in range(passes):
        told = ready.select("block", "sizes", "held", "tokens", "words", "hot").mapInArrow(_telling(final, least, depth, parts, passes, turn), ASK)
        found = told.groupBy("r").applyInArrow(lambda t: _tree(t, final.value, least, depth, divergence), ASK)
        sums.append(save(found.groupBy("block").applyInArrow(_add, ASK)))
    added = reduce(DataFrame.unionByName, sums)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_context long"
    texts = ready.select("block", "ids", "sizes", "held", "sums")
    return texts.groupBy("block").cogroup(added.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, model.tokens), schema)


def _score(texts: pa.Table, sums: pa.Table, train_tokens: int) -> pa.Table:
    """A block's texts with the sums of all turns."""
    own = texts.to_pylist()[0]
    held = np.array(own["held"], bool)
    number = np.empty(len(held), np.int64)
    number[np.argsort(held, kind="stable")] = np.arange(len(held))
    hits, more = np.zeros(len(held), np.int64), np.zeros(len(held))
    for r in sorted(sums.to_pylist(), key=lambda r: r["r"]):
        at, hit, add = map(_loose, r["columns"])
        hits[at] += hit
        more[at] += add
    known, used = (np.frombuffer(x, "<i8") for x in own["sums"][:2])
    base, score = (np.frombuffer(x, "<f8") for x in own["sums"][2:])
    return pa.table({
        "doc_id": pa.array(own["ids"], pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(np.array(own["sizes"], np.int64)),
        "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(held), train_tokens, np.int64)),
        "base_score": pa.array(base), "score": pa.array(score + more[number]), "n_context": pa.array(used + hits[number]),
    })


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
