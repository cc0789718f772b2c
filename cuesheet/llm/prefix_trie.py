"""Conversation prefix trie: double-array tries over shards of sorted conversations, their shared upper nodes merged.

Equal conversations fall together first, into one row with a count. The distinct ones are range-partitioned in the
order of their turns, so a shard holds neighbouring prefixes, and a shard shares nodes with another only along the paths of
its first and of its last conversation. Each shard numbers its turns densely, packs BASE and CHECK, and walks the arrays
for its nodes. Nodes deeper than what the neighbours have in common are final; the others are handed on as
partial counts, and as every quantity of a node is a sum (or a minimum) over shards, one grouping by the node's prefix
finishes them. For that the first shard that holds a node answers for it: it alone subtracts the one copy of the node's
text that has to stay, and it alone counts the node as a child.

A turn is told by 128 bits of an md5 over role and text, so the texts move once, to be hashed where they are read.

Defined cases. Rows without conv_id belong to no conversation. A null role or text is empty; null turns come first; turns
of equal number are ordered by their hashes; a repeated row is a turn of its own. No conversations, no rows. Other columns
are not read, so their names can't clash. One conversation's turn hashes, 20 bytes a turn, are one row; no other
group is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuesheet.llm.common import attach, drop, read, save

#: Bytes of a turn's hash, turns in a shard before another is begun, and ids in a block.
WIDTH, SHARD, BLOCK_BITS = 16, 200_000, 12
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary"


def head_length(conv: Column, modulus: int = 9) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv.cast("string").cast("binary")) % modulus


def turns(talks: DataFrame) -> DataFrame:
    """Columns conv_id, place (from 1), hash, size: the turns in order, without their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = talks.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("hash"),
        F.octet_length(text).alias("size"),
    )
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "hash")
    return rows.select("conv_id", "hash", "size", F.row_number().over(by).alias("place"))


def rebuilt(talks: DataFrame, family: int = 5, modulus: int = 9) -> DataFrame:
    """Columns conv_id, seq, sizes: every conversation after its first turns were exchanged for those of its family's first.

    seq holds WIDTH bytes per turn, so its byte order is the order of turn sequences; sizes holds 4 bytes per turn.
    """
    placed = save(turns(talks))
    ids = placed.where("place = 1").select("conv_id")
    h = head_length(F.col("conv_id"), modulus)
    own = placed.where(F.col("place") > h).select("conv_id", "place", "hash", "size")
    heads = placed.where((F.col("place") < modulus) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "place", "hash", "size")
    takers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h"))
    taken = takers.join(heads, "base").where("place <= h").select("conv_id", "place", "hash", "size")
    packed = taken.unionByName(own).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "hash", "size"))).alias("t"))
    hexed = lambda f: F.unhex(F.concat_ws("", F.transform("t", f)))
    packed = packed.select("conv_id", hexed(lambda x: F.hex(x["hash"])).alias("seq"), hexed(lambda x: F.lpad(F.hex(x["size"].cast("long")), 8, "0")).alias("sizes"))
    empty = F.lit(b"")
    return ids.join(packed, "conv_id", "left").select("conv_id", F.coalesce("seq", empty).alias("seq"), F.coalesce("sizes", empty).alias("sizes"))


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """Columns seq, sizes, n, conv_id (smallest), ends: the distinct sequences and the SHA-256 of their members' ids.

    Ids are put into text in blocks of 2 ** BLOCK_BITS neighbouring ids; a digest needs its group's blocks in order, so
    they stream, sorted, through one task in constant memory.
    """
    blocks = convs.groupBy(F.md5("seq").alias("of"), F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(
        F.first("seq").alias("seq"), F.first("sizes").alias("sizes"), F.count("*").alias("n"),
        F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"), F.min("conv_id").alias("conv_id"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest = None, None

        def batch(done: list) -> pa.RecordBatch:
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], ["seq", "sizes", "n", "conv_id", "ends"])

        for b in batches:
            done = []
            for r in b.to_pylist():
                if held and held["of"] == r["of"]:
                    held["n"] += r["n"]
                    digest.update(b",")
                else:
                    if held:
                        done.append((held["seq"], held["sizes"], held["n"], held["conv_id"], digest.hexdigest()))
                    held, digest = r, hashlib.sha256()
                digest.update(r["ids"].encode())
            if done:
                yield batch(done)
        if held:
            yield batch([(held["seq"], held["sizes"], held["n"], held["conv_id"], digest.hexdigest())])

    return blocks.repartition("of").sortWithinPartitions("of", "block").mapInArrow(run, "seq binary, sizes binary, n long, conv_id long, ends string")


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    n = min(len(a), len(b)) // WIDTH * WIDTH
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return int(x.argmax()) // WIDTH if x.any() else n // WIDTH


class DoubleArray:
    """A trie in two arrays: the child of node s over turn c is t = base[s] + c where check[t] == s."""

    def __init__(self, nodes: int, symbols: int):
        size = nodes + 2 * symbols + 2
        self.base, self.check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        self.free = 1  # all slots below are taken; the root has slot 0
        self.check[0] = 0
        self.end = 1

    def _grow(self, to: int) -> None:
        if to > len(self.check):
            more = max(to, len(self.check) * 2) - len(self.check)
            self.base = np.append(self.base, np.zeros(more, np.int64))
            self.check = np.append(self.check, np.full(more, -1, np.int64))

    def place(self, node: int, symbols: np.ndarray) -> np.ndarray:
        """Give a node its children, symbols ascending; returns their slots. A few holes are tried, then the end."""
        low = int(symbols[0])
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        at = self.free
        for _ in range(8):
            self._grow(at - low + int(symbols[-1]) + 1)
            if not (self.check[at - low + symbols] >= 0).any():
                break
            at += 1
            while at < len(self.check) and self.check[at] >= 0:
                at += 1
        else:
            at = self.end
            self._grow(at - low + int(symbols[-1]) + 1)
        slots = at - low + symbols
        self.base[node] = at - low
        self.check[slots] = node
        self.end = max(self.end, int(slots[-1]) + 1)
        return slots

    def walk(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        out = self.base[nodes] + symbols
        assert (self.check[out] == nodes).all()
        return out


def shard_nodes(rows: list[dict], before: bytes | None, after: bytes | None) -> pa.RecordBatch:
    """Nodes of a shard of distinct sequences in order, as rows of NODE; before and after are the neighbours' nearest sequences.

    key is set on nodes that a neighbour may hold too, parent_key on nodes whose parent is such a one.
    """
    size = np.array([len(r["seq"]) // WIDTH for r in rows])
    raw = np.frombuffer(b"".join(r["seq"] for r in rows), f"V{WIDTH}")
    _, ids = np.unique(raw, return_inverse=True)
    width = np.frombuffer(b"".join(r["sizes"] for r in rows), ">u4").astype(np.int64)
    first = np.cumsum(size) - size
    shared = np.array([0, *(common_turns(a["seq"], b["seq"]) for a, b in zip(rows, rows[1:], strict=False))])
    trie = DoubleArray(int((size - shared).sum()) + 1, int(ids.max(initial=0)) + 1)
    n, conv = np.array([r["n"] for r in rows], np.int64), np.array([r["conv_id"] for r in rows], np.int64)
    # level by level: a node is a run of sequences with a common prefix; its children get their slots together
    at = np.zeros(len(rows), np.int64)
    levels = [np.zeros(1, np.int64)]
    for d in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > d)
        symbol = ids[first[live] + d]
        new = np.append(True, (symbol[1:] != symbol[:-1]) | (at[live][1:] != at[live][:-1]))
        heads = live[new]
        parents, symbols = at[heads], symbol[new]
        for lo, hi in zip(*_runs(parents), strict=True):
            order = np.argsort(symbols[lo:hi])
            trie.place(int(parents[lo]), symbols[lo:hi][order])
        at[live] = trie.walk(at[live], symbol)
        levels.append(np.unique(at[live]))
    # traversal: members and smallest ids by walking every sequence, subtree sums from the deepest level up
    slots = len(trie.check)
    members, least = np.zeros(slots, np.int64), np.full(slots, np.iinfo(np.int64).max)
    depth, bytes_, end = np.zeros(slots, np.int32), np.zeros(slots, np.int64), np.full(slots, -1, np.int64)
    at = np.zeros(len(rows), np.int64)
    for d in range(len(levels)):
        live = np.flatnonzero(size >= d)
        if d:
            at[live] = trie.walk(at[live], ids[first[live] + d - 1])
            bytes_[at[live]] = width[first[live] + d - 1]
        np.add.at(members, at[live], n[live])
        np.minimum.at(least, at[live], conv[live])
        depth[levels[d]] = d
        stop = live[size[live] == d]
        end[at[stop]] = stop
    path = {i: _path(trie, ids[first[i] : first[i] + size[i]]) for i in {0, len(rows) - 1}}
    left = path[0][: common_turns(before, rows[0]["seq"]) + 1] if before is not None else []
    right = path[len(rows) - 1][: common_turns(rows[-1]["seq"], after) + 1] if after is not None else []
    one = np.ones(slots, np.int64)
    one[left] = 0  # an earlier shard answers for these
    children, leaves, saved = np.zeros(slots, np.int64), np.zeros(slots, np.int64), members * bytes_ - one * bytes_
    for d in range(len(levels) - 1, -1, -1):
        here = levels[d]
        leaves[here[leaves[here] == 0]] = 1
        if d:
            up = trie.check[here]
            np.add.at(children, up, one[here])
            np.add.at(leaves, up, leaves[here])
            np.add.at(saved, up, saved[here])
    keys = {s: hashlib.md5(rows[i]["seq"][: d * WIDTH]).digest() for i, p in ((0, left), (len(rows) - 1, right)) for d, s in enumerate(p)}
    if len(right) == len(path[len(rows) - 1]):  # the last sequence goes on in the next shard, so its end is no leaf
        leaves[right] -= 1
    nodes = np.concatenate(levels)
    up = np.where(depth[nodes] > 0, trie.check[nodes], -1)
    text = [rows[e]["ends"] if e >= 0 else None for e in end[nodes].tolist()]
    return pa.RecordBatch.from_arrays(
        [pa.array(least[nodes]), pa.array(depth[nodes]), pa.array(least[np.maximum(up, 0)], mask=up < 0), pa.array(members[nodes]), pa.array(children[nodes]),
         pa.array(leaves[nodes]), pa.array(saved[nodes]), pa.array(text, pa.string()), pa.array([keys.get(s) for s in nodes.tolist()], pa.binary()),
         pa.array([keys.get(s) for s in up.tolist()], pa.binary())],
        [c.split()[0] for c in NODE.split(", ")],
    )


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.append(True, values[1:] != values[:-1]))[: len(values)]
    return edge.tolist(), [*edge[1:].tolist(), len(values)]


def _path(trie: DoubleArray, symbols: np.ndarray) -> list[int]:
    out = [0]
    for c in symbols.tolist():
        out.append(int(trie.base[out[-1]]) + c)
    return out


def _shards(rows: Iterator[dict], before: bytes | None, after: bytes | None, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into shards of about `most` turns, each with what lies beside it."""
    part: list[dict] = []
    held = 0
    for r in rows:
        if part and held + len(r["seq"]) // WIDTH > most:
            yield shard_nodes(part, before, r["seq"])
            before, part, held = part[-1]["seq"], [], 0
        part.append(r)
        held += len(r["seq"]) // WIDTH
    if part:
        yield shard_nodes(part, before, after)


def trie(talks: DataFrame, family: int = 5, modulus: int = 9, shard: int = SHARD) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = talks.sparkSession
    convs = save(rebuilt(talks, family, modulus))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = distinct_sequences(convs).repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    ranged = save(ranged.withColumn("part", F.spark_partition_id()))
    drop(convs)
    # what lies beside each partition: one row per partition, however many conversations there are
    ends = ranged.groupBy("part").agg(F.min("seq").alias("low"), F.max("seq").alias("high"))
    over = Window.orderBy("part")
    beside = save(ends.select("part", F.lag("high").over(over).alias("before"), F.lead("low").over(over).alias("after")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, edge = None, [], (None, None)

        def stream() -> Iterator[dict]:
            for b in batches:
                yield from b.to_pylist()

        held: list[dict] = []
        source = stream()
        while True:
            r = held.pop() if held else next(source, None)
            if r is None:
                return
            part, edge = r["part"], (r["before"], r["after"])

            def same(r=r, part=part) -> Iterator[dict]:
                while r is not None and r["part"] == part:
                    yield r
                    r = next(source, None)
                if r is not None:
                    held.append(r)

            yield from _shards(same(), *edge, shard)

    rows = ranged.join(F.broadcast(beside), "part").select("part", "seq", "sizes", "n", "conv_id", "ends", "before", "after")
    nodes = save(rows.repartition(parts, "part").sortWithinPartitions("part", "seq").mapInArrow(run, NODE))
    upper = nodes.where("key is not null").groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends_sha256"),
    )
    upper = save(upper)
    lower = nodes.where("key is null")
    named = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    hung = lower.where("parent_key is not null").select(*named, "parent_key").unionByName(upper.where("parent_key is not null").select(*named, "parent_key"))
    hung = attach(save(hung), "parent_key", upper.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")))
    out = (
        lower.where("parent_key is null").select(*named, "parent_conv_id")
        .unionByName(hung.select(*named, "parent_conv_id"))
        .unionByName(upper.where("parent_key is null").select(*named, F.lit(None).cast("long").alias("parent_conv_id")))
    )
    none = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


SQL = """
WITH remainders AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS t
  FROM range(256) AS r(i)
),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda s, x: xor(s // 256, t[xor(s % 256, x) + 1]), 4294967295), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), remainders
),
rebuilt AS (
  SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth, role, text FROM rebuilt),
chained AS (
  SELECT conv_id, depth, strlen(text) AS size,
    string_agg(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM numbered
),
members AS (
  SELECT conv_id, depth, size, path FROM chained
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS length FROM members GROUP BY conv_id),
nodes AS (
  SELECT m.depth, m.path, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(m.size) AS size,
    sha256(coalesce(string_agg(CAST(m.conv_id AS VARCHAR), ',' ORDER BY m.conv_id) FILTER (l.length = m.depth), '')) AS ends_sha256
  FROM members m JOIN lengths l USING (conv_id) GROUP BY m.depth, m.path
),
children AS (SELECT left(path, 64 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path),
up AS (SELECT unnest(range(depth + 1)) AS d, * FROM counted),
below AS (
  SELECT left(path, 64 * d) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM up GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b ON b.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
"""
