"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from cuesheet.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string, hash string, place long"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    nodes, ends = {}, {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(convs.get(c - int(np.fmod(c, 5)), [])[:h] + convs[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in nodes if len(q) == len(p) + 1 and q[: len(p)] == p]
        leaves = [q for q in under if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in under)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, digest))
    return sorted(out)


def found(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def talks(seed, n=70, few=3):
    rng = random.Random(seed)
    out = []
    for c in rng.sample(range(-20, 200), n):
        for t in range(rng.randint(1, 12)):
            out.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", "bot", None]), rng.choice(["é" * rng.randint(0, few), "b", "", None]), "h", 4))
    return [*out, out[0], (None, 0, "user", "lost", "h", 1), *((c, t, "user", str(t), "h", 1) for c in range(5000, 5030) for t in range(3))]


@pytest.mark.parametrize("seed,shard", [(1, 200_000), (2, 9), (3, 1)])
def test_against_plain_prefixes(spark, seed, shard):
    rows = talks(seed)
    df = spark.createDataFrame(rows, KIND).repartition(3)
    assert found(prefix_trie.trie(df, shard=shard)) == plain(rows)


def test_many_partitions_share_upper_nodes(spark):
    rows = [(c, t, "user", "same" if t < 7 else str(c % 50), "h", 1) for c in range(0, 600) for t in range(9)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        assert found(prefix_trie.trie(spark.createDataFrame(rows, KIND), shard=20)) == plain(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_sql_says_the_same(spark, tmp_path):
    rows = talks(5)
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "c"))
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{tmp_path}/c/*.parquet'")
    assert sorted(db.sql(f"select {', '.join(COLUMNS)} from ({prefix_trie.SQL})").fetchall()) == plain(rows)


def test_empty_single_and_turnless(spark):
    assert prefix_trie.trie(spark.createDataFrame([], KIND)).collect() == []
    base = next(c for c in range(1, 5) if zlib.crc32(str(c).encode()) % 9)  # takes turns from an absent conversation
    for rows in ([(0, 0, "user", "a", "h", 1)], [(base, 0, "user", "a", "h", 1)], [(base, 0, None, "long " * 1_000_000, "h", 1), (0, 1, None, "x", "h", 1)]):
        assert found(prefix_trie.trie(spark.createDataFrame(rows, KIND))) == plain(rows)


def test_double_array_holds_every_child():
    rng = np.random.default_rng(2)
    trie = prefix_trie.DoubleArray(4, 2)
    open_, edges = [0], {}
    for node in open_:
        symbols = np.unique(rng.integers(0, 60, rng.integers(1, 9)))
        slots = trie.place(node, symbols)
        edges |= {(node, int(c)): int(s) for c, s in zip(symbols, slots, strict=True)}
        if len(open_) < 300:
            open_ += slots.tolist()
    assert len(set(edges.values())) == len(edges) and 0 not in edges.values()
    at, by = (np.array([k[i] for k in edges]) for i in (0, 1))
    assert trie.walk(at, by).tolist() == list(edges.values())
