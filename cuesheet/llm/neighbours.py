"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuesheet.llm.common import attach, components, read, save

THRESHOLD = 0.98
#: Neighbours of a list at the start.
SIZE = 12
#: Rows of a leaf in which the first lists are made, and how many trees make leaves.
LEAF = 64
TREES = 8
#: Queries of the audit and the recall that it asks for.
AUDIT = 256
RECALL = 0.995
#: Passes of fresh trees that look for links between saturated components, at most.
PASSES = 6
#: Vectors of one block of a saturated component.
TILE = 512


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed vectors, and where each vector starts."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros(0), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.float64), (offsets - offsets[0]) // 8


def _matrix(column: pa.Array) -> np.ndarray:
    """The same as rows, where all vectors have one width."""
    flat, _ = _vectors(column)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, labels, out = b.column("id").to_pylist(), b.column("label").to_pylist(), []
        for v in b.column("v"):
            x = np.array(v.values if v.is_valid else [], np.float64)
            top = np.abs(x).max(initial=0)
            if not len(x) or not np.isfinite(top) or top == 0 or np.isnan(x).any():
                out.append(None)
                continue
            x = x / top
            out.append((x / np.sqrt((x * x).sum())).tobytes())
        labels = [None if o is None else f"{len(o) // 8}\x01{x}" for x, o in zip(labels, out, strict=True)]
        table = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(out, pa.binary())], ["id", "label", "v"])
        yield table.filter(pa.array([o is not None for o in out], pa.bool_()))


def unit(embeddings: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label with the width, packed unit vector in double precision) of the vectors that can link."""
    one = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    return one.where("id is not null and label is not null and v is not null").mapInArrow(_units, "id long, label string, v binary")


@functools.cache
def _planes(tree: int, width: int, levels: int) -> np.ndarray:
    return np.random.default_rng([11, tree, width]).normal(size=(levels, width))


def _leaves(batches: Iterable[pa.RecordBatch], trees: range, levels: int) -> Iterator[pa.RecordBatch]:
    """Per vector and tree the signs of `levels` random projections."""
    for b in batches:
        flat, start = _vectors(b.column("v"))
        width = np.diff(start)
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            m = flat[(start[at][:, None] + np.arange(w))]
            rows = b.take(pa.array(at))
            for t in trees:
                code = (m @ _planes(t, int(w), levels).T > 0) @ (1 << np.arange(levels)).astype(np.int64) if levels else np.zeros(len(at), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), t, np.int32)), pa.array(code), rows.column("id"), rows.column("label"), rows.column("v")], ["tree", "code", "id", "label", "v"])


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cos", pa.float64())])
EDGES = "a long, b long, cos double"


def _best(ids: np.ndarray, m: np.ndarray, size: int, floor: np.ndarray | None = None) -> pa.Table:
    """The `size` nearest of every vector among the others of the list, above its floor if there is one."""
    cos = m @ m.T
    np.fill_diagonal(cos, -2)
    k = min(size, len(ids) - 1)
    if k < 1:
        return pa.Table.from_pylist([], _EDGES)
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    a = np.repeat(np.arange(len(ids)), k)
    b = near.ravel()
    c = cos[a, b]
    if floor is not None:
        good = c > floor[a]
        a, b, c = a[good], b[good], c[good]
    good = ids[a] != ids[b]
    return pa.table([pa.array(ids[a[good]]), pa.array(ids[b[good]]), pa.array(c[good])], schema=_EDGES)


def _first(table: pa.Table, size: int) -> pa.Table:
    return _best(table.column("id").to_numpy(), _matrix(table.column("v")), size)


def _bridges(table: pa.Table, threshold: float) -> pa.Table:
    """Edges (a, b) that connect what the threshold connects inside one part of a leaf: one per vector at most.

    A list that is full of its own crowd has no room for a vector of another crowd, however near; these edges have.
    """
    ids, m = table.column("id").to_numpy(), _matrix(table.column("v"))
    near = m @ m.T >= threshold
    np.fill_diagonal(near, True)
    root = np.arange(len(ids))
    while True:
        least = np.where(near, root[None, :], len(ids)).min(1)
        if (least == root).all():
            break
        root = least
    good = root != np.arange(len(ids))
    return pa.table([pa.array(ids[good]), pa.array(ids[root[good]])], ["a", "b"])


def _join(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Local joins: the neighbours of one vector, and itself, are compared with one another."""
    for b in batches:
        lists = b.column("near")
        edges = lists.offsets.to_numpy()
        items = lists.flatten()
        ids, floor = items.field("id").to_numpy(), items.field("floor").to_numpy()
        flat, start = _vectors(items.field("v"))
        edges = edges - edges[0]
        out = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if j - i > 1:
                out.append(_best(ids[i:j], flat[start[i] : start[j]].reshape(j - i, -1), size, floor[i:j]))
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()


def _keep(edges: DataFrame, size: int) -> DataFrame:
    """The `size` nearest of every vector; equal pairs count once."""
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return edges.groupBy("a", "b").agg(F.max("cos").alias("cos")).withColumn("rank", rank).where(F.col("rank") <= size).drop("rank")


def _audit(vectors: DataFrame, placed: DataFrame, threshold: float, audit: int) -> float:
    """Share of the true links of a bounded set of queries of which both ends are in one component.

    placed: (id, label, v, component) of every vector. The queries are those with the smallest hashed ids; they are
    compared with all vectors, no list size bounds what counts, and a block of vectors sends two numbers.
    """
    rows = placed.orderBy(F.xxhash64("id"), "id").limit(audit).collect()
    if not rows:
        return 1.0
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r["label"], []).append((r["id"], r["component"], np.frombuffer(r["v"])))
    held = vectors.sparkSession.sparkContext.broadcast({k: tuple(map(np.array, zip(*g, strict=True))) for k, g in groups.items()})

    def look(batches):
        for b in batches:
            ids, labels, own = b.column("id").to_numpy(), np.array(b.column("label").to_pylist()), b.column("component").to_numpy()
            n = hits = 0
            for k in set(labels.tolist()) & held.value.keys():
                query, component, m = held.value[k]
                at = np.flatnonzero(labels == k)
                true = (m @ _matrix(b.column("v").take(pa.array(at))).T >= threshold) & (query[:, None] != ids[at][None, :])
                n += int(true.sum())
                hits += int((true & (component[:, None] == own[at][None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([hits])], ["n", "hits"])

    n, hits = placed.select("id", "label", "v", "component").mapInArrow(look, "n long, hits long").agg(F.sum("n"), F.sum("hits")).first()
    return hits / n if n else 1.0


def _cut(vectors: DataFrame, leaf: int, trees: range) -> DataFrame:
    """Columns tree, leaf, part, id, v: random leaves of each label, of at most about twice `leaf` vectors.

    A leaf that is still large, as of a crowd of like vectors, is cut at random.
    """
    sizes = vectors.groupBy("label").count().withColumn("levels", F.ceil(F.log2(F.greatest(F.col("count") / leaf, F.lit(1.0)))).cast("int"))
    sizes = save(sizes.select("label", "levels"))
    levels = sizes.agg(F.coalesce(F.max("levels"), F.lit(0))).first()[0]
    coded = vectors.mapInArrow(lambda it: _leaves(it, trees, levels), "tree int, code long, id long, label string, v binary").join(sizes, "label")
    # a label uses as many of the planes as its size asks for
    leaves = save(coded.select("tree", F.concat_ws("\x01", "label", F.expr("code & (shiftleft(1L, levels) - 1)").cast("string")).alias("leaf"), "id", "v"))
    counts = leaves.groupBy("tree", "leaf").count().withColumn("parts", F.ceil(F.col("count") / (2 * leaf)).cast("int"))
    cut = leaves.join(counts.select("tree", "leaf", "parts"), ["tree", "leaf"])
    return cut.withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))


def descend(vectors: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, leaf: int = LEAF, trees: int = TREES, rounds: int = 12) -> DataFrame:
    """Edges (a, b, cos) of a neighbour graph, both ways, of vectors (id, label, v).

    First lists come from random leaves. Each round joins the neighbours (and reverse neighbours, as many) of every
    vector with one another and keeps the best of every list; it ends after a round that adds hardly a link.
    """
    edges = _cut(vectors, leaf, range(trees)).groupBy("tree", "leaf", "part").applyInArrow(lambda t: _first(t, size), EDGES)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    graph = save(_keep(save(both), size))
    links = graph.where(F.col("cos") >= threshold).count()
    for _ in range(rounds):
        floor = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cos").alias("least"))
        floor = floor.select(F.col("a").alias("id"), F.when(F.col("n") >= size, F.col("least")).otherwise(-2.0).alias("floor"))
        ready = save(vectors.select("id", "v").join(floor, "id", "left").select("id", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor")))
        back = _keep(graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"), size)
        near = graph.select("a", "b").unionByName(back.select("a", "b")).unionByName(graph.select("a", F.col("a").alias("b"))).distinct()
        lists = near.join(ready.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.collect_list(F.struct(F.col("b").alias("id"), "v", "floor")).alias("near"))
        better = save(lists.select("near").mapInArrow(lambda it: _join(it, size), EDGES))
        fresh = better.join(graph.select("a", "b"), ["a", "b"], "left_anti")
        graph = save(_keep(graph.unionByName(fresh), size))
        links, before = graph.where(F.col("cos") >= threshold).count(), links
        if links - before <= 0.001 * links:
            break
    return graph


def _with_lone(found: DataFrame) -> DataFrame:
    return save(found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct())


def linked(vectors: DataFrame, size: int, threshold: float, leaf: int = LEAF, trees: int = TREES, audit: int = AUDIT, recall: float = RECALL, passes: int = PASSES, **how) -> DataFrame:
    """Columns node, component of all vectors that have a link.

    A vector whose list is full and whose last neighbour is still within the threshold is saturated. Its list is
    enlarged to all that its component holds, and as a full list has no room for another crowd, fresh trees over the
    saturated vectors look for links between components, until a pass merges none and the audited recall is reached.
    If it isn't after all passes the operator fails and says so.
    """
    graph = descend(vectors, size, threshold, leaf, trees, **how)
    found = _with_lone(components(graph.where(F.col("cos") >= threshold).select("a", "b")))
    full = graph.groupBy("a").agg(F.count("*").alias("n"), F.min("cos").alias("least")).where((F.col("n") >= size) & (F.col("least") >= threshold))
    saturated = save(vectors.join(full.select(F.col("a").alias("id")), "id", "left_semi"))
    some = not saturated.isEmpty()
    reached = 0.0
    for turn in range(passes):
        merged = False
        if some:
            parts = _cut(saturated, leaf, range(trees * (turn + 1), trees * (turn + 2)))
            extra = save(parts.groupBy("tree", "leaf", "part").applyInArrow(lambda t: _bridges(t, threshold), "a long, b long").distinct())
            of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
            new = save(extra.join(of("a"), "a").join(of("b"), "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
            merged = not new.isEmpty()
            if merged:
                roots = components(new).select(F.col("node").alias("component"), F.col("component").alias("top"))
                found = save(attach(found, "component", roots).select("node", F.coalesce("top", "component").alias("component")))
        if not merged or turn == passes - 1:
            placed = vectors.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", "label", "v", F.coalesce("component", "id").alias("component"))
            reached = _audit(vectors, save(placed), threshold, audit)
            if reached >= recall:
                return found
            if not some:
                saturated, some = vectors, True  # links are missing though no list is full: all vectors meet in fresh trees
    raise RuntimeError(f"{reached:.4f} of the audited links were found after {passes} passes, {recall} asked: give more trees or longer lists")


def near_duplicates(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, size: int = SIZE, tile: int = TILE, **how) -> DataFrame:
    """Columns vec_id, n_links, component_id, kept, one row per row of embeddings.

    Two vectors link if their labels are equal and not null and their cosine is at least the threshold. Vectors that
    are null, zero or hold null or non-finite components, and null labels or ids, link with nothing: n_links 0 and
    the own id as component. Vectors of different width don't link. Rows that share an id are one vector, the first
    by content, and get the same answer.

    Lists whose last neighbour is still within the threshold are saturated: a larger crowd may stand behind them.
    Their lists are enlarged to all that the links reach, also over bridges to other crowds (see linked): members of a
    component are compared tile by tile, and only counts per vector leave a pair of tiles.
    """
    one = unit(embeddings, key, vector, label)
    first = F.row_number().over(W.partitionBy("id").orderBy("label", F.hex("v")))
    vectors = save(one.withColumn("nth", first).where("nth = 1").drop("nth"))
    found = linked(vectors, size, threshold, **how)
    members = found.join(vectors, found["node"] == vectors["id"]).select("component", "id", "v")
    sizes = found.groupBy("component").agg(F.count("*").alias("size"))
    placed = members.join(sizes.select("component", F.ceil(F.col("size") / tile).cast("int").alias("tiles")), "component")
    # small components share groups, a large one is cut into tiles; a tile meets every tile, itself included
    spread = max(1, found.count() // (4 * tile))
    group = F.when(F.col("tiles") > 1, F.col("component")).otherwise(-1 - F.pmod(F.xxhash64("component"), F.lit(spread)))
    placed = save(placed.select("component", "id", "v", "tiles", group.alias("group"), F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int").alias("tile")))
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    left = placed.select("group", "component", "id", "v", F.col("tile").alias("x"), every.alias("y"))
    right = placed.select("group", "component", "id", "v", F.col("tile").alias("y"), every.alias("x"))

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        n = np.zeros(len(a), np.int64)
        if len(a) and len(b):
            ids, other, mine, theirs = (t.column(c).to_numpy() for c in ("id", "component") for t in (a, b))
            (v, at), (u, to) = _vectors(a.column("v")), _vectors(b.column("v"))
            for c in np.intersect1d(mine, theirs):
                i, j = np.flatnonzero(mine == c), np.flatnonzero(theirs == c)
                width = at[i[0] + 1] - at[i[0]]
                hit = v[at[i][:, None] + np.arange(width)] @ u[to[j][:, None] + np.arange(width)].T >= threshold
                n[i] = (hit & (ids[i][:, None] != other[j][None, :])).sum(1)
        return pa.table({"id": a.column("id"), "n": pa.array(n)})

    keys = ["group", "x", "y"]
    counts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "id long, n long").groupBy("id").agg(F.sum("n").alias("n_links"))
    answer = found.select(F.col("node").alias("id"), "component").join(counts, "id")
    rows = embeddings.select(F.col(key).cast("long").alias("vec_id"))
    out = rows.join(answer, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x),
c AS (SELECT x, least(min(x), min(y)) AS component_id FROM r GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id)::BIGINT AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
