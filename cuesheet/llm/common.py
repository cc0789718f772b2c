"""Helpers that several of the operators share: scratch tables, hot keys, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.session import shared_folder


def scratch_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/llm/{uuid.uuid4().hex}"


#: Spark's setting by which a finished query deletes its shuffle files.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors.

    What the plan shuffled is deleted as soon as the table stands, and not when the driver collects its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(*saved: DataFrame) -> None:
    """Delete scratch tables that no later plan reads."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held(col: str, remainder: int, of: int = 5) -> Column:
    """True where crc32 of the id as text leaves the remainder; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % of == remainder


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:8]}"
    return name


#: So many ids, 8 bytes each, are broadcast; more are joined by a shuffle.
FEW_IDS = 500_000


def by_id(docs: DataFrame, key: str, ids: DataFrame, how: str) -> DataFrame:
    """docs with (left_semi) or without (left_anti) the rows whose key is in the one column of ids, distinct longs.

    Whole rows stay where they are if the ids are few enough to be sent to them; the result is the same either way.
    A row with a null key counts as not in ids.
    """
    name = unused(docs, "_id")
    ids = save(ids.toDF(name).distinct())
    n = ids.limit(FEW_IDS + 1).count()
    return docs.join(F.broadcast(ids) if n <= FEW_IDS else ids, F.col(key).cast("long") == F.col(name), how)


HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str) -> list:
    """Keys, from a table with a column count, with more than 1/HOT_SHARE of all rows: fewer than HOT_SHARE by construction."""
    total, most = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    least = max(HOT_SHARE, total // HOT_SHARE)
    if most <= least:
        return []
    return [r[0] for r in counts.where((F.col("count") > least) & F.col(key).isNotNull()).select(key).collect()]


def attach(rows: DataFrame, key: str, table: DataFrame, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Join rows with a table that has one row per key, whatever share of the rows one key owns.

    Table rows of hot keys (hot_keys) are broadcast, and all other rows are joined by a shuffle. A row is told by its key
    alone, so each goes through one join. counts: rows of each key of the table, in a column count, where they are known.
    """
    hot = hot_keys(rows.groupBy(key).count() if counts is None else counts, key)
    if not hot:
        return rows.join(table, key, how)
    hot_table = save(table.where(F.col(key).isin(hot)))
    known = [r[0] for r in hot_table.select(key).collect()]
    # a null key is never hot
    often = F.coalesce(F.col(key).isin(known), F.lit(False)) if known else F.lit(False)
    return rows.where(~often).join(table, key, how).unionByName(rows.where(often).join(F.broadcast(hot_table), key, "inner"))


#: So many edges, 16 bytes each, are put together by one task; more go by rounds of shuffles.
FEW_EDGES = 200_000


def _put_together(table: pa.Table) -> pa.Table:
    """Smallest reachable node of every node that isn't the smallest itself, from edges (u, v)."""
    ends = np.concatenate([table.column(c).to_numpy() for c in ("u", "v")])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.table({"node": nodes[below], "component": nodes[root[below]]})


def components(edges: DataFrame, rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Smallest reachable id of every node of (a, b) edges: columns node, component.

    Up to `few` edges are one task's work. Above, alternating large-star and small-star steps; every step is one shuffle of the edges and a written table.
    A step keeps at most one edge per node and old edge, so no neighbourhood is gathered anywhere.
    """
    now = save(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    if now.count() <= few:
        kind = dict(now.dtypes)["u"]
        found = save(now.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_put_together, f"node {kind}, component {kind}"))
        drop(now)
        return found
    before = None
    for _ in range(rounds):
        # large star: every neighbour above u is tied to the smallest of u and its neighbours
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: every neighbour at or below u is tied to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        after = save(small)
        n, s = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop(now)
        now = after
        if (n, s) == before:
            break
        before = (n, s)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
