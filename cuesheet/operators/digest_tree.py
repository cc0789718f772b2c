"""Ordered content digests as a hash tree over ranges of ids.

Rows are cut into ranges of WIDTH ids. The digest of a range covers its rows in the order of their own digests, each
with its count; ranges are joined by FAN into parents, in the order of the ids, until one root is left. Two tables with equal
roots hold the same rows, whatever their order, files and column order; where roots differ, the ranges that
differ name the ids. After a change only the ranges with changed rows and the nodes above them are made anew.

A range that holds more than LEAF different rows, as of an id that owns a third of all rows, is cut further by the first hex
digits of the row digests, as many as its number of rows asks for; that number is part of the content, so the tree is
the same however the table is stored. Equal rows are counted and never listed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuesheet.session import materialise

WIDTH, FAN, LEAF = 1024, 256, 4096
#: Rows of a range from which on it isn't made by one task.
TASK = 16 * LEAF
#: Digits that a crowded range is cut by, at most: 16 ** 10 leaves.
DIGITS = 10


def canonical(c: Column, kind: T.DataType) -> Column:
    """Text of a value that doesn't depend on the engine that prints it.

    A float is its floor and the first 40 binary places after it, both as integers; times are microseconds; line ends are LF.
    """
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        x = c.cast("double")
        whole = F.floor(x)
        digits = F.concat(whole.cast("string"), F.lit("+"), F.floor((x - whole) * F.lit(float(2**40))).cast("string"))
        return F.when(F.isnan(x), "nan").when(F.abs(x) == float("inf"), F.when(x > 0, "inf").otherwise("-inf")).otherwise(digits)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("string")
    if isinstance(kind, T.ArrayType):
        item = F.transform(c, lambda x: F.coalesce(canonical(x, kind.elementType), F.lit("\\N")))
        return F.concat(F.lit("["), F.array_join(item, ","), F.lit("]"))
    if isinstance(kind, T.StructType):
        parts = [F.concat(F.lit(f"{f.name}="), F.coalesce(canonical(c[f.name], f.dataType), F.lit("\\N"))) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.concat_ws("\u001f", *parts), F.lit("}")))
    return F.regexp_replace(c.cast("string"), r"\r\n?", "\n")


def row_digest(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """sha-256 over `name=value` of all columns in the order of their names; nulls are left out."""
    kinds = {f.name: f.dataType for f in df.schema}
    parts = [F.concat(F.lit(f"{c}="), canonical(F.col(c), kinds[c])) for c in sorted(set(df.columns) - set(exclude))]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def _joined(df: DataFrame, keys: Sequence[str], order: str, what: Column) -> DataFrame:
    """sha-256 over the parts of each group in their order; a group has a bounded number of parts."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), what.alias("_w"))))
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(listed, lambda x: x["_w"]), "\n"), 256).alias("digest"), F.sum("n").alias("n"))


def _digits(k: Column, leaf: int) -> Column:
    return F.least(F.lit(DIGITS), F.greatest(F.lit(0), F.ceil(F.log(k / leaf) / F.log(F.lit(16.0))))).cast("int")


def _nodes(counted: DataFrame) -> DataFrame:
    """Leaves (cell, _digits, prefix, digest, n) of counted rows (cell, d, n, _digits); d is binary."""
    leaves = counted.withColumn("d", F.lower(F.hex("d"))).withColumn("prefix", F.expr("substring(d, 1, _digits)"))
    return _joined(leaves, ["cell", "_digits", "prefix"], "d", F.concat_ws(":", "d", F.col("n").cast("string")))


def _crowded(rows: DataFrame, leaf: int) -> DataFrame:
    """Leaves of ranges too large for a task: no step holds a whole range."""
    rows = materialise(rows.groupBy("cell", "d").agg(F.count("*").alias("n")))
    sizes = rows.groupBy("cell").agg(F.count("*").alias("_k")).select(F.col("cell").alias("_cell"), _digits(F.col("_k"), leaf).alias("_digits"))
    # a row per range of more than TASK rows
    return _nodes(rows.join(F.broadcast(sizes), F.col("cell").eqNullSafe(F.col("_cell"))))


def ranges(df: DataFrame, id_: str, exclude: Sequence[str] = (), width: int = WIDTH, leaf: int = LEAF, task: int = TASK) -> DataFrame:
    """Columns cell, digest, n: one row per range of `width` ids; rows without an id are the range of null.

    The digest of a row is shuffled once, to the task that makes its range, and nothing of its size is written. Ranges of
    more than `task` rows are found by their ids beforehand and made in pieces, with the same digest.
    """
    cell = F.floor(F.col(id_).cast("long") / F.lit(width))
    large = df.groupBy(cell.alias("_large")).agg(F.count("*").alias("_n")).where(F.col("_n") > task).select("_large")
    large = materialise(large)
    digests = lambda part: part.select(cell.alias("cell"), F.unhex(row_digest(df, exclude)).alias("d"))
    some = not large.isEmpty()
    here = cell.eqNullSafe(F.col("_large"))
    rows = digests(df.join(F.broadcast(large), here, "left_anti") if some else df)
    counted = rows.repartition("cell").groupBy("cell", "d").agg(F.count("*").alias("n"))
    counted = counted.withColumn("_digits", _digits(F.count("*").over(Window.partitionBy("cell")), leaf))
    nodes = _nodes(counted)
    if some:
        nodes = nodes.unionByName(_crowded(digests(df.join(F.broadcast(large), here, "left_semi")), leaf))
    # a row per leaf, read for the deep ones and the others
    nodes = materialise(nodes)
    deepest = nodes.where("_digits > 0")
    if deepest.isEmpty():
        return nodes.select("cell", "digest", "n")
    done = nodes.where("_digits = 0").select("cell", "digest", "n")
    level = materialise(deepest.select("cell", F.col("_digits").alias("depth"), "prefix", "digest", "n"))
    for k in range(DIGITS, 0, -1):
        here = level.where(F.col("depth") == k)
        if here.isEmpty():
            continue
        above = _joined(here.withColumn("parent", F.substring("prefix", 1, k - 1)), ["cell", "parent"], "prefix", F.concat_ws(":", "prefix", "digest"))
        above = above.select("cell", F.lit(k - 1).alias("depth"), F.col("parent").alias("prefix"), "digest", "n")
        level = materialise(level.where(F.col("depth") < k).unionByName(above))
    return done.unionByName(level.select("cell", "digest", "n"))


def root(cells: DataFrame, fan: int = FAN) -> DataFrame:
    """Columns digest, n: the root over the ranges, by levels of `fan` children. No rows: the digest of nothing.

    Ranges of negative ids, of others and of no id have a tree each, of which the tops are joined last.
    """
    side = F.when(F.col("cell").isNull(), "null").when(F.col("cell") < 0, "-").otherwise("+")
    level = materialise(cells.select(side.alias("side"), F.coalesce("cell", F.lit(0)).alias("cell"), "digest", "n"))
    while level.groupBy("side").count().where("count > 1").limit(1).count():
        named = F.concat_ws(":", F.col("cell").cast("string"), "digest")
        up = level.withColumn("at", F.floor(F.col("cell") / fan))
        level = materialise(_joined(up, ["side", "at"], "cell", named).select("side", F.col("at").alias("cell"), "digest", "n"))
    tops = F.array_sort(F.collect_list(F.concat("side", F.lit(":"), "digest")))  # three at most
    return level.agg(F.sha2(F.array_join(tops, "\n"), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def differing(a: DataFrame, b: DataFrame, width: int = WIDTH) -> DataFrame:
    """Ranges (first_id, last_id, n_a, n_b) in which two tables differ, from their ranges."""
    both = a.select(F.col("cell").alias("ca"), F.col("digest").alias("da"), F.col("n").alias("n_a")).join(
        b.select(F.col("cell").alias("cb"), F.col("digest").alias("db"), F.col("n").alias("n_b")), F.col("ca").eqNullSafe(F.col("cb")), "full")
    cell = F.coalesce("ca", "cb")
    return both.where(~F.col("da").eqNullSafe(F.col("db"))).select(
        (cell * width).alias("first_id"), (cell * width + width - 1).alias("last_id"),
        F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def update(cells: DataFrame, df: DataFrame, id_: str, changed: DataFrame, exclude: Sequence[str] = (), width: int = WIDTH) -> DataFrame:
    """Ranges of df, of which those that hold no id of `changed` (one column of ids) are taken from `cells`.

    Only rows of touched ranges are digested: the condition is on the id, so files that hold none of them are skipped.
    """
    touched = materialise(changed.select(F.floor(F.col(changed.columns[0]).cast("long") / F.lit(width)).alias("_touched")).distinct())
    rows = df.join(touched, F.floor(F.col(id_).cast("long") / F.lit(width)).eqNullSafe(F.col("_touched")), "left_semi")
    same = cells.join(touched, F.col("cell").eqNullSafe(F.col("_touched")), "left_anti")
    return same.unionByName(ranges(rows, id_, exclude, width))
