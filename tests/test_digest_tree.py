"""The hash tree: what changes it, what doesn't, which range a change names, and what an update reads."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import digest_tree as tree

KIND = "id long, v string, x double, a array<float>, t timestamp, s struct<p:int,q:string>"


def rows(n=3000):
    t = datetime.datetime(2024, 1, 2, 3, 4, 5)
    return [(k - 500 if k % 11 else None, f"v{k % 7}\n", k / 7, [k / 3, None], t, (k, "q")) for k in range(n)]


def root(df, **how):
    r = tree.root(tree.ranges(df, "id", **how)).first()
    return r["digest"], r["n"]


def test_order_files_columns_and_line_ends_do_not_matter(spark):
    df = spark.createDataFrame(rows(), KIND)
    want = root(df)
    assert want[1] == 3000
    assert root(df.orderBy(F.rand(3)).repartition(7)) == want
    assert root(df.select(*reversed(df.columns))) == want
    assert root(df.withColumn("v", F.regexp_replace("v", "\n", "\r\n"))) == want
    assert root(df.limit(2999)) != want and root(df.unionByName(df.limit(1))) != want
    assert root(df.withColumn("x", F.when(F.col("id") == 7, F.col("x") + 2.0**-39).otherwise(F.col("x")))) != want
    assert root(df.limit(0)) == (hashlib.sha256(b"").hexdigest(), 0)


def test_a_changed_row_names_its_range(spark):
    df = spark.createDataFrame(rows(), KIND)
    other = df.withColumn("v", F.when(F.col("id").isin(-3, 1500), "new").otherwise(F.col("v"))).where("id is null or id != 40 or v = 'x'")
    a, b = tree.ranges(df, "id", width=100), tree.ranges(other, "id", width=100)
    found = sorted(map(tuple, tree.differing(a, b, 100).collect()))
    assert [(r[0], r[1]) for r in found] == [(-100, -1), (0, 99), (1500, 1599)]
    assert found[1][2] - found[1][3] == 1 and found[0][2] == found[0][3]
    assert tree.differing(a, tree.ranges(df.repartition(3), "id", width=100), 100).isEmpty()


@pytest.mark.parametrize("leaf", [4096, 40, 2])
def test_a_crowded_id_is_cut_and_copies_are_counted(spark, leaf):
    df = spark.range(900).selectExpr("if(id < 700, 5, id) as id", "cast(id % 650 as string) as v")
    same = df.orderBy(F.rand(1)).repartition(5)
    assert root(df, leaf=leaf) == root(same, leaf=leaf)
    assert root(df.where("not (id = 5 and v = '3')"), leaf=leaf) != root(df, leaf=leaf)
    many = spark.range(20_000).selectExpr("cast(9 as long) as id", "'copy' as v")
    d = hashlib.sha256("id=9\x1fv=copy".encode()).hexdigest()
    got = {(r["digest"], r["n"]) for r in tree.ranges(many, "id", leaf=leaf).collect()}
    assert got == {(hashlib.sha256(f"{d}:20000".encode()).hexdigest(), 20_000)}


def test_update_digests_touched_ranges_only(spark):
    df = spark.createDataFrame(rows(), KIND)
    new = df.withColumn("x", F.when(F.col("id") == 250, -1.0).otherwise(F.col("x"))).where("id is null or id != 777")
    ids = spark.createDataFrame([(250,), (777,)], "id long")
    stored = tree.ranges(df, "id", width=50)
    updated = tree.update(stored, new, "id", ids, width=50)
    key = lambda df: sorted(map(tuple, df.select("cell", "digest", "n").collect()), key=str)
    assert key(updated) == key(tree.ranges(new, "id", width=50))
    poisoned = new.withColumn("x", F.when(F.col("id").between(0, 199), F.raise_error(F.lit("read"))).otherwise(F.col("x")))
    assert key(tree.update(stored, poisoned, "id", ids, width=50)) == key(updated)
