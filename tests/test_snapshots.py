"""Snapshots: a writer may die between any two writes, writers may meet, readers see one version."""

import pytest
from pyspark.sql import functions as F

from cuesheet.sources import snapshots


class Died(Exception):
    pass


def contents(spark, path):
    return {n: sorted(map(tuple, df.collect())) for n, df in snapshots.read(spark, path).items()}


@pytest.fixture
def tables(spark):
    return {"t": spark.range(5).withColumn("v", F.lit("a")), "u": spark.range(3).withColumn("w", F.array(F.lit(1), F.lit(2)))}


@pytest.mark.parametrize("last", ["t", "u", "_manifest", "half a commit"])
def test_a_dead_writer_leaves_the_old_snapshot(spark, tmp_path, tables, last, monkeypatch):
    path = str(tmp_path / "s")
    first = snapshots.write(tables, path)
    old = contents(spark, path)

    def step(name):
        if name == last:
            raise Died

    new = {n: df.limit(1) for n, df in tables.items()}
    if last == "half a commit":
        def half(spark, path, number, commit):
            (tmp_path / "s" / "commits" / f"{number:012d}.json").write_text('{"version": "')
            raise Died

        monkeypatch.setattr(snapshots, "_create", half)
    with pytest.raises(Died):
        snapshots.write(new, path, step)
    monkeypatch.undo()
    assert contents(spark, path) == old and snapshots.current(spark, path)["id"] == first and snapshots.verify(spark, path)
    second = snapshots.write(new, path)
    assert second != first and all(len(rows) == 1 for rows in contents(spark, path).values())
    assert snapshots.write(tables, path) == first


def test_writers_that_meet_take_different_numbers(spark, tmp_path, tables, monkeypatch):
    path, real = str(tmp_path / "s"), snapshots._numbers
    snapshots.write(tables, path)
    seen = []

    def late(spark, path):  # the first look at the numbers is out of date
        seen.append(real(spark, path))
        return seen[-1][:-1] if len(seen) == 1 else seen[-1]

    monkeypatch.setattr(snapshots, "_numbers", late)
    snapshots.write({"t": tables["t"].limit(2)}, path)
    monkeypatch.undo()
    assert snapshots.current(spark, path)["number"] == 2 and list(contents(spark, path)) == ["t"]


def test_reading_pruning_and_damage(spark, tmp_path, tables):
    path = str(tmp_path / "s")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    for n in (1, 2, 3):
        snapshots.write({k: df.limit(n) for k, df in tables.items()}, path)
    with pytest.raises(KeyError, match="no table x"):
        snapshots.read(spark, path, "x")
    (tmp_path / "s" / "versions" / "unnamed").mkdir()
    assert snapshots.prune(spark, path, keep=1) == 2 and snapshots.prune(spark, path, keep=1) == 0
    assert (tmp_path / "s" / "versions" / "unnamed").exists()
    assert len(contents(spark, path)["t"]) == 3
    version = snapshots.current(spark, path)["version"]
    spark.range(9).withColumn("v", F.lit("b")).write.mode("append").parquet(f"{path}/versions/{version}/t")
    assert not snapshots.verify(spark, path)
