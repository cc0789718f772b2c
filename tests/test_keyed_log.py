"""The keyed log: what a batch reads, null keys, and logs of another layout."""

import glob
import os

import pytest

from cuesheet.streaming import logs


def drive(spark, source, log, mark, work=None):
    stream = spark.readStream.schema("id long, v string").parquet(f"{source}/*")
    logs.append_new(stream, ["id", "v"], log, mark, work).awaitTermination()


def put(spark, source, name, rows):
    spark.createDataFrame(rows, "id long, v string").coalesce(1).write.parquet(f"{source}/{name}")


def test_a_batch_reads_only_the_parts_of_its_keys(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    put(spark, source, "a", [(i, "x") for i in range(2000)])
    drive(spark, source, log, mark)
    parts = {os.path.basename(p) for p in glob.glob(f"{log}/bucket=*")}
    assert 200 < len(parts) <= logs.BUCKETS
    mine = {os.path.basename(p) for p in glob.glob(f"{log}/bucket=*") if any(r["id"] in (7, 8) for r in spark.read.parquet(p).collect())}
    assert len(mine) == 2
    for p in glob.glob(f"{log}/bucket=*/run=*/epoch=*/part-*.parquet"):  # all other parts can't be read any more
        if p.split("/bucket=")[1].split("/")[0] not in {m.removeprefix("bucket=") for m in mine}:
            with open(p, "wb") as f:
                f.write(b"unreadable")
    put(spark, source, "b", [(7, "x"), (8, "x")])
    seen = []
    drive(spark, source, log, mark, lambda df: seen.append(df.count()) or df)
    assert seen == [0]


def test_null_keys_are_logged_once(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    for name in "ab":
        put(spark, source, name, [(None, "x"), (None, None), (1, None)])
        drive(spark, source, log, mark)
    assert sorted(map(tuple, spark.read.parquet(log).select("id", "v").collect()), key=str) == sorted([(None, "x"), (None, None), (1, None)], key=str)


def test_a_log_of_other_parts_is_refused(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))
    put(spark, source, "a", [(1, "x")])
    drive(spark, source, log, mark)
    assert logs._logged(spark, log, [], logs.BUCKETS) is None
    with pytest.raises(ValueError, match="is no log of 7 parts"):
        logs._logged(spark, log, [], 7)


def test_run_name_is_made_once(spark, tmp_path):
    mark = str(tmp_path / "mark")
    name = logs._run_name(spark, mark)
    assert logs._run_name(spark, mark) == name and name != logs._run_name(spark, mark + "2")
    (tmp_path / "dead").mkdir()
    (tmp_path / "dead" / "run-name").write_text("")
    assert logs._run_name(spark, str(tmp_path / "dead")) == logs._run_name(spark, str(tmp_path / "dead")) != ""
