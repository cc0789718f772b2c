import json

import pytest
from pyspark.sql import functions as F

from cuesheet.operators import audit, tables
from cuesheet.sources import readers, writers
from cuesheet.streaming import logs

A, B = "aaaaaaaaaaa", "bbbbbbbbb_1"


@pytest.fixture
def root(tmp_path):
    scenes = {"summary": {"num_scenes": 2, "duration_s": 20.0}, "scenes": [
        {"scene": 0, "start_s": 0.0, "end_s": 5.0, "dominant_color": "#ff0000"}, {"scene": 1, "start_s": 5.0, "end_s": 20.0}]}
    for name, files in {
        A: {"scenes.json": scenes, "scene_tags.json": [{"mood": "calm", "shot_type": "wide"}], "features.json": {"title": "t"}},
        B: {"scenes.json": "{broken", "features.json": {"title": "u"}},
        "not-an-id": {"scenes.json": scenes},
    }.items():
        d = tmp_path / "data" / name
        d.mkdir(parents=True)
        for f, body in files.items():
            (d / f).write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(tmp_path / "data")


def test_artifacts_positions_and_presence(spark, root):
    docs = readers.read_artifact(spark, root, "scenes.json")
    assert [r["item"] for r in docs.collect()] == [A]
    feats = readers.read_artifact(spark, root, "features.json", "struct<title:string>").select("item", "doc.title")
    both = readers.bundle(feats, {"scenes": docs, "scene_tags": readers.read_artifact(spark, root, "scene_tags.json")})
    assert both.count() == 2
    rows = {r["pos"]: r for r in readers.scenes_of(both).collect()}
    assert rows[0]["tag"]["mood"] == "calm" and rows[1]["tag"] is None and rows[1]["scene"]["start_s"] == 5.0
    have = readers.artifact_presence(spark, root)
    assert sorted(r["item"] for r in have.select("item").distinct().collect()) == [A, B]
    done = {r["item"]: r for r in audit.completeness(have, ["features.json", "scene_tags.json"]).collect()}
    assert done[A]["complete"] and done[B]["missing"] == ["scene_tags.json"]
    assert readers.catalog(feats.withColumnRenamed("item", "video_id")).columns[0] == "video_id"


def test_csv_jsonl_and_id_list(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿video_id,title,n,flag,upload_date\nx,"two\nlines ""q""",3,True,20250701\ny,,,,\n', encoding="utf-8")
    r = readers.read_csv(spark, str(p), "video_id string, title string, n long, flag boolean, upload_date string").collect()
    assert r[0]["title"] == 'two\nlines "q"' and r[0]["flag"] is True and r[0]["upload_date"] == "20250701"
    assert r[1]["title"] is None and r[1]["n"] is None
    j = tmp_path / "a.jsonl"
    j.write_text('{"a": 1, "b": ["x"]}\n{"a": null}\n')
    assert [tuple(x) for x in readers.read_jsonl(spark, str(j), "a long, b array<string>").collect()] == [(1, ["x"]), (None, None)]
    ids = tmp_path / "fav.txt"
    ids.write_text("# list\nhttps://youtu.be/aaaaaaaaaaa  first\n\nbbbbbbbbb_1 # note\naaaaaaaaaaa\n")
    got = readers.read_id_list(spark, str(ids)).orderBy("line_no").collect()
    assert [x["item"] for x in got] == [A, B]


def test_guarded_writes_and_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    out = str(tmp_path / "out")
    writers.write_jsonl(df, out)
    writers.write_jsonl(df, out)
    with pytest.raises(ValueError, match="not sample"):
        writers.guard(spark, out, "sample", [])
    with pytest.raises(ValueError, match="is an input"):
        writers.write_jsonl(df, out, inputs=[out])
    (tmp_path / "foreign").mkdir()
    with pytest.raises(ValueError, match="unknown data"):
        writers.write_jsonl(df, str(tmp_path / "foreign"))
    one = writers.write_snapshot({"t": df, "u": df.limit(1)}, str(tmp_path / "snap"))
    two = writers.write_snapshot({"u": df.limit(1), "t": df.orderBy(F.desc("k"))}, str(tmp_path / "snap"))
    assert one == two and len(one) == 64
    writers.search_views(spark, lines=None)
    assert spark.table("search_lines").count() == 0


def test_digest_is_neutral_to_order_and_line_ends(spark):
    a = spark.createDataFrame([(1, "x\r\ny", None), (2, "z", 3)], "k long, v string, w long")
    b = spark.createDataFrame([(3, "z", 2), (None, "x\ny", 1)], "w long, v string, k long")
    dig = lambda df, **kw: audit.table_digest(df, **kw).first()["digest"]
    assert dig(a) == dig(b)
    assert dig(a) != dig(a.withColumn("v", F.upper("v")))
    assert dig(a, exclude=["v"]) == dig(a.withColumn("v", F.upper("v")), exclude=["v"])


def test_fresh_or_rebuild(spark, root):
    calls = []
    stamp, built = writers.fresh_or_rebuild(spark, root, None, lambda: calls.append(1))
    assert built and len(calls) == 1
    again, built = writers.fresh_or_rebuild(spark, root, stamp, lambda: calls.append(1))
    assert again == stamp and not built and len(calls) == 1


def test_merge_precedence(spark):
    base = spark.createDataFrame([(1, 10.0), (2, None)], "k long, a double")
    one = spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 6.0)], "k long, a double, h double")
    two = spark.createDataFrame([(2, 3.0)], "k long, a double")
    got = {r["k"]: r for r in tables.merge_sources(base, [one, two], "k").collect()}
    assert (got[1]["a"], got[1]["h"], got[2]["a"]) == (10.0, 5.0, 3.0)
    assert tables.fill_absent(base, one, "k", "a") is base


def test_log_is_resumable_and_equals_batch(spark, tmp_path):
    src, out, ck = str(tmp_path / "in"), str(tmp_path / "log"), str(tmp_path / "ck")
    schema = "item long, param string"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], schema).write.json(src)

    def run(checkpoint):
        stream = spark.readStream.schema(schema).json(src)
        work = lambda df: df.withColumn("error", F.when(F.col("item") == 2, "timeout"))
        logs.append_new(stream, ["item", "param"], out, checkpoint, work).awaitTermination()

    run(ck)
    spark.createDataFrame([(2, "a"), (2, "b"), (3, "a")], schema).write.mode("append").json(src)
    run(ck)
    got = sorted((r["item"], r["param"], r["error"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a", None), (2, "a", "timeout"), (2, "b", "timeout"), (3, "a", None)]


def test_stream_bins_equal_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"2024-01-01 00:00:{s:02d}", s % 2, s) for s in range(0, 60, 3)] + [("2024-01-02 00:00:00", 0, 1)]
    df = spark.createDataFrame(rows, "t string, k int, v long").select(F.to_timestamp("t").alias("ts"), "k", "v")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = logs.run_to_table(logs.bins(stream, "ts", ["k"], F.col("v")), "bins_out", str(tmp_path / "c1"))
    want = df.where("ts < '2024-01-02'").groupBy(F.window("ts", "10 seconds").alias("w"), "k").agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    key = lambda d, *c: sorted(tuple(r) for r in d.select(*c).collect())
    assert key(got, "start", "k", "value", "n") == key(want, "w.start", "k", "v", "n")
    once = logs.run_to_table(logs.dedup(stream.select("k"), ["k"]), "dedup_out", str(tmp_path / "c2"))
    assert sorted(r["k"] for r in once.collect()) == [0, 1]
