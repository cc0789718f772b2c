"""NaN and infinities, keys without differences, many small keys, and logs after a lost checkpoint."""

import math
import os
import shutil

from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import audit, ordered, ranks, similarity
from cuesheet.sources import writers
from cuesheet.streaming import logs

NAN, INF = float("nan"), float("inf")


def wide(spark, odd):
    rows = [(k, "top" if k % 2 else "bottom", odd[k % len(odd)] if k % 3 == 0 else float(k % 17), float(k % 5)) for k in range(300)]
    return spark.createDataFrame(rows, "item long, `group` string, a double, b double")


def test_non_finite_values_are_missing(spark):
    odd, none = wide(spark, [NAN, INF, -INF]), wide(spark, [None])

    def both(fn):
        got, want = (sorted(map(str, fn(x).collect())) for x in (odd, none))
        assert got == want and got

    both(lambda df: ranks.compare_groups(ranks.melt(df, ["group"], ["a", "b"])))
    both(lambda df: ranks.spearman(df, [("a", "b")]))
    both(lambda df: similarity.robust_scale(ranks.melt(df, ["item"], ["a", "b"])))
    both(lambda df: similarity.percentile_table(ranks.melt(df, ["item"], ["a", "b"])))
    assert similarity.moments(odd, ["a", "b"]) == similarity.moments(none, ["a", "b"])
    assert all(math.isfinite(c) for c in ordered.cut_points(odd, "a"))


def test_signed_rank_keeps_keys_without_differences(spark):
    rows = [("zero", 0.0)] * 12 + [("one", float(k)) for k in range(1, 13)] + [("one", NAN)]
    got = {r["key"]: r for r in ranks.signed_rank(spark.createDataFrame(rows, "key string, d double"), "d", ["key"]).collect()}
    assert (got["zero"]["n_pairs"], got["zero"]["n_used"], got["zero"]["p"]) == (12, 0, 1.0)
    assert got["one"]["n_pairs"] == 12 and abs(got["one"]["p"] - 2 / 2**12) < 1e-12
    normal = ranks.signed_rank(spark.createDataFrame(rows, "key string, d double"), "d", ["key"], method="normal")
    assert normal.where("key = 'one'").first()["p"] > 2 / 2**12


def test_values_of_many_small_keys_are_not_broadcast(spark):
    rows = spark.range(4000).select((F.col("id") % 800).alias("key"), (F.col("id") % 4000 / 800).cast("int").alias("value"))
    table = ordered.rank_table(rows, ["key"], "value")
    hot = []
    real = F.broadcast
    try:
        ordered.F.broadcast = lambda df: hot.append(df.count()) or real(df)
        assert ordered.attach_by_value(rows, table, ["key", "value"], "n").count() == 4000
    finally:
        ordered.F.broadcast = real
    assert max(hot) == 0


def test_log_survives_a_lost_checkpoint(spark, tmp_path):
    source, log, mark = (str(tmp_path / x) for x in ("in", "log", "mark"))

    def put(name, ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(f"{source}/{name}")

    def go():
        stream = spark.readStream.schema("id long").parquet(f"{source}/*")
        seen = []
        logs.append_new(stream, ["id"], log, mark, work=lambda df: seen.append(df.count()) or df).awaitTermination()
        return sum(seen), sorted(r["id"] for r in spark.read.parquet(log).collect())

    put("a", [1, 2])
    assert go() == (2, [1, 2])
    assert go() == (0, [1, 2])
    shutil.rmtree(mark)
    assert go() == (0, [1, 2])
    shutil.rmtree(mark)
    shutil.rmtree(f"{source}/a")
    put("b", [2, 3])
    assert go() == (1, [1, 2, 3])


def test_replacement_leaves_one_whole_table(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (2, 3):
        writers.write_table(spark.range(n), path, "numbers")
    assert spark.read.parquet(path).count() == 3 and os.listdir(tmp_path) == ["t"]


def test_strip_and_completeness(spark):
    df = spark.createDataFrame([(" a b ",), (" x  ",)], "s string")
    assert [r[0] for r in df.select(tx.strip("s")).collect()] == ["a b", "x"]
    have = spark.createDataFrame([(1, "a"), (1, "other"), (2, "a"), (2, "b")], "item long, artifact string")
    got = {r["item"]: (r["missing"], r["complete"]) for r in audit.completeness(have, ["a", "b"]).collect()}
    assert got == {1: (["b"], False), 2: ([], True)}
