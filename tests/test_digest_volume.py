"""Row digests are shuffled once and never written; ranges too large for a task have the same digest."""

from pyspark.sql import functions as F

from cuesheet.operators import digest_tree


def made(spark):
    ids = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, None).otherwise(F.col("id"))
    return spark.range(9000).select(ids.alias("id"), (F.col("id") % 4000).cast("string").alias("v"))


def test_large_ranges_have_the_same_digest(spark):
    rows = lambda **how: sorted(map(tuple, digest_tree.ranges(made(spark), "id", leaf=64, **how).collect()), key=str)
    want = rows()
    assert len(want) == 10 and sum(r[2] for r in want) == 9000
    assert rows(task=1000) == want


def test_no_row_digest_is_written(spark, monkeypatch):
    written, plain = [], digest_tree.materialise

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(digest_tree, "materialise", counted)
    digest_tree.ranges(made(spark), "id").collect()
    assert sum(written) < 100
