"""Tables of distinct values stay on the executors, however few bytes their files have."""

from pyspark.sql import functions as F

from cuesheet.operators import profile, similarity
from cuesheet.operators.ordered import attach_by_value, rank_table, scan
from cuesheet.session import materialise


def broadcasts(df):
    """Rows of every broadcast of a plan that has run."""
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if name == "BroadcastExchangeExec":
                found.append(p.metrics().apply("numOutputRows").value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return found


def test_only_hot_values_are_broadcast(spark):
    rows = materialise(spark.range(20_000).select(F.lit("f").alias("feature"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(F.col("id").cast("double")).alias("value")))
    out = attach_by_value(rows, rank_table(rows, ["feature"], "value"), ["feature", "value"], "n")
    assert out.count() == 20_000
    assert max(broadcasts(out)) < 100


def test_profile_sends_no_value_table_to_the_driver(spark):
    df = materialise(spark.range(20_000).select(F.col("id").alias("item"), F.col("id").cast("double").alias("x")))
    out = profile.profile_numeric(df, df.where("item % 3001 = 5"), ["x"], "item")
    assert [(r["n"], r["median"]) for r in out.collect()] == [(7, 9008.0)]
    assert max(broadcasts(out), default=0) < 100


def test_scan_with_many_keys_broadcasts_none_of_them(spark):
    df = materialise(spark.range(20_000).select((F.col("id") / 2).cast("long").alias("k"), F.col("id").alias("t")))
    assert max(broadcasts(scan(df, ["k"], ["t"], running={"n": F.lit(1)})), default=0) < 100


def test_evidence_sends_no_value_table_to_the_driver(spark):
    df = materialise(spark.range(20_000).select(F.col("id").alias("item"), F.col("id").cast("double").alias("x")))
    out = similarity.evidence(df, df.where("item % 97 = 11"), ["x"])
    assert out.count() == 207
    assert max(broadcasts(out), default=0) < 100
