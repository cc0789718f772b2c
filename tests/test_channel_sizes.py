"""Small channels in one pass give what the rounds give, and move their rows once."""

import random

from pyspark.sql import functions as F

from cuesheet.operators import matching

HOW = {"id_": "item", "channel": "ch", "day": "day", "span": "x", "seq": "item"}


def rows(spark, n=600, seed=4):
    rng = random.Random(seed)
    made = [(i, rng.choice([1, 1, 1, 2, 3, 4, None]), rng.randrange(12) * 30, float(rng.randrange(4)), rng.random() < 0.4) for i in range(n)]
    made += [(n, 9, 5, float("nan"), True), (n + 1, 9, 5, float("nan"), False), (n + 2, 9, 5, 1.0, False), (n + 3, 9, None, 1.0, False)]
    return spark.createDataFrame(made, "item long, ch long, day long, x double, prem boolean")


def pairs(df):
    return sorted((r["channel"], r["treated"], r["control"], r["days"], str(r["gap"])) for r in df.collect())


def test_one_pass_equals_rounds(spark):
    how = {**HOW, "treated": F.col("prem")}
    df = rows(spark).where("not isnan(x)")
    want = pairs(matching.match_in_channel(df, **how, crowded=0))
    assert len(want) > 150
    assert pairs(matching.match_in_channel(df, **how)) == want
    assert pairs(matching.match_in_channel(df, **how, crowded=120)) == want


def test_small_channels_take_few_jobs(spark):
    sc = spark.sparkContext
    sc.setJobGroup("small", "small channels")
    df = rows(spark)
    matching.match_in_channel(df, **{**HOW, "treated": F.col("prem")}).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("small"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
