"""A list of favourites: what its items share, and where that lies in the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.ordered import attach_by_value, quantiles, rank_table
from cuesheet.operators.ranks import melt
from cuesheet.session import materialise

# Limits of the numeric and categorical verdicts.
HIGH_PCT, LOW_PCT, SPREAD_TOL = 70, 30, 0.35
SIGNAL_SHARE, CORPUS_SHARE = 0.8, 0.5


def split_list(favourites: DataFrame, corpus: DataFrame, item: str) -> tuple[DataFrame, DataFrame]:
    """Favourites found in the corpus, and the missing ids."""
    return corpus.join(favourites.select(item), item, "left_semi"), favourites.join(corpus.select(item), item, "left_anti")


def compare_list(rows: DataFrame, features: Sequence[str], keep: Sequence[str], min_n: int = 2) -> DataFrame:
    """n, median, min, max and spread = (max − min)/|median| per feature."""
    long = melt(rows, keep, features)
    s = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.min("value").alias("min"), F.max("value").alias("max")
    ).where(F.col("n") >= min_n)
    s = s.join(quantiles(long, ["feature"], "value", {"median": 0.5}), "feature")
    return s.withColumn(
        "spread_ratio", F.when(F.col("median") != 0, (F.col("max") - F.col("min")) / F.abs("median"))
    )


def top_share(rows: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Most frequent non-empty value per categorical column with its share; ties by value."""
    long = melt(rows, keep, features, "string").where(F.col("value") != "")
    n = long.groupBy("feature", "value").agg(F.count("*").alias("_n"))
    total = n.groupBy("feature").agg(F.sum("_n").alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("_n").desc(), "value")
    top = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    return top.join(total, "feature").select(
        "feature", F.col("value").alias("top"), "n", (F.col("_n") / F.col("n")).alias("share")
    )


def profile_numeric(corpus: DataFrame, favourites: DataFrame, features: Sequence[str], item: str) -> DataFrame:
    """Percentiles of the favourites per feature and the verdict on them.

    Percentiles are midranks in tenths, kept as integers. Only favourites' rows meet the rank table.
    """
    long = melt(corpus, [item], features)
    pct = rank_table(long, ["feature"], "value").select(
        "feature", "value", "n", "n_total",
        F.floor(100.0 * (F.col("n_below") + 0.5 * F.col("n")) / F.col("n_total") * 10.0 + 0.5).alias("pct"),
    )
    # read for the limits and by two quantiles
    fav = materialise(attach_by_value(melt(favourites, [item], features), pct, ["feature", "value"], "n"))
    s = fav.groupBy("feature").agg(
        F.count("*").alias("n"), F.min("value").alias("_min"), F.max("value").alias("_max"),
        F.min("pct").alias("_lo"), F.max("pct").alias("_hi"),
    )
    med = quantiles(fav, ["feature"], "value", {"median": 0.5})
    mid = quantiles(fav, ["feature"], "pct", {"_mid": 0.5})
    s = s.join(med, "feature").join(mid, "feature")
    spread = F.when(F.col("median") != 0, (F.col("_max") - F.col("_min")) / F.abs("median"))
    s = s.withColumn("spread_ratio", spread)
    tenths = lambda p: p * 10
    return s.select(
        "feature", "n", "median",
        (F.floor(F.col("_mid") / 10.0 * 10.0 + 0.5) / 10.0).alias("median_pct"),
        (F.col("_lo") / 10.0).alias("min_pct"),
        (F.col("_hi") / 10.0).alias("max_pct"),
        "spread_ratio",
        F.when(F.col("_lo") >= tenths(HIGH_PCT), "distinct-high")
        .when(F.col("_hi") <= tenths(LOW_PCT), "distinct-low")
        .when(
            F.col("spread_ratio") <= SPREAD_TOL,
            F.when((F.col("_mid") > tenths(LOW_PCT)) & (F.col("_mid") < tenths(HIGH_PCT)), "convention").otherwise("shared"),
        )
        .otherwise("irrelevant").alias("verdict"),
    )


def profile_categorical(corpus: DataFrame, favourites: DataFrame, features: Sequence[str], item: str) -> DataFrame:
    top = top_share(favourites, features, [item])
    pool = melt(corpus, [item], features, "string").where(F.col("value") != "")
    # one row per column
    share = pool.join(F.broadcast(top.select("feature", "top")), "feature").groupBy("feature").agg(
        (F.count_if(F.col("value") == F.col("top")) / F.count("*")).alias("corpus_share")
    )
    s = top.join(share, "feature")
    return s.withColumn(
        "verdict",
        F.when((F.col("share") >= SIGNAL_SHARE) & (F.col("corpus_share") < CORPUS_SHARE), "signal")
        .when(F.col("corpus_share") >= CORPUS_SHARE, "convention").otherwise("mixed"),
    )
