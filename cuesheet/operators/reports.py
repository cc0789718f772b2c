"""Reports over test results: replication, gate, headline, attrition, constructs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.operators.ranks import spearman

Q_MAX, DELTA_MIN, P_MAX = 0.05, 0.33, 0.05


def replication(results: DataFrame, domain_a: str, domain_b: str, domain: str = "domain") -> DataFrame:
    """Features significant in both domains with one sign, or only in one of them."""
    side = lambda d, s: results.where(F.col(domain) == d).select(
        "feature", F.col("delta").alias(f"delta_{s}"), F.col("q").alias(f"q_{s}")
    )
    both = side(domain_a, "a").join(side(domain_b, "b"), "feature", "full_outer")
    sig_a, sig_b = F.col("q_a") < Q_MAX, F.col("q_b") < Q_MAX
    return both.withColumn(
        "replicates",
        F.when(sig_a & sig_b & (F.signum("delta_a") == F.signum("delta_b")), "both")
        .when(sig_a & (F.col("q_b") >= Q_MAX), "first only")
        .when(sig_b & (F.col("q_a") >= Q_MAX), "second only")
        .otherwise("neither"),
    )


def gate(results: DataFrame, matched: DataFrame) -> DataFrame:
    """Pass when any effect or any non-auxiliary matched comparison clears its limits."""
    hit = (F.col("q") < Q_MAX) & (F.abs("delta") >= DELTA_MIN)
    a = results.select("feature", "domain", F.coalesce(hit, F.lit(False)).alias("hit"))
    m_hit = ~F.col("auxiliary") & (F.col("p") < P_MAX)
    b = matched.select(
        F.lit("matched").alias("feature"), "domain", F.coalesce(m_hit, F.lit(False)).alias("hit")
    )
    return a.unionByName(b).agg(
        F.count_if("hit").alias("n_hits"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("passed")
    )


def headline(results: DataFrame, k: int = 10, min_abs: float = 0.0, tie: Sequence[str] = ("feature",)) -> DataFrame:
    """The k largest effects."""
    rows = results.where(F.abs("delta") >= min_abs) if min_abs else results
    return rows.orderBy(F.abs("delta").desc(), *tie).limit(k)


def dominant_source(df: DataFrame, keys: Sequence[str], source: str) -> DataFrame:
    """The most frequent source per key; a tie goes to the smaller name."""
    n = df.where(F.col(source).isNotNull()).groupBy(*keys, source).agg(F.count("*").alias("_n"))
    low = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), source)
    return n.withColumn("_r", F.row_number().over(low)).where(F.col("_r") == 1).drop("_r", "_n")


def attrition(df: DataFrame, keys: Sequence[str], has_source: Column, passed: Column) -> DataFrame:
    with_source, ok = F.count_if(has_source), F.count_if(has_source & passed)
    return df.groupBy(*keys).agg(
        F.count("*").alias("total"), with_source.alias("with_source"), ok.alias("passed"),
        F.when(with_source > 0, ok / with_source).alias("share"),
    )


def standardise(df: DataFrame, features: Sequence[str], eps: float = 0.0) -> dict[str, Column]:
    """z columns from one aggregate row; population deviation, NULL stays NULL."""
    row = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
    ).first()
    out = {}
    for f in features:
        m, s = row[f"m_{f}"], row[f"s_{f}"]
        ok = m is not None and (s or 0.0) + eps > 0
        out[f] = (F.col(f) - F.lit(m)) / F.lit(s + eps) if ok else F.lit(None).cast("double")
    return out


def row_mean(cols: Sequence[Column]) -> Column:
    """Mean of the non-null columns of a row, NULL when there are none."""
    n = sum((c.isNotNull().cast("int") for c in cols), F.lit(0))
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, total / n)


def construct(df: DataFrame, plus: Sequence[str], minus: Sequence[str] = (), eps: float = 1e-9) -> Column:
    """Composite score: mean z of the features, the ``minus`` ones with flipped sign."""
    z = standardise(df, [*plus, *minus], eps)
    return row_mean([*[z[f] for f in plus], *[-z[f] for f in minus]])


def coherence(df: DataFrame, block: Sequence[str]) -> DataFrame:
    """Mean absolute rank correlation inside a block of features."""
    pairs = [(a, b) for i, a in enumerate(block) for b in block[i + 1 :]]
    return spearman(df, pairs).agg(F.avg(F.abs("rho")).alias("coherence"), F.count("*").alias("n_pairs"))
