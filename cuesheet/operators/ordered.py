"""Ordered computations that survive a hot key.

A window or an exact percentile per key puts the whole key into one task. Everything here first
cuts the order axis at pooled quantiles: with N cuts, a (key, bucket) cell holds at most about
1/N of *all* rows, whatever share of them one key owns. Work inside a cell is an ordinary window;
what a cell needs from its neighbours is a one-row summary per cell, prefixed over at most N
buckets per key and joined back on (key, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.numbers import finite
from cuesheet.session import materialise

BUCKET = "_bucket"


def cut_points(df: DataFrame, col: str, n: int | None = None) -> list[float]:
    """At most ``n - 1`` pooled quantiles of ``col``.

    One map-side combined aggregate returning a single row of bounded width. Any cut points give
    right results; they only balance the cells. They are fixed as literals so that both branches
    of a plan agree on the cells even when a stage is run again.
    """
    if n is None:
        n = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probs = [i / n for i in range(1, n)]
    row = df.agg(
        F.percentile_approx(finite(col), probs, 8 * n).alias("cuts")
    ).first()
    return sorted(set(row["cuts"] or []))


def with_bucket(df: DataFrame, col: str, cuts: Sequence[float], out: str = BUCKET) -> DataFrame:
    """Add the index of the cell of ``col`` (binary search in the JVM)."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *cuts, float("inf")]
    tmp = df.withColumn("_axis", F.col(col).cast("double"))
    cells = Bucketizer(splits=splits, inputCol="_axis", outputCol="_cell", handleInvalid="keep")
    return cells.transform(tmp).withColumn(out, F.col("_cell").cast("int")).drop("_axis", "_cell")


def rank_table(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weights: dict[str, Column] | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Distinct values per key with their counts, the counts below and the totals.

    Output: keys, value, and for every weight ``w`` the columns ``w``, ``w_below``, ``w_total``.
    Ties collapse in the first map-side aggregation, so a value shared by a third of all rows is
    one row afterwards.
    """
    keys = list(keys)
    weights = weights or {"n": F.lit(1)}
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(*[F.sum(w.cast("bigint")).alias(n) for n, w in weights.items()])
    )
    cuts = cut_points(df, value) if cuts is None else cuts
    counts = with_bucket(counts, value, cuts)
    over_key = Window.partitionBy(*keys)
    before = over_key.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy(*keys, BUCKET).agg(*[F.sum(n).alias(f"{n}_cell") for n in weights])
    cells = cells.select(
        *keys,
        BUCKET,
        *[F.coalesce(F.sum(f"{n}_cell").over(before), F.lit(0)).alias(f"{n}_carry") for n in weights],
        *[F.sum(f"{n}_cell").over(over_key).alias(f"{n}_total") for n in weights],
    )
    inside = (
        Window.partitionBy(*keys, BUCKET)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = counts.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"{n}_local") for n in weights]
    )
    # both sides lie by key and cell; hinted, as with many keys the cells are no table for the driver
    out = local.join(cells.hint("merge"), [*keys, BUCKET])
    return out.select(
        *keys,
        value,
        *[
            c
            for n in weights
            for c in (
                F.col(n),
                (F.col(f"{n}_local") + F.col(f"{n}_carry")).alias(f"{n}_below"),
                F.col(f"{n}_total"),
            )
        ],
    )


def nth(value: str, index: Column, weight: str = "n") -> Column:
    """Aggregate over a rank table: the value at 0-based sorted position ``index``."""
    below = F.col(f"{weight}_below")
    return F.max(F.when((below <= index) & (index < below + F.col(weight)), F.col(value)))


def linear_quantile(value: str, p: float, weight: str = "n") -> Column:
    """Aggregate over a rank table: interpolated quantile at position p·(n−1)."""
    h = (F.col(f"{weight}_total") - 1) * F.lit(float(p))
    lo, hi = F.floor(h), F.ceil(h)
    frac = F.max(h - lo)
    a, b = nth(value, lo, weight), nth(value, hi, weight)
    return a + (b - a) * frac


def median_of(value: str, weight: str = "n") -> Column:
    """Aggregate over a rank table: mean of the two middle values."""
    total = F.col(f"{weight}_total")
    lo = F.floor((total - 1) / 2)
    hi = F.floor(total / 2)
    return (nth(value, lo, weight) + nth(value, hi, weight)) / F.lit(2.0)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key, without holding a key in one task."""
    table = rank_table(df, keys, value, cuts=cuts)
    aggs = [
        (median_of(value) if p == 0.5 else linear_quantile(value, p)).alias(name)
        for name, p in probs.items()
    ]
    return table.groupBy(*keys).agg(*aggs)


def attach_by_value(
    rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str, parts: int | None = None
) -> DataFrame:
    """Join a rank table back to its rows, splitting off the hot values.

    A value with more than ``1 / parts`` of *all* rows is hot, so fewer than ``parts`` values are, however many
    keys there are: that part of the table is safe to broadcast. The rest joins by shuffle, where no value can
    exceed that share. The rest is hinted to do so: a few MB of Parquet hold several hundred thousand values, which
    Spark would collect on the driver and broadcast.
    """
    on = list(on)
    if parts is None:
        parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = materialise(table)
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    is_hot = F.col(weight) * F.lit(parts) > F.lit(total)
    hot = F.broadcast(table.where(is_hot))
    by_hot = rows.join(hot, on)
    by_shuffle = rows.join(F.broadcast(table.where(is_hot).select(*on)), on, "left_anti").join(
        table.where(~is_hot).hint("merge"), on
    )
    return by_hot.unionByName(by_shuffle)


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    after: dict[str, Column] | None = None,
    running: dict[str, Column] | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """Running values along an ordered axis per key.

    last     last non-null value up to and including the row
    before   last non-null value strictly before the row (a lag that skips nulls)
    after    first non-null value strictly after the row (a lead that skips nulls)
    running  sum up to and including the row

    ``order[0]`` is numeric and decides the cell; the remaining columns break ties.
    """
    keys, order = list(keys), list(order)
    last, before, after, running = last or {}, before or {}, after or {}, running or {}
    cuts = cut_points(df, order[0]) if cuts is None else cuts
    rows = with_bucket(df, order[0], cuts)
    sources = {
        **{f"_s_{n}": c for n, c in {**last, **before, **after}.items()},
        **{f"_s_{n}": c.cast("bigint") for n, c in running.items()},
    }
    rows = rows.withColumns(sources) if sources else rows

    cell = Window.partitionBy(*keys, BUCKET)
    asc = cell.orderBy(*order)
    desc = cell.orderBy(*[F.col(c).desc() for c in order])
    upto = Window.unboundedPreceding
    local = rows.select(
        "*",
        *[
            F.last(f"_s_{n}", ignorenulls=True).over(asc.rowsBetween(upto, 0)).alias(f"_l_{n}")
            for n in last
        ],
        *[
            F.last(f"_s_{n}", ignorenulls=True).over(asc.rowsBetween(upto, -1)).alias(f"_l_{n}")
            for n in before
        ],
        *[F.sum(f"_s_{n}").over(asc.rowsBetween(upto, 0)).alias(f"_l_{n}") for n in running],
        *[
            F.last(f"_s_{n}", ignorenulls=True).over(desc.rowsBetween(upto, -1)).alias(f"_l_{n}")
            for n in after
        ],
    )
    at = F.struct(*order)
    summary = rows.groupBy(*keys, BUCKET).agg(
        *[
            F.max_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), at)).alias(f"_c_{n}")
            for n in {**last, **before}
        ],
        *[
            F.min_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), at)).alias(f"_c_{n}")
            for n in after
        ],
        *[F.sum(f"_s_{n}").alias(f"_c_{n}") for n in running],
    )
    by_key = Window.partitionBy(*keys)
    earlier = by_key.orderBy(BUCKET).rowsBetween(upto, -1)
    later = by_key.orderBy(F.col(BUCKET).desc()).rowsBetween(upto, -1)
    carry = summary.select(
        *keys,
        BUCKET,
        *[
            F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}")
            for n in {**last, **before}
        ],
        *[F.last(f"_c_{n}", ignorenulls=True).over(later).alias(f"_p_{n}") for n in after],
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_p_{n}") for n in running],
    )
    joined = local.join(carry.hint("merge"), [*keys, BUCKET])
    return joined.select(
        *df.columns,
        *[
            F.coalesce(f"_l_{n}", f"_p_{n}").alias(n) for n in {**last, **before, **after}
        ],
        *[
            (F.coalesce(f"_l_{n}", F.lit(0)) + F.coalesce(f"_p_{n}", F.lit(0))).alias(n)
            for n in running
        ],
    )
