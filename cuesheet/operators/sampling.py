"""Population filter and the samplers: capped extremes, middle band, stratified labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.text import EXCLUDE_TITLE, REQUIRED_MARKER, nfkc
from cuesheet.operators.ordered import quantiles


def population_filter(
    df: DataFrame,
    *,
    min_subs: float = 1000,
    min_dur: float = 60,
    max_dur: float = 600,
    date_from: str = "20250401",
    date_to: str = "20260401",
    require_marker: bool = False,
    normalise: bool = True,
) -> DataFrame:
    """Keep items fit for sampling; both date bounds are inside.

    Unknown subscribers and durations count as 0, unknown dimensions pass the portrait test. The
    cheap comparisons come first in one ``where`` and reach the scan; the title patterns follow.
    """
    cheap = (
        F.col("ratio").isNotNull()
        & (F.coalesce("subs", F.lit(0)) >= min_subs)
        & F.coalesce("duration_s", F.lit(0.0)).between(min_dur, max_dur)
        & F.coalesce("upload_date", F.lit("")).between(date_from, date_to)
        & ~F.coalesce(
            (F.col("width") > 0) & (F.col("height") > 0) & (F.col("height") > F.col("width")),
            F.lit(False),
        )
    )
    title = F.coalesce("title", F.lit(""))
    title = nfkc(title) if normalise else title
    out = df.where(cheap).where(~title.rlike("(?iu)" + EXCLUDE_TITLE))
    return out.where(title.rlike("(?iu)" + REQUIRED_MARKER)) if require_marker else out


def last_row_wins(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Deduplicate by key, keeping the row with the highest ``seq``.

    An aggregate, not a window: copies of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def capped(
    df: DataFrame, order: Sequence[Column], n: int, cap: int, channel: str, by: Sequence[str] = ()
) -> DataFrame:
    """First ``n`` rows in ``order`` with at most ``cap`` per channel (per ``by`` group).

    Walking a sorted list and skipping full channels keeps exactly the rows whose rank inside
    their channel is within the cap. ``row_number <= k`` is cut to k rows per task before the
    shuffle, so a hot channel moves no more than a small one.
    """
    rank = F.row_number().over(Window.partitionBy(*by, channel).orderBy(*order))
    kept = df.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")
    if not by:
        return kept.orderBy(*order).limit(n)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return kept.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")


def extremes(
    df: DataFrame,
    n: int = 25,
    cap: int = 2,
    *,
    item: str = "item",
    ratio: str = "ratio",
    channel: str = "channel",
    by: Sequence[str] = (),
) -> DataFrame:
    """Top and bottom ``n`` by ratio with a channel cap; ties by item id, bottom excludes top."""
    top = capped(df, [F.col(ratio).desc(), F.col(item)], n, cap, channel, by)
    # at most n ids per `by` group
    rest = df.join(F.broadcast(top.select(item)) if not by else top.select(item), item, "left_anti")
    bottom = capped(rest, [F.col(ratio), F.col(item)], n, cap, channel, by)
    return top.withColumn("group", F.lit("top")).unionByName(
        bottom.withColumn("group", F.lit("bottom"))
    )


def middle_band(
    df: DataFrame,
    n: int = 25,
    cap: int = 2,
    *,
    lo: float = 0.4,
    hi: float = 0.6,
    exclude: DataFrame | None = None,
    item: str = "item",
    ratio: str = "ratio",
    channel: str = "channel",
) -> DataFrame:
    """Items between two percentiles of the full list, nearest to the median first."""
    cuts = quantiles(df, [], ratio, {"lo": lo, "hi": hi, "mid": 0.5}).first()
    if cuts is None or cuts["mid"] is None:
        return df.where(F.lit(False)).withColumn("group", F.lit("middle"))
    band = df.where(F.col(ratio).between(cuts["lo"], cuts["hi"]))
    if exclude is not None:
        band = band.join(exclude.select(item), item, "left_anti")
    order = [F.abs(F.col(ratio) - F.lit(cuts["mid"])), F.col(item)]
    return capped(band, order, n, cap, channel).withColumn("group", F.lit("middle"))


def expansion_feasibility(
    df: DataFrame, by: Sequence[str], n: int = 40, cap: int = 2, **columns: str
) -> DataFrame:
    """How many rows per group a larger sample could have under the cap."""
    counts = df.groupBy(*by).agg(F.count("*").alias("eligible_population"))
    picked = extremes(df, n, cap, by=by, **columns).groupBy(*by).agg(
        F.count_if(F.col("group") == "top").alias("max_top"),
        F.count_if(F.col("group") == "bottom").alias("max_bottom"),
    )
    out = counts.join(picked, list(by), "left").na.fill(0, ["max_top", "max_bottom"])
    return out.withColumn("feasible", (F.col("max_top") >= n) & (F.col("max_bottom") >= n))


def stratified(
    df: DataFrame, cls: str, classes: Sequence[str], n: int, seed: int, item: str
) -> DataFrame:
    """Equal share per class, the rest filled from all rows, shuffled and numbered.

    Order is by md5 of seed and id, so the sample is the same on every run and partitioning.
    """
    per = max(1, n // max(1, len(classes)))
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(item).cast("string")))
    rows = df.where(F.col(cls).isin(*classes)).withColumn("_draw", draw)
    rank = F.row_number().over(Window.partitionBy(cls).orderBy("_draw"))
    first = rows.withColumn("_r", rank).where(F.col("_r") <= per).drop("_r").withColumn("_fill", F.lit(0))
    # the n smallest draws overall contain every row the filling can need
    rest = rows.orderBy("_draw").limit(n).withColumn("_fill", F.lit(1))
    both = first.unionByName(rest)
    keys = [c for c in both.columns if c != "_fill"]
    picked = both.groupBy(*keys).agg(F.min("_fill").alias("_fill")).orderBy("_fill", "_draw").limit(n)
    shuffle = F.md5(F.concat_ws(":", F.lit(f"{seed}+shuffle"), F.col(item).cast("string")))
    number = F.row_number().over(Window.orderBy(shuffle))  # n rows
    return picked.select(
        *df.columns, F.concat(F.lit("m"), F.lpad(number.cast("string"), 3, "0")).alias("label_id")
    )
