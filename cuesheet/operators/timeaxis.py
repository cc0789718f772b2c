"""Joins and views along the time axis of an item.

Points, intervals and probes are merged into one ordered stream and resolved by ``ordered.scan``:
no range condition, no pairs, and no window that holds a whole item.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.operators.ordered import scan

KIND = "_kind"


def nearest_point(probes: DataFrame, points: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """Probes with ``offset``, the distance to the nearest point of the same key (NULL without one)."""
    pts = points.select(*keys, t).distinct().select(
        *keys, t, F.lit(0).alias(KIND), F.col(t).alias("_pt")
    )
    both = pts.unionByName(
        probes.withColumn(KIND, F.lit(1)), allowMissingColumns=True
    )
    s = scan(both, keys, [t, KIND], last={"_prev": F.col("_pt")}, after={"_next": F.col("_pt")})
    offset = F.least(F.col(t) - F.col("_prev"), F.col("_next") - F.col(t))
    return s.where(F.col(KIND) == 1).select(*probes.columns, offset.alias("offset"))


def tolerance_share(
    probes: DataFrame, points: DataFrame, keys: Sequence[str], t: str, tol: float
) -> DataFrame:
    """Share of probes per key within ``tol`` of some point; no row where either side is missing."""
    near = nearest_point(probes, points, keys, t)
    s = near.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("offset") <= tol).alias("hits"), F.count("offset").alias("_seen")
    )
    return s.where(F.col("_seen") > 0).drop("_seen").withColumn("share", F.col("hits") / F.col("n"))


def interval_of(
    probes: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    t: str,
    *,
    start: str,
    end: str,
    pos: str,
    is_last: str | None,
    payload: Sequence[str],
) -> DataFrame:
    """As-of join: the interval [start, end) holding the probe.

    With ``is_last`` the last interval is open-ended, else a probe at or past its end has none.
    """
    body = F.struct(*[F.col(c).alias(c) for c in {start, end, pos, *payload, *([is_last] if is_last else [])}])
    opened = intervals.select(
        *keys, F.col(start).alias(t), F.lit(0).alias(KIND), F.col(pos).cast("bigint").alias("_ord"), body.alias("_iv")
    )
    asked = probes.withColumn(KIND, F.lit(1)).withColumn("_ord", F.lit(0).cast("bigint"))
    s = scan(
        opened.unionByName(asked, allowMissingColumns=True), keys, [t, KIND, "_ord"], last={"_hit": F.col("_iv")}
    ).where(F.col(KIND) == 1)
    inside = F.col(t) < F.col(f"_hit.{end}")
    if is_last:
        inside = inside | F.col(f"_hit.{is_last}")
    return s.select(
        *probes.columns, *[F.when(inside, F.col(f"_hit.{c}")).alias(c) for c in payload]
    )


def count_between(
    probes: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    t: str,
    lo: Column,
    hi: Column,
    *,
    closed: bool = False,
    out: str = "n",
) -> DataFrame:
    """Number of points in [lo, hi) (or [lo, hi] when ``closed``) per probe.

    Two boundary rows per probe read a running count; their difference is the answer, so a probe
    never meets the points themselves. ``probes`` must carry keys and ids.
    """
    ask = probes.select(
        *keys,
        *[c for c in ids if c not in keys],
        F.explode(
            F.array(
                F.struct(lo.alias(t), F.lit(0).alias(KIND), F.lit(-1).alias("_sign")),
                F.struct(hi.alias(t), F.lit(2 if closed else 0).alias(KIND), F.lit(1).alias("_sign")),
            )
        ).alias("_b"),
    ).select("*", "_b.*").drop("_b")
    pts = points.groupBy(*keys, t).agg(F.count("*").alias("_cnt")).withColumn(KIND, F.lit(1))
    both = pts.unionByName(ask, allowMissingColumns=True)
    s = scan(both, keys, [t, KIND], running={"_upto": F.coalesce("_cnt", F.lit(0))})
    groups = [*keys, *[c for c in ids if c not in keys]]
    return s.where(F.col("_sign").isNotNull()).groupBy(*groups).agg(
        F.sum(F.col("_sign") * F.col("_upto")).alias(out)
    )


def near_lines(
    probes: DataFrame, lines: DataFrame, keys: Sequence[str], t: str, width: int
) -> DataFrame:
    """Lines in [t − width, t + width) of each probe, one row per pair in the answer.

    Equi-join on time buckets of the window's own width: a line meets only probes at most two
    buckets away, and a crowded bucket is one of many keys of an item.
    """
    cell = lambda c: F.floor(c / width)
    p = probes.withColumn(
        "_cell", F.explode(F.sequence(cell(F.col(t)) - 1, cell(F.col(t)) + 1))
    )
    ln = lines.withColumnRenamed(t, "_lt").withColumn("_cell", cell(F.col("_lt")))
    return p.join(ln, [*keys, "_cell"]).where(
        (F.col("_lt") >= F.col(t) - width) & (F.col("_lt") < F.col(t) + width)
    ).drop("_cell").withColumnRenamed("_lt", f"line_{t}")


def peak_acceleration(
    cuts: DataFrame, items: DataFrame, keys: Sequence[str], t: str, peak: str, duration: str, window: int
) -> DataFrame:
    """Cut rate within ± window of the peak over the overall rate; the window is clipped to the item."""
    lo, hi = F.col(peak) - window, F.col(peak) + window
    inside = count_between(items, cuts, keys, keys, t, lo, hi, closed=True, out="in_window")
    total = cuts.groupBy(*keys).agg(F.count("*").alias("n_cuts"))
    s = items.join(inside, list(keys)).join(total, list(keys))
    span = F.least(hi, F.col(duration)) - F.greatest(lo, F.lit(0))
    rate = F.when(span != 0, F.col("in_window") / span).otherwise(0.0)
    overall = F.col("n_cuts") / F.col(duration)
    return s.withColumn("accel", F.when(F.col(duration) > 0, rate / overall))


def energy_lookup(probes: DataFrame, curve: DataFrame, keys: Sequence[str], t: str, bin_width: int) -> DataFrame:
    """Value of the bin holding t (clamped to the curve), its ratio to the peak and the peak time.

    ``curve`` has one row per (keys, bin). Its per-item facts ride on the bins, so the probes join
    once, on (keys, bin) and not on the item.
    """
    facts = curve.groupBy(*keys).agg(
        F.max("bin").alias("_last"),
        F.max("value").alias("_peak"),
        F.max_by("bin", F.struct("value", -F.col("bin"))).alias("_peak_bin"),
    )
    rows = curve.join(facts, list(keys)).withColumn("_open", F.col("bin") == F.col("_last"))
    p = probes.withColumn("bin", F.greatest(F.floor(F.col(t) / bin_width), F.lit(0)))
    # beyond the last bin the last one answers: an as-of lookup on the bin axis
    got = interval_of(
        p, rows.withColumn("_end", F.col("bin") + 1).withColumnRenamed("bin", "_b"), keys, "bin",
        start="_b", end="_end", pos="_b", is_last="_open", payload=["_b", "value", "_peak", "_peak_bin"],
    )
    return got.select(
        *probes.columns,
        F.col("_b").alias("bin"),
        "value",
        F.when(F.col("_peak") != 0, F.col("value") / F.col("_peak")).alias("ratio_to_peak"),
        (F.col("_peak_bin") * bin_width).alias("peak_at"),
    )


def probe_plan(
    intervals: DataFrame,
    start: str,
    end: str,
    *,
    gap: float = 0.4,
    pairs: int = 3,
    every: float = 5.0,
    most: int = 12,
    fps: float = 24.0,
) -> DataFrame:
    """Frame pairs to probe per interval, one row per pair with both frame numbers.

    Three pairs, or one per 5 s up to twelve, never more than fit; an interval of less than one and
    a half gaps uses half its length as gap. Also carries the mid time.
    """
    # 0.4 * 1.5 in doubles is one step above 0.6, which a length of 0.6 seconds may hit
    least = float(Fraction(str(gap)) * Fraction("1.5"))
    length = F.greatest(F.col(end) - F.col(start), F.lit(0.0))
    step = F.when(length > least, F.lit(gap)).otherwise(F.greatest(F.lit(1.0 / fps), length / 2.0))
    fits = F.floor(length / F.col("gap_s"))
    wanted = F.greatest(F.lit(pairs), F.floor(length / every))
    n = F.when(length > 0, F.greatest(F.lit(1), F.least(F.lit(most), wanted, fits))).otherwise(1)
    rows = intervals.withColumn("gap_s", step).withColumn("n_pairs", n.cast("bigint"))
    rows = rows.withColumn("pair", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pairs") - 1)))
    span = F.greatest(length - F.col("gap_s"), F.lit(0.0))
    t = F.col(start) + (F.col("pair") + 0.5) * span / F.col("n_pairs")
    frame = lambda x: F.floor(x * fps + 0.5)
    first = F.greatest(frame(t), F.lit(0))
    return rows.withColumns({
        "mid_s": (F.col(start) + F.col(end)) / 2.0,
        "frame_a": first,
        "frame_b": F.greatest(first + 1, frame(t + F.col("gap_s"))),
    })
