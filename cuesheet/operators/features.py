"""Per-item features from scenes, labels, beats, lines and curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.operators.ordered import nth, quantiles, rank_table, scan


def scene_summary(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, shot lengths in seconds, cuts per minute, mean brightness and saturation.

    ``scenes`` has start_ms, end_ms, len_ms and bright_pct, sat_pct as integers: integer sums make
    the means independent of the order of rows.
    """
    base = scenes.groupBy(*keys).agg(
        F.count("*").alias("num_scenes"),
        F.max("end_ms").alias("_dur"),
        F.sum("len_ms").alias("_len"),
        F.min("len_ms").alias("_min"),
        F.max("len_ms").alias("_max"),
        F.sum("bright_pct").alias("_b"),
        F.sum("sat_pct").alias("_s"),
    )
    med = quantiles(scenes, keys, "len_ms", {"_med": 0.5})
    n = F.col("num_scenes")
    return base.join(med, list(keys)).select(
        *keys,
        "num_scenes",
        rnd(F.col("_dur") / 1000.0, 2).alias("duration_s"),
        rnd(F.col("_len") / n / 1000.0, 2).alias("avg_shot_len_s"),
        rnd(F.col("_med") / 1000.0, 2).alias("median_shot_len_s"),
        rnd(F.col("_min") / 1000.0, 2).alias("min_shot_len_s"),
        rnd(F.col("_max") / 1000.0, 2).alias("max_shot_len_s"),
        F.when(F.col("_dur") > 0, rnd(n / (F.col("_dur") / 60000.0), 1)).alias("cuts_per_minute"),
        rnd(F.col("_b") / n / 100.0, 3).alias("avg_brightness"),
        rnd(F.col("_s") / n / 100.0, 3).alias("avg_saturation"),
    )


def first_mode(df: DataFrame, keys: Sequence[str], value: str, pos: str, out: str) -> DataFrame:
    """Most frequent value; a tie goes to the one seen first."""
    per = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count("*").alias("_n"), F.min(pos).alias("_first")
    )
    return per.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(out))


def tag_rollup(tags: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = F.count("*")
    shares = tags.groupBy(*keys).agg(
        n.alias("n_tags"),
        rnd(F.count_if(F.col("shot_type") == "closeup") / n, 3).alias("closeup_ratio"),
        rnd(F.count_if(F.col("shot_type") == "wide") / n, 3).alias("wide_ratio"),
        rnd(F.sum(F.coalesce("num_characters", F.lit(0))) / n, 2).alias("avg_characters"),
        rnd(F.count_if("has_text") / n, 3).alias("text_ratio"),
    )
    for col in ("style", "mood"):
        shares = shares.join(first_mode(tags, keys, col, "pos", f"{col}_top"), list(keys), "left")
    return shares


def hook_features(cuts: DataFrame, curve: DataFrame, keys: Sequence[str], duration_s: float) -> DataFrame:
    """Cuts in (0, 15] s, first-bin energy over the mean, peak position over the duration."""
    hook = cuts.groupBy(*keys).agg(
        F.count_if((F.col("start_ms") > 0) & (F.col("start_ms") <= 15000)).alias("cuts_first_15s")
    )
    c = curve.groupBy(*keys).agg(
        F.sum("value").alias("_sum"),
        F.count("*").alias("_n"),
        F.max(F.when(F.col("bin") == 0, F.col("value"))).alias("_first"),
        F.max_by("bin", F.struct("value", -F.col("bin"))).alias("_peak"),
    )
    mean = F.col("_sum") / F.col("_n")
    return hook.join(c, list(keys), "full_outer").select(
        *keys,
        F.coalesce("cuts_first_15s", F.lit(0)).alias("cuts_first_15s"),
        F.when(mean != 0, rnd(F.col("_first") / mean, 3)).alias("energy_first_ratio"),
        rnd(F.col("_peak") * 10.0 / duration_s, 3).alias("peak_energy_ratio"),
    )


def hex_channel(color, i: int) -> Column:
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("bigint")


def is_color(color) -> Column:
    return F.col(color).rlike("^#[0-9a-fA-F]{6}$")


def colour_dynamics(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deviation of brightness and saturation, colour change between neighbours, distinct share."""
    n = F.count("*")

    def dev(c):
        var = (n * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c)) / (n * n)
        return rnd(F.sqrt(var) / 100.0, 4)

    base = scenes.groupBy(*keys).agg(
        dev("bright_pct").alias("brightness_std"), dev("sat_pct").alias("saturation_std")
    )
    colored = scenes.where(is_color("color"))
    shade = colored.groupBy(*keys, "color").agg(F.count("*").alias("_n")).groupBy(*keys).agg(
        F.sum("_n").alias("_all"), F.count("*").alias("_distinct")
    )
    s = scan(colored, keys, ["start_ms", "pos"], before={"_prev": F.col("color")})
    sq = sum(
        ((hex_channel("color", i) - hex_channel("_prev", i)) * (hex_channel("color", i) - hex_channel("_prev", i)) for i in range(3)),
        F.lit(0),
    )
    steps = s.where(F.col("_prev").isNotNull()).select(*keys, sq.alias("d2"))
    # squared distances are integers: distinct values per item are few and exact
    table = rank_table(steps, keys, "d2")
    dist = lambda c: F.sqrt(c) / 255.0 / F.sqrt(F.lit(3.0))
    change = table.groupBy(*keys).agg(
        (F.sum(F.col("n") * dist(F.col("d2"))) / F.max("n_total")).alias("_mean"),
        nth("d2", F.ceil(F.lit(0.9) * F.col("n_total")) - 1).alias("_p90"),
    )
    out = base.join(shade, list(keys), "left").join(change, list(keys), "left")
    some = F.col("_all") > 0
    return out.select(
        *keys, "brightness_std", "saturation_std",
        F.coalesce(rnd("_mean", 4), F.when(some, 0.0)).alias("color_change_mean"),
        F.coalesce(rnd(dist(F.col("_p90")), 4), F.when(some, 0.0)).alias("color_change_p90"),
        F.when(some, rnd(F.col("_distinct") / F.col("_all"), 4)).alias("color_unique_ratio"),
    )


def hue_bucket(color) -> Column:
    """Eight hues, dark and grey from the HSV of a #rrggbb colour."""
    r, g, b = (hex_channel(color, i) / 255.0 for i in range(3))
    hi, lo = F.greatest(r, g, b), F.least(r, g, b)
    c = hi - lo
    sat = F.when(hi > 0, c / hi).otherwise(0.0)
    hue = (
        F.when(c == 0, 0.0)
        .when(hi == r, F.pmod((g - b) / c, F.lit(6.0)))
        .when(hi == g, (b - r) / c + 2.0)
        .otherwise((r - g) / c + 4.0)
    ) * 60.0
    # fixed values: bucket names in hue order, limits of dark and grey
    names = F.array(*[F.lit(x) for x in ("red", "orange", "yellow", "green", "cyan", "blue", "violet", "magenta")])
    index = F.floor((hue + 22.5) / 45.0).cast("int") % 8
    return F.when(is_color(color), F.when(hi < 0.2, "dark").when(sat < 0.15, "grey").otherwise(F.element_at(names, index + 1)))


def palette(scenes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of each colour bucket per item, weighted by scene length; in units of 1e-4."""
    w = scenes.withColumn("bucket", hue_bucket("color")).where(F.col("bucket").isNotNull())
    w = w.groupBy(*keys, "bucket").agg(F.sum("len_ms").alias("_w"))
    # an item has at most ten buckets
    total = Window.partitionBy(*keys)
    return w.withColumn("_t", F.sum("_w").over(total)).where(F.col("_t") > 0).select(
        *keys, "bucket", F.floor(F.col("_w") / F.col("_t") * 10000.0 + 0.5).alias("share_e4")
    )


def mean_palette(shares: DataFrame, items: Column | int, out: str) -> DataFrame:
    """Mean share per bucket over all items that have a palette; an absent bucket counts 0."""
    return shares.groupBy("bucket").agg((F.sum("share_e4") / items / 10000.0).alias(out))


def top_colours(scenes: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    w = scenes.where(is_color("color")).groupBy(*keys, "color").agg(F.sum("len_ms").alias("weight_ms"))
    order = Window.partitionBy(*keys).orderBy(F.col("weight_ms").desc(), "color")
    return w.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def energy_level(ratio) -> Column:
    r = F.col(ratio)
    return F.when(r.isNull(), "unknown").when(r >= 0.8, "high").when(r >= 0.5, "medium").otherwise("low")


def pacing_style(cpm, beat_ratio) -> Column:
    c, b = F.coalesce(cpm, F.lit(0.0)), F.coalesce(beat_ratio, F.lit(0.0))
    speed = F.when(c >= 20, "fast").when(c >= 10, "medium").otherwise("slow")
    return F.concat(speed, F.lit("_cut"), F.when(b >= 0.4, "_beat_locked").otherwise(""))


def curve_features(curve: DataFrame, keys: Sequence[str], duration_s: float) -> DataFrame:
    """Slope of the first 30 s (3 bins or more) and the peak after the first 5 %."""
    mid = (F.col("start_time") + F.col("end_time")) / 2.0
    c = curve.withColumn("_mid", mid)
    early, late = F.col("_mid") <= 30.0, F.col("_mid") >= duration_s * 0.05
    s = c.groupBy(*keys).agg(
        F.count_if(early).alias("_n"),
        F.regr_slope(F.when(early, F.col("value")), F.when(early, F.col("_mid"))).alias("_slope"),
        F.max_by(
            F.struct("_mid", "value"), F.when(late, F.struct("value", -F.col("_mid")))
        ).alias("_peak"),
    )
    return s.select(
        *keys,
        F.when(F.col("_n") >= 3, rnd("_slope", 6)).alias("slope_first_30s"),
        rnd(F.col("_peak._mid") / duration_s, 4).alias("peak_at_ratio"),
        F.col("_peak.value").alias("peak_value"),
    )


def mean_curve(curve: DataFrame, keys: Sequence[str], by: str, bins: int = 100) -> DataFrame:
    """Mean curve per group over items with exactly ``bins`` bins."""
    full = curve.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == bins).select(*keys)
    return curve.join(full, list(keys), "left_semi").groupBy(by, "bin").agg(
        (F.sum("value") / F.count("*")).alias("mean_value"), F.count("*").alias("n_items")
    )


def motion_summary(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Class shares by count and by time; unknown classes are counted apart."""
    known = F.col("motion_type").isin("static_image", "animated_still", "motion_clip")
    n = F.count_if(known)
    share = lambda k: rnd(F.count_if(F.col("motion_type") == k) / n, 4)
    length = F.greatest(F.col("len_ms"), F.lit(0))
    total = F.sum(F.when(known, length))
    clip = F.sum(F.when(F.col("motion_type") == "motion_clip", length).otherwise(0))
    base = rows.groupBy(*keys).agg(
        n.alias("n_known"),
        (F.count("*") - n).alias("n_unknown"),
        F.when(n > 0, share("static_image")).alias("static_ratio"),
        F.when(n > 0, share("animated_still")).alias("animated_still_ratio"),
        F.when(n > 0, share("motion_clip")).alias("clip_ratio"),
        F.when(total > 0, rnd(clip / total, 4)).alias("clip_time_ratio"),
    )
    med = quantiles(rows.where(known), keys, "flow_mag", {"flow_mag_median": 0.5, "flow_mag_p90": 0.9})
    return base.join(med, list(keys), "left")


def motion_class(mean, variance, static: float = 0.5, clip: float = 2.0) -> Column:
    """Class from flow magnitude and its spread over an already measured table."""
    m, v = F.col(mean), F.col(variance)
    return F.when(m.isNull() | v.isNull(), "unknown").when(m < static, "static_image").when(
        v < clip, "animated_still"
    ).otherwise("motion_clip")


def motion_class_split(global_motion, residual, static: float = 0.35, clip: float = 0.45) -> Column:
    """Second form: whole-frame motion against what is left after removing it."""
    g, r = F.col(global_motion), F.col(residual)
    return F.when(g.isNull() | r.isNull(), "unknown").when(r >= clip, "motion_clip").when(
        g >= static, "animated_still"
    ).otherwise("static_image")


# Segment vocabulary and its aliases.
SEGMENTS = ("intro", "verse", "pre-chorus", "chorus", "bridge", "outro")
ALIASES = {"prechorus": "pre-chorus", "pre--chorus": "pre-chorus"}


def segment_label(label) -> Column:
    x = F.translate(F.lower(F.trim(F.coalesce(label, F.lit("")))), "_ ", "--")
    pairs = [F.lit(v) for kv in ALIASES.items() for v in kv]
    x = F.coalesce(F.element_at(F.create_map(*pairs), x), x)
    return F.when(x.isin(*SEGMENTS), x).otherwise("unknown")


def checked_segments(df: DataFrame, start: str, end: str) -> DataFrame:
    """Fail on a segment that does not end after it starts."""
    bad = F.coalesce(F.col(end) <= F.col(start), F.lit(True))
    msg = F.concat(F.lit("segment end must be greater than start: "), F.coalesce(F.col(start).cast("string"), F.lit("null")))
    return df.withColumn(end, F.when(bad, F.raise_error(msg).cast("double")).otherwise(F.col(end)))


def segment_quarantine(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.where(F.coalesce(F.col(end) <= F.col(start), F.lit(True)))


def structure_summary(segments: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Chorus count, first chorus and its share of the duration (the latest segment end)."""
    chorus = F.col(label) == "chorus"
    length = F.col("end_ms") - F.col("start_ms")
    s = segments.groupBy(*keys).agg(
        F.count("*").alias("n_segments"),
        F.count_if(chorus).alias("chorus_count"),
        (F.min(F.when(chorus, F.col("start_ms"))) / 1000.0).alias("first_chorus_s"),
        F.sum(F.when(chorus, length).otherwise(0)).alias("_c"),
        F.max("end_ms").alias("_d"),
    )
    return s.withColumn("chorus_share", F.when(F.col("_d") > 0, rnd(F.col("_c") / F.col("_d"), 4))).drop("_c", "_d")


def flow_statistics(series: DataFrame, keys: Sequence[str], t: str, value: str, static: float) -> DataFrame:
    """Mean, median, linear P90, share below a threshold and the time of the maximum."""
    base = series.groupBy(*keys).agg(
        (F.sum(value) / F.count(value)).alias("mean"),
        (F.count_if(F.col(value) < static) / F.count(value)).alias("static_share"),
        F.max_by(t, F.struct(value, -F.col(t))).alias("peak_t"),
    )
    return base.join(quantiles(series, keys, value, {"median": 0.5, "p90": 0.9}), list(keys))
