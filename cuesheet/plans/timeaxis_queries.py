"""Scenes, cuts, beats, lines and curves: per-item features and time-axis views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.operators import features as feat
from cuesheet.operators import timeaxis
from cuesheet.operators.ordered import quantiles
from cuesheet.plans.registry import query
from cuesheet.plans.roles import (
    ENERGY, EV, ITEM_LENGTH_S, POINTS, POP, PROBES, REPLAY, SCENES, TAGS, energy, intervals, points, probes, replay, tags,
    timed_events, with_clause,
)
from cuesheet.session import materialise

KEY = ["item"]


def RND(x: str, d: int) -> str:
    return f"floor(({x}) * 1{'0' * d}.0 + 0.5) / 1{'0' * d}.0"


SUMMARY_SQL = f"""summary AS (SELECT item, count(*) AS num_scenes, {RND('max(end_ms) / 1000.0', 2)} AS duration_s,
  {RND('CAST(sum(len_ms) AS DOUBLE) / count(*) / 1000.0', 2)} AS avg_shot_len_s,
  {RND('quantile_cont(CAST(len_ms AS DOUBLE), 0.5) / 1000.0', 2)} AS median_shot_len_s,
  {RND('min(len_ms) / 1000.0', 2)} AS min_shot_len_s, {RND('max(len_ms) / 1000.0', 2)} AS max_shot_len_s,
  {RND('count(*) / (max(end_ms) / 60000.0)', 1)} AS cuts_per_minute,
  {RND('CAST(sum(bright_pct) AS DOUBLE) / count(*) / 100.0', 3)} AS avg_brightness,
  {RND('CAST(sum(sat_pct) AS DOUBLE) / count(*) / 100.0', 3)} AS avg_saturation
  FROM scenes GROUP BY item)"""


@query("scene_summary", with_clause(SCENES, SUMMARY_SQL) + "SELECT * FROM summary", "A1")
def scene_summary(spark, sf):
    return feat.scene_summary(intervals(spark, sf), KEY)


def mode_sql(col: str) -> str:
    return f"""(SELECT item, {col} AS {col}_top FROM (SELECT item, {col}, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, min(pos)) AS r
      FROM tags GROUP BY item, {col}) WHERE r = 1)"""


ROLLUP_SQL = f"""rollup_ AS (SELECT item, count(*) AS n_tags,
  {RND("CAST(count(*) FILTER (shot_type = 'closeup') AS DOUBLE) / count(*)", 3)} AS closeup_ratio,
  {RND("CAST(count(*) FILTER (shot_type = 'wide') AS DOUBLE) / count(*)", 3)} AS wide_ratio,
  {RND("CAST(sum(coalesce(num_characters, 0)) AS DOUBLE) / count(*)", 2)} AS avg_characters,
  {RND("CAST(count(*) FILTER (has_text) AS DOUBLE) / count(*)", 3)} AS text_ratio
  FROM tags GROUP BY item),
tagrow AS (SELECT * FROM rollup_ LEFT JOIN {mode_sql('style')} USING (item) LEFT JOIN {mode_sql('mood')} USING (item))"""


@query("tag_rollup", with_clause(TAGS, ROLLUP_SQL) + "SELECT * FROM tagrow", "A2 A3")
def tag_rollup(spark, sf):
    return feat.tag_rollup(tags(spark, sf), KEY)


HOOK_SQL = f"""hook AS (SELECT item, count(*) FILTER (start_ms > 0 AND start_ms <= 15000) AS cuts_first_15s FROM scenes WHERE pos > 0 GROUP BY item),
ec AS (SELECT item, CAST(sum(value) AS DOUBLE) / count(*) AS mean, max(value) FILTER (bin = 0) AS f,
         arg_max(bin, value * 1000 - bin) AS pk FROM energy GROUP BY item),
hookrow AS (SELECT item, coalesce(cuts_first_15s, 0) AS cuts_first_15s, CASE WHEN mean <> 0 THEN {RND('f / mean', 3)} END AS energy_first_ratio,
         {RND('pk * 10.0 / 600.0', 3)} AS peak_energy_ratio FROM hook FULL OUTER JOIN ec USING (item))"""


@query("hook_features", with_clause(SCENES, ENERGY, HOOK_SQL) + "SELECT * FROM hookrow", "A4 W5")
def hook_features(spark, sf):
    cuts = intervals(spark, sf).where(F.col("pos") > 0)
    return feat.hook_features(cuts, energy(spark, sf), KEY, ITEM_LENGTH_S)


def ch(c: str, i: int) -> str:
    return f"CAST('0x' || substr({c}, {2 + 2 * i}, 2) AS INTEGER)"


DIST = "sqrt(CAST(d2 AS DOUBLE)) / 255.0 / sqrt(3.0)"
COLOUR_SQL = f"""cd AS (SELECT item, count(*) AS n, sum(bright_pct) AS b, sum(bright_pct * bright_pct) AS bb, sum(sat_pct) AS s,
    sum(sat_pct * sat_pct) AS ss, count(DISTINCT color) AS u FROM scenes GROUP BY item),
st AS (SELECT item, {' + '.join(f"({ch('color', i)} - {ch('p', i)}) * ({ch('color', i)} - {ch('p', i)})" for i in range(3))} AS d2
       FROM (SELECT item, color, lag(color) OVER (PARTITION BY item ORDER BY start_ms, pos) AS p FROM scenes) WHERE p IS NOT NULL),
sr AS (SELECT item, {DIST} AS d, row_number() OVER (PARTITION BY item ORDER BY d2) AS r, count(*) OVER (PARTITION BY item) AS m FROM st),
sg AS (SELECT item, {RND('avg(d)', 4)} AS color_change_mean, {RND('max(d) FILTER (r = ceil(0.9 * m))', 4)} AS color_change_p90 FROM sr GROUP BY item),
colour AS (SELECT item, {RND('sqrt(CAST(n * bb - b * b AS DOUBLE) / (n * n)) / 100.0', 4)} AS brightness_std,
  {RND('sqrt(CAST(n * ss - s * s AS DOUBLE) / (n * n)) / 100.0', 4)} AS saturation_std,
  coalesce(color_change_mean, 0.0) AS color_change_mean, coalesce(color_change_p90, 0.0) AS color_change_p90,
  {RND('CAST(u AS DOUBLE) / n', 4)} AS color_unique_ratio FROM cd LEFT JOIN sg USING (item))"""


@query("colour_dynamics", with_clause(SCENES, COLOUR_SQL) + "SELECT * FROM colour", "A8 W4")
def colour_dynamics(spark, sf):
    return feat.colour_dynamics(intervals(spark, sf), KEY)


# ------------------------------------------------------------- points

NEAREST_SQL = """near AS (SELECT c.item, c.seq, c.t_ms, (SELECT min(abs(b.t_ms - c.t_ms)) FROM beats b WHERE b.item = c.item) AS "offset" FROM cuts c)"""


@query("nearest_event_offset", with_clause(POINTS, NEAREST_SQL) + "SELECT * FROM near", "J9")
def nearest_event_offset(spark, sf):
    cuts = points(spark, sf, "click").drop("k")
    return timeaxis.nearest_point(cuts, points(spark, sf, "view"), KEY, "t_ms")


SYNC_SQL = f"""sync AS (SELECT item, {RND('quantile_cont(CAST("offset" AS DOUBLE), 0.5) / 1000.0', 3)} AS cut_beat_offset_med_s,
   {RND('CAST(count(*) FILTER ("offset" <= 1000) AS DOUBLE) / count(*)', 3)} AS cut_on_beat_ratio
   FROM near WHERE "offset" IS NOT NULL GROUP BY item)"""


def sync_offsets(spark, sf, tol_ms: int = 1000):
    near = nearest_event_offset(spark, sf).where(F.col("offset").isNotNull())
    base = near.groupBy("item").agg(
        rnd(F.count_if(F.col("offset") <= tol_ms) / F.count("*"), 3).alias("cut_on_beat_ratio")
    )
    med = quantiles(near, KEY, "offset", {"_m": 0.5})
    return base.join(med, "item").select(
        "item", rnd(F.col("_m") / 1000.0, 3).alias("cut_beat_offset_med_s"), "cut_on_beat_ratio"
    )


@query("beat_sync", with_clause(POINTS, NEAREST_SQL, SYNC_SQL) + "SELECT * FROM sync", "J9 A7")
def beat_sync(spark, sf):
    return sync_offsets(spark, sf)


@query(
    "tolerance_ratio",
    with_clause(POINTS)
    + f"""SELECT item, n, hits, {RND('CAST(hits AS DOUBLE) / n', 4)} AS share FROM (
           SELECT item, count(*) AS n, count(*) FILTER (o <= 500) AS hits, count(o) AS seen FROM (
             SELECT c.item, (SELECT min(abs(l.t_ms - c.t_ms)) FROM tl l WHERE l.item = c.item) AS o FROM cuts c) GROUP BY item)
         WHERE seen > 0""",
    "J10",
)
def tolerance_ratio(spark, sf):
    lines = points(spark, sf, "purchase")
    s = timeaxis.tolerance_share(points(spark, sf, "click").select("item", "t_ms"), lines, KEY, "t_ms", 500)
    return s.withColumn("share", rnd("share", 4))


def item_peaks(spark, sf):
    return energy(spark, sf).groupBy("item").agg(
        (F.max_by("bin", F.struct("value", -F.col("bin"))) * 10000).alias("peak_ms")
    ).withColumn("duration_ms", F.lit(600000).cast("bigint"))


PEAK_SQL = f"""pk AS (SELECT item, arg_max(bin, value * 1000 - bin) * 10000 AS peak_ms FROM energy GROUP BY item),
accel AS (SELECT item, peak_ms, n_cuts, in_window,
  {RND('(CAST(in_window AS DOUBLE) / (least(peak_ms + 10000, 600000) - greatest(peak_ms - 10000, 0))) / (CAST(n_cuts AS DOUBLE) / 600000)', 2)} AS accel
  FROM (SELECT p.item, p.peak_ms, count(*) AS n_cuts,
     count(*) FILTER (c.t_ms BETWEEN p.peak_ms - 10000 AND p.peak_ms + 10000) AS in_window
   FROM pk p JOIN cuts c USING (item) GROUP BY ALL))"""


@query("peak_acceleration", with_clause(POINTS, ENERGY, PEAK_SQL) + "SELECT * FROM accel", "A6")
def peak_acceleration(spark, sf):
    s = timeaxis.peak_acceleration(
        points(spark, sf, "click"), item_peaks(spark, sf), KEY, "t_ms", "peak_ms", "duration_ms", 10000
    )
    return s.select("item", "peak_ms", "n_cuts", "in_window", rnd("accel", 2).alias("accel"))


FIRSTS_SQL = f"""firsts AS (SELECT item, min(t_ms) / 1000.0 AS first_cut_s, count(*) AS n_cuts,
   {RND('CAST((SELECT count(*) FROM beats b WHERE b.item = c.item) AS DOUBLE) / count(*)', 1)} AS beats_per_cut,
   (SELECT min(t_ms) / 1000.0 FROM tl WHERE tl.item = c.item) AS first_line_s,
   (SELECT count(*) FROM tl WHERE tl.item = c.item) AS n_lines,
   {RND('(SELECT count(*) FROM tl WHERE tl.item = c.item) / 10.0', 1)} AS lines_per_min
   FROM cuts c GROUP BY item)"""


@query("first_events", with_clause(POINTS, FIRSTS_SQL) + "SELECT * FROM firsts", "A5 A7")
def first_events(spark, sf):
    ev = timed_events(spark, sf)
    kind = F.col("kind")
    shifted = F.col("t_ms") + F.col("k") * 137 % 20000
    n_cuts, n_beats = F.count_if(kind == "click"), F.count_if(kind == "view")
    lines = F.count_if(kind == "purchase")
    return ev.groupBy("item").agg(
        (F.min(F.when(kind == "click", F.col("t_ms"))) / 1000.0).alias("first_cut_s"),
        n_cuts.alias("n_cuts"),
        F.when(n_cuts > 0, rnd(n_beats / n_cuts, 1)).alias("beats_per_cut"),
        (F.min(F.when(kind == "purchase", shifted)) / 1000.0).alias("first_line_s"),
        lines.alias("n_lines"),
        rnd(lines / (ITEM_LENGTH_S / 60.0), 1).alias("lines_per_min"),
    ).where(F.col("n_cuts") > 0)


@query(
    "build_feature_row",
    with_clause(TAGS, POINTS.replace(EV + "\n, ", "", 1), ENERGY, SUMMARY_SQL, ROLLUP_SQL, HOOK_SQL, COLOUR_SQL, NEAREST_SQL, SYNC_SQL, PEAK_SQL, FIRSTS_SQL)
    + """SELECT s.item, s.num_scenes AS scene_num_scenes, s.median_shot_len_s AS scene_median_shot_len_s, s.cuts_per_minute AS scene_cuts_per_minute,
           s.avg_brightness AS scene_avg_brightness, t.style_top AS tag_style_top, t.mood_top AS tag_mood_top, t.closeup_ratio AS tag_closeup_ratio,
           t.avg_characters AS tag_avg_characters, h.cuts_first_15s AS hook_cuts_first_15s, h.energy_first_ratio AS hook_energy_first_10s_ratio,
           h.peak_energy_ratio AS audio_peak_energy_ratio, c.color_change_mean AS ext_color_change_mean, c.color_unique_ratio AS ext_color_unique_ratio,
           y.cut_beat_offset_med_s AS sync_cut_beat_offset_med_s, y.cut_on_beat_ratio AS sync_cut_on_beat_ratio, a.accel AS sync_cut_accel_at_peak,
           f.first_cut_s AS sync_first_cut_s, f.beats_per_cut AS sync_beats_per_cut, f.n_lines AS lyrics_n_lyric_lines
         FROM summary s LEFT JOIN tagrow t USING (item) LEFT JOIN hookrow h USING (item) LEFT JOIN colour c USING (item)
           LEFT JOIN sync y USING (item) LEFT JOIN accel a USING (item) LEFT JOIN firsts f USING (item)""",
    "P4 A1 A2 A3 A4 A5 A6 A7 R1",
)
def build_feature_row(spark, sf):
    """One wide flat row per item: every part is one row per item before it is joined."""

    def part(df, prefix, cols):
        return df.select("item", *[F.col(c).alias(f"{prefix}_{new or c}") for c, new in cols.items()])

    parts = [
        part(tag_rollup(spark, sf), "tag", {"style_top": "", "mood_top": "", "closeup_ratio": "", "avg_characters": ""}),
        hook_features(spark, sf).select(
            "item", F.col("cuts_first_15s").alias("hook_cuts_first_15s"),
            F.col("energy_first_ratio").alias("hook_energy_first_10s_ratio"),
            F.col("peak_energy_ratio").alias("audio_peak_energy_ratio"),
        ),
        part(colour_dynamics(spark, sf), "ext", {"color_change_mean": "", "color_unique_ratio": ""}),
        part(sync_offsets(spark, sf), "sync", {"cut_beat_offset_med_s": "", "cut_on_beat_ratio": ""}),
        part(peak_acceleration(spark, sf), "sync", {"accel": "cut_accel_at_peak"}),
        first_events(spark, sf).select(
            "item", F.col("first_cut_s").alias("sync_first_cut_s"), F.col("beats_per_cut").alias("sync_beats_per_cut"),
            F.col("n_lines").alias("lyrics_n_lyric_lines"),
        ),
    ]
    row = part(scene_summary(spark, sf), "scene", {"num_scenes": "", "median_shot_len_s": "", "cuts_per_minute": "", "avg_brightness": ""})
    for p in parts:
        row = row.join(p, "item", "left")
    return row


# ------------------------------------------------------------- curves

@query(
    "curve_slope_peak",
    with_clause(EV, REPLAY)
    + f""", m AS (SELECT *, (start_time + end_time) / 2.0 AS mid FROM replay)
          SELECT item, CASE WHEN count(*) FILTER (mid <= 30.0) >= 3 THEN {RND('regr_slope(value, mid) FILTER (mid <= 30.0)', 6)} END AS slope_first_30s,
            {RND('arg_max(mid, value * 1000.0 - mid) FILTER (mid >= 30.0) / 600.0', 4)} AS peak_at_ratio,
            max(value) FILTER (mid >= 30.0) AS peak_value
          FROM m GROUP BY item""",
    "N2 N3 N4",
)
def curve_slope_peak(spark, sf):
    return feat.curve_features(replay(spark, sf), KEY, ITEM_LENGTH_S)


@query(
    "curve_mean_by_group",
    with_clause(EV, REPLAY)
    + """SELECT CASE item % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'middle' ELSE 'bottom' END AS "group", bin,
           CAST(sum(value) AS DOUBLE) / count(*) AS mean_value, count(*) AS n_items FROM replay GROUP BY ALL""",
    "A12 J1",
)
def curve_mean_by_group(spark, sf):
    group = F.when(F.col("item") % 3 == 0, "top").when(F.col("item") % 3 == 1, "middle").otherwise("bottom")
    return feat.mean_curve(replay(spark, sf).withColumn("group", group), KEY, "group")


# ------------------------------------------------------------- views

@query(
    "scene_tags_zip",
    with_clause(TAGS)
    + """SELECT s.item, s.pos, s.start_ms, s.end_ms, t.setting, t.mood, t.shot_type, t.num_characters
         FROM scenes s LEFT JOIN tags t USING (item, pos)""",
    "J4 R3",
)
def scene_tags_zip(spark, sf):
    return intervals(spark, sf).select("item", "pos", "start_ms", "end_ms").join(
        tags(spark, sf).select("item", "pos", "setting", "mood", "shot_type", "num_characters"), ["item", "pos"], "left"
    )


@query(
    "timeline",
    with_clause(TAGS, POINTS.replace(EV + "\n, ", "", 1), ENERGY)
    + f""", tv AS (SELECT item, {RND('start_ms / 1000.0', 2)} AS t_s, 'scene' AS kind, pos AS ref, t.mood AS note FROM scenes s LEFT JOIN tags t USING (item, pos)
            UNION ALL SELECT item, t_ms / 1000.0, 'lyric', seq, 'line ' || seq FROM tl
            UNION ALL SELECT item, CAST(arg_max(bin, value * 1000 - bin) * 10 AS DOUBLE), 'peak_energy', NULL, 'peak' FROM energy GROUP BY item)
          SELECT * FROM tv WHERE coalesce(t_s, 0) BETWEEN 100 AND 300""",
    "V2 U2 K5",
)
def timeline(spark, sf):
    scenes = scene_tags_zip(spark, sf).select(
        "item", rnd(F.col("start_ms") / 1000.0, 2).alias("t_s"), F.lit("scene").alias("kind"),
        F.col("pos").alias("ref"), F.col("mood").alias("note"),
    )
    lines = points(spark, sf, "purchase").select(
        "item", (F.col("t_ms") / 1000.0).alias("t_s"), F.lit("lyric").alias("kind"), F.col("seq").alias("ref"),
        F.concat(F.lit("line "), F.col("seq")).alias("note"),
    )
    peak = item_peaks(spark, sf).select(
        "item", (F.col("peak_ms") / 1000.0).alias("t_s"), F.lit("peak_energy").alias("kind"), F.lit("peak").alias("note")
    )
    both = scenes.unionByName(lines).unionByName(peak, allowMissingColumns=True)
    return both.where(F.coalesce("t_s", F.lit(0.0)).between(100, 300)).orderBy("item", F.col("t_s").asc_nulls_last(), "kind", "ref")


@query(
    "context_at",
    with_clause(SCENES, POINTS.replace(EV + "\n, ", "", 1), PROBES, ENERGY)
    + f""", ok AS (SELECT *, CASE WHEN t_ms > 600000 THEN 'time exceeds duration' END AS error FROM probes),
          ef AS (SELECT item, max(value) AS pk, arg_max(bin, value * 1000 - bin) * 10 AS peak_at FROM energy GROUP BY item)
          SELECT o.item, o.seq, o.t_ms, o.error,
            CASE WHEN o.error IS NULL THEN {RND('o.t_ms / 1000.0 / 600.0', 3)} END AS position_ratio,
            CASE WHEN o.error IS NULL THEN (SELECT max(pos) FROM scenes s WHERE s.item = o.item AND s.start_ms <= o.t_ms AND (o.t_ms < s.end_ms OR s.is_last)) END AS scene,
            CASE WHEN o.error IS NULL THEN (SELECT count(*) FROM tl l WHERE l.item = o.item AND l.t_ms >= o.t_ms - 8000 AND l.t_ms < o.t_ms + 8000) END AS n_lines_near,
            CASE WHEN o.error IS NULL THEN (SELECT count(*) FROM cuts c WHERE c.item = o.item AND c.t_ms >= greatest(o.t_ms - 30000, 0) AND c.t_ms < o.t_ms) END AS cuts_last_30s,
            CASE WHEN o.error IS NULL THEN e.value END AS energy,
            CASE WHEN o.error IS NULL THEN {RND('CAST(e.value AS DOUBLE) / ef.pk', 3)} END AS ratio_to_peak,
            CASE WHEN o.error IS NULL THEN ef.peak_at END AS peak_at
          FROM ok o JOIN ef USING (item) JOIN energy e ON e.item = o.item AND e.bin = least(CAST(floor(o.t_ms / 10000.0) AS BIGINT), 59)""",
    "V3 J6 J7 W6 N6",
)
def context_at(spark, sf):
    """Scene, lines, cuts and energy around every probe; probes past the end carry an error."""
    asked = probes(spark, sf)
    late = F.col("t_ms") > int(ITEM_LENGTH_S * 1000)
    good = asked.where(~late)
    ids = ["item", "seq"]
    t = F.col("t_ms")
    scene = timeaxis.interval_of(
        good, intervals(spark, sf), KEY, "t_ms", start="start_ms", end="end_ms", pos="pos", is_last="is_last", payload=["pos"]
    ).withColumnRenamed("pos", "scene")
    lines = timeaxis.count_between(good, points(spark, sf, "purchase"), KEY, ids, "t_ms", t - 8000, t + 8000, out="n_lines_near")
    cuts = timeaxis.count_between(good, points(spark, sf, "click"), KEY, ids, "t_ms", F.greatest(t - 30000, F.lit(0)), t, out="cuts_last_30s")
    power = timeaxis.energy_lookup(good, energy(spark, sf), KEY, "t_ms", 10000).select(
        *ids, F.col("value").alias("energy"), rnd("ratio_to_peak", 3).alias("ratio_to_peak"),
        F.floor(F.col("peak_at") / 1000).alias("peak_at"),
    )
    out = scene.join(lines, ids).join(cuts, ids).join(power, ids)
    out = out.withColumn("position_ratio", rnd(t / 1000.0 / ITEM_LENGTH_S, 3))
    bad = asked.where(late).withColumn("error", F.lit("time exceeds duration"))
    return out.unionByName(bad, allowMissingColumns=True)


@query(
    "near_lines",
    with_clause(POINTS, PROBES)
    + """SELECT p.item, p.seq, p.t_ms, l.seq AS line_seq, l.t_ms AS line_t_ms FROM probes p JOIN tl l
           ON l.item = p.item AND l.t_ms >= p.t_ms - 8000 AND l.t_ms < p.t_ms + 8000""",
    "J7",
)
def near_lines(spark, sf):
    lines = points(spark, sf, "purchase").select("item", F.col("seq").alias("line_seq"), "t_ms")
    return timeaxis.near_lines(probes(spark, sf), lines, KEY, "t_ms", 8000)


@query(
    "scene_blueprint",
    with_clause(TAGS, POINTS.replace(EV + "\n, ", "", 1), ENERGY)
    + f""", ln AS (SELECT l.item, l.seq, l.t_ms, (SELECT max(pos) FROM scenes s WHERE s.item = l.item AND s.start_ms <= l.t_ms AND l.t_ms < s.end_ms) AS pos FROM tl l),
          tx AS (SELECT item, pos, count(*) AS n_lines, string_agg('line ' || seq, ' / ' ORDER BY t_ms, seq) AS transcript FROM ln WHERE pos IS NOT NULL GROUP BY item, pos),
          ef AS (SELECT item, max(value) AS pk FROM energy GROUP BY item),
          b AS (SELECT s.item, s.pos AS scene_index, s.start_s AS start_time, s.end_s AS end_time, s.color AS dominant_color,
             t.mood AS mood_hint, t.shot_type AS shot_type_hint, coalesce(x.n_lines, 0) AS n_lyric_lines, coalesce(x.transcript, '') AS transcript,
             CASE WHEN s.pos > 0 THEN {RND('(SELECT min(abs(b.t_ms - s.start_ms)) FROM beats b WHERE b.item = s.item) / 1000.0', 3)} END AS cut_beat_offset_s,
             {RND('CAST(e.value AS DOUBLE) / ef.pk', 3)} AS energy_ratio
           FROM scenes s LEFT JOIN tags t USING (item, pos) LEFT JOIN tx x USING (item, pos) JOIN ef ON ef.item = s.item
             JOIN energy e ON e.item = s.item AND e.bin = least(CAST(floor((s.start_ms + s.end_ms) / 2.0 / 10000.0) AS BIGINT), 59))
          SELECT *, CASE WHEN energy_ratio >= 0.8 THEN 'high' WHEN energy_ratio >= 0.5 THEN 'medium' ELSE 'low' END AS energy_level FROM b""",
    "V5 J8 F20",
)
def scene_blueprint(spark, sf):
    """Scene record with transcript, beat offset, energy and label hints."""
    # five readers of the events and four of the scenes: both are made once
    ev = materialise(timed_events(spark, sf))
    scenes = intervals(spark, sf, ev).select("item", "pos", "start_ms", "end_ms", "start_s", "end_s", "color", "is_last")
    scenes = materialise(scenes)
    lines = points(spark, sf, "purchase", ev).drop("k")
    placed = timeaxis.interval_of(
        lines, scenes, KEY, "t_ms", start="start_ms", end="end_ms", pos="pos", is_last=None, payload=["pos"]
    ).where(F.col("pos").isNotNull())
    # one list per scene: its size is the size of the transcript cell asked for
    text = placed.groupBy("item", "pos").agg(
        F.count("*").alias("n_lyric_lines"),
        F.array_sort(F.collect_list(F.struct("t_ms", "seq"))).alias("_l"),
    ).withColumn("transcript", F.array_join(F.transform("_l", lambda x: F.concat(F.lit("line "), x["seq"])), " / ")).drop("_l")
    starts = scenes.where(F.col("pos") > 0).select("item", "pos", F.col("start_ms").alias("t_ms"))
    beat = timeaxis.nearest_point(starts, points(spark, sf, "view", ev), KEY, "t_ms").select("item", "pos", "offset")
    mid = scenes.select("item", "pos", ((F.col("start_ms") + F.col("end_ms")) / 2.0).alias("mid"))
    power = timeaxis.energy_lookup(mid, energy(spark, sf, ev), KEY, "mid", 10000).select("item", "pos", rnd("ratio_to_peak", 3).alias("energy_ratio"))
    at = ["item", "pos"]
    out = scenes.join(tags(spark, sf, ev).select(*at, "mood", "shot_type"), at, "left").join(text, at, "left").join(beat, at, "left").join(power, at, "left")
    return out.select(
        "item", F.col("pos").alias("scene_index"), F.col("start_s").alias("start_time"), F.col("end_s").alias("end_time"),
        F.col("color").alias("dominant_color"), F.col("mood").alias("mood_hint"), F.col("shot_type").alias("shot_type_hint"),
        F.coalesce("n_lyric_lines", F.lit(0)).alias("n_lyric_lines"), F.coalesce("transcript", F.lit("")).alias("transcript"),
        rnd(F.col("offset") / 1000.0, 3).alias("cut_beat_offset_s"), "energy_ratio", feat.energy_level("energy_ratio").alias("energy_level"),
    )


@query(
    "probe_plan",
    with_clause(SCENES)
    + """, a AS (SELECT item, pos, start_s, end_s, end_s - start_s AS len FROM scenes),
         b AS (SELECT *, CASE WHEN len > 0.4 * 1.5 THEN 0.4 ELSE greatest(CAST(1.0 AS DOUBLE) / 24.0, len / 2.0) END AS gap_s FROM a),
         c AS (SELECT *, CASE WHEN len > 0 THEN greatest(1, least(12, greatest(3, floor(len / 5.0)), floor(len / gap_s))) ELSE 1 END AS n FROM b),
         d AS (SELECT *, unnest(range(0, CAST(n AS BIGINT))) AS pair FROM c),
         e AS (SELECT *, start_s + (pair + 0.5) * greatest(len - gap_s, 0.0) / n AS t FROM d)
         SELECT item, pos, pair, CAST(n AS BIGINT) AS n_pairs, (start_s + end_s) / 2.0 AS mid_s, CAST(greatest(floor(t * 24.0 + 0.5), 0) AS BIGINT) AS frame_a,
           CAST(greatest(greatest(floor(t * 24.0 + 0.5), 0) + 1, floor((t + gap_s) * 24.0 + 0.5)) AS BIGINT) AS frame_b FROM e""",
    "V7",
)
def probe_plan(spark, sf):
    s = intervals(spark, sf).select("item", "pos", "start_s", "end_s")
    return timeaxis.probe_plan(s, "start_s", "end_s").select("item", "pos", "pair", "n_pairs", "mid_s", "frame_a", "frame_b")


# ------------------------------------------------------------- colours and structure

HUE_SQL = f"""rgb AS (SELECT *, {ch('color', 0)} / 255.0 AS cr, {ch('color', 1)} / 255.0 AS cg, {ch('color', 2)} / 255.0 AS cb FROM scenes),
hsv AS (SELECT *, greatest(cr, cg, cb) AS hi, greatest(cr, cg, cb) - least(cr, cg, cb) AS c FROM rgb),
hu AS (SELECT *, (CASE WHEN c = 0 THEN 0.0 WHEN hi = cr THEN ((cg - cb) / c) - 6.0 * floor(((cg - cb) / c) / 6.0) WHEN hi = cg THEN (cb - cr) / c + 2.0 ELSE (cr - cg) / c + 4.0 END) * 60.0 AS hue FROM hsv),
bk AS (SELECT item, len_ms, CASE WHEN hi < 0.2 THEN 'dark' WHEN (CASE WHEN hi > 0 THEN c / hi ELSE 0 END) < 0.15 THEN 'grey'
   ELSE ['red','orange','yellow','green','cyan','blue','violet','magenta'][CAST(floor((hue + 22.5) / 45.0) AS BIGINT) % 8 + 1] END AS bucket FROM hu),
pw AS (SELECT item, bucket, CAST(sum(len_ms) AS DOUBLE) AS w FROM bk GROUP BY ALL),
pal AS (SELECT item, bucket, floor(w / sum(w) OVER (PARTITION BY item) * 10000.0 + 0.5) AS share_e4 FROM pw)"""


@query(
    "palette_shift",
    with_clause(SCENES, HUE_SQL)
    + f""", f AS (SELECT bucket, {RND("sum(share_e4) / (SELECT count(DISTINCT item) FROM pal WHERE item % 17 = 3) / 10000.0", 4)} AS favorites FROM pal WHERE item % 17 = 3 GROUP BY bucket),
          c AS (SELECT bucket, {RND("sum(share_e4) / (SELECT count(DISTINCT item) FROM pal) / 10000.0", 4)} AS corpus FROM pal GROUP BY bucket)
          SELECT bucket, coalesce(favorites, 0.0) AS favorites, coalesce(corpus, 0.0) AS corpus,
            {RND('coalesce(favorites, 0.0) - coalesce(corpus, 0.0)', 4)} AS delta FROM f FULL OUTER JOIN c USING (bucket)""",
    "A14 C4 F13",
)
def palette_shift(spark, sf):
    """Mean palette of the favourites against the corpus; items are counted in the same pass."""
    pal = feat.palette(intervals(spark, sf), KEY)
    fav = F.col("item") % 17 == 3
    # the item totals are one row; every item with a palette counts once
    n = pal.groupBy("item").agg(F.first("item").alias("_i")).agg(F.count("*").alias("n_all"), F.count_if(fav).alias("n_fav"))
    sums = pal.groupBy("bucket").agg(
        F.sum("share_e4").alias("_c"), F.sum(F.when(fav, F.col("share_e4")).otherwise(0)).alias("_f")
    )
    share = lambda s, k: rnd(F.when(F.col(k) > 0, F.col(s) / F.col(k) / 10000.0).otherwise(0.0), 4)
    out = sums.join(F.broadcast(n), F.lit(True)).select("bucket", share("_f", "n_fav").alias("favorites"), share("_c", "n_all").alias("corpus"))
    return out.withColumn("delta", rnd(F.col("favorites") - F.col("corpus"), 4))


@query(
    "top_colours",
    with_clause(SCENES)
    + """SELECT item, color, CAST(w AS BIGINT) AS weight_ms, r AS rank FROM (SELECT item, color, sum(len_ms) AS w,
           row_number() OVER (PARTITION BY item ORDER BY sum(len_ms) DESC, color) AS r FROM scenes GROUP BY item, color) WHERE r <= 3""",
    "A15",
)
def top_colours(spark, sf):
    return feat.top_colours(intervals(spark, sf), KEY, 3)


@query(
    "pacing_levels",
    with_clause(SCENES, POINTS.replace(EV + "\n, ", "", 1), SUMMARY_SQL, NEAREST_SQL, SYNC_SQL)
    + """SELECT item, cuts_per_minute, cut_on_beat_ratio,
           CASE WHEN coalesce(cuts_per_minute, 0) >= 20 THEN 'fast' WHEN coalesce(cuts_per_minute, 0) >= 10 THEN 'medium' ELSE 'slow' END
             || '_cut' || CASE WHEN coalesce(cut_on_beat_ratio, 0) >= 0.4 THEN '_beat_locked' ELSE '' END AS pacing_style
         FROM summary LEFT JOIN sync USING (item)""",
    "F20",
)
def pacing_levels(spark, sf):
    s = scene_summary(spark, sf).select("item", "cuts_per_minute").join(sync_offsets(spark, sf).select("item", "cut_on_beat_ratio"), "item", "left")
    return s.withColumn("pacing_style", feat.pacing_style("cuts_per_minute", "cut_on_beat_ratio"))


MOTION_SQL = """mo AS (SELECT item, len_ms, k / 40.0 AS flow_mag, CASE WHEN k % 10 = 0 THEN NULL ELSE (k * 3 % 100) / 20.0 END AS flow_var FROM scenes),
mc AS (SELECT *, CASE WHEN flow_var IS NULL THEN 'unknown' WHEN flow_mag < 0.5 THEN 'static_image' WHEN flow_var < 2.0 THEN 'animated_still' ELSE 'motion_clip' END AS motion_type FROM mo)"""


@query(
    "motion_summary",
    with_clause(SCENES, MOTION_SQL)
    + f"""SELECT item, count(*) FILTER (motion_type <> 'unknown') AS n_known, count(*) FILTER (motion_type = 'unknown') AS n_unknown,
            {RND("CAST(count(*) FILTER (motion_type = 'static_image') AS DOUBLE) / count(*) FILTER (motion_type <> 'unknown')", 4)} AS static_ratio,
            {RND("CAST(count(*) FILTER (motion_type = 'animated_still') AS DOUBLE) / count(*) FILTER (motion_type <> 'unknown')", 4)} AS animated_still_ratio,
            {RND("CAST(count(*) FILTER (motion_type = 'motion_clip') AS DOUBLE) / count(*) FILTER (motion_type <> 'unknown')", 4)} AS clip_ratio,
            {RND("CAST(coalesce(sum(len_ms) FILTER (motion_type = 'motion_clip'), 0) AS DOUBLE) / sum(len_ms) FILTER (motion_type <> 'unknown')", 4)} AS clip_time_ratio,
            {RND("quantile_cont(flow_mag, 0.5) FILTER (motion_type <> 'unknown')", 4)} AS flow_mag_median,
            {RND("quantile_cont(flow_mag, 0.9) FILTER (motion_type <> 'unknown')", 4)} AS flow_mag_p90
          FROM mc GROUP BY item""",
    "A18 A19 N7",
)
def motion_summary(spark, sf):
    k = F.col("k")
    rows = intervals(spark, sf).select(
        "item", "len_ms", (k / 40.0).alias("flow_mag"), F.when(k % 10 != 0, (k * 3 % 100) / 20.0).alias("flow_var")
    ).withColumn("motion_type", feat.motion_class("flow_mag", "flow_var"))
    s = feat.motion_summary(rows, KEY)
    return s.withColumns({c: rnd(c, 4) for c in ("flow_mag_median", "flow_mag_p90")})


@query(
    "structure_summary",
    with_clause(SCENES)
    + f""", sg AS (SELECT item, start_ms, end_ms, CASE kind WHEN 'view' THEN 'chorus' WHEN 'click' THEN 'verse' WHEN 'purchase' THEN 'pre-chorus' ELSE 'unknown' END AS label
                  FROM scenes WHERE end_ms > start_ms)
          SELECT item, count(*) AS n_segments, count(*) FILTER (label = 'chorus') AS chorus_count, min(start_ms) FILTER (label = 'chorus') / 1000.0 AS first_chorus_s,
            {RND("CAST(coalesce(sum(end_ms - start_ms) FILTER (label = 'chorus'), 0) AS DOUBLE) / max(end_ms)", 4)} AS chorus_share
          FROM sg GROUP BY item""",
    "A17 F17 X9",
)
def structure_summary(spark, sf):
    raw = F.when(F.col("kind") == "view", " Chorus").when(F.col("kind") == "click", "VERSE").when(
        F.col("kind") == "purchase", "Pre_Chorus").otherwise("solo")
    seg = intervals(spark, sf).where(F.col("end_ms") > F.col("start_ms")).select("item", "start_ms", "end_ms", feat.segment_label(raw).alias("label"))
    return feat.structure_summary(seg, KEY)


@query(
    "segment_errors",
    with_clause(SCENES) + "SELECT item, start_ms, end_ms FROM scenes WHERE coalesce(end_ms <= start_ms, true)",
    "X9",
)
def segment_errors(spark, sf):
    """Segments that do not end after they start: what ``structure_summary`` leaves out, and why."""
    return feat.segment_quarantine(intervals(spark, sf), "start_ms", "end_ms").select("item", "start_ms", "end_ms")


@query(
    "flow_statistics",
    with_clause(SCENES)
    + f"""SELECT item, {RND("avg(k / 40.0)", 6)} AS mean, {RND("CAST(count(*) FILTER (k / 40.0 < 0.5) AS DOUBLE) / count(*)", 6)} AS static_share,
            arg_max(start_ms, k / 40.0 * 1000000000 - start_ms) AS peak_t, {RND("quantile_cont(k / 40.0, 0.5)", 6)} AS median, {RND("quantile_cont(k / 40.0, 0.9)", 6)} AS p90
          FROM scenes GROUP BY item""",
    "A19",
)
def flow_statistics(spark, sf):
    rows = intervals(spark, sf).select("item", "start_ms", (F.col("k") / 40.0).alias("flow"))
    s = feat.flow_statistics(rows, KEY, "start_ms", "flow", 0.5)
    return s.withColumns({c: rnd(c, 6) for c in ("mean", "static_share", "median", "p90")})


@query(
    "motion_class_split",
    with_clause(SCENES)
    + """, m AS (SELECT item, (k * 7 % 100) / 100.0 AS g, CASE WHEN k % 10 <> 0 THEN (k * 3 % 100) / 100.0 END AS r FROM scenes)
         SELECT item, CASE WHEN r IS NULL THEN 'unknown' WHEN r >= 0.45 THEN 'motion_clip' WHEN g >= 0.35 THEN 'animated_still' ELSE 'static_image' END AS motion_type,
           count(*) AS n FROM m GROUP BY ALL""",
    "N7",
)
def motion_class_split(spark, sf):
    k = F.col("k")
    rows = intervals(spark, sf).select("item", (k * 7 % 100 / 100.0).alias("g"), F.when(k % 10 != 0, k * 3 % 100 / 100.0).alias("r"))
    return rows.groupBy("item", feat.motion_class_split("g", "r").alias("motion_type")).agg(F.count("*").alias("n"))
