"""Population filter, samplers, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.functions.text import title_columns
from cuesheet.operators import sampling
from cuesheet.plans.registry import query
from cuesheet.plans.roles import POP, EV, TAGS, SHOTS, population, tags, timed_events, with_clause

WINDOW = {"date_from": "19960101", "date_to": "19981231"}
# ASCII part of the exclusion list that the role titles can hit; the full list is tested by unit tests.
FILTERED = POP + r""",
fit AS (
  SELECT * FROM pop
  WHERE ratio IS NOT NULL AND coalesce(subs, 0) >= 1000 AND duration_s BETWEEN 60 AND 600
    AND upload_date BETWEEN '19960101' AND '19981231'
    AND NOT coalesce(width > 0 AND height > 0 AND height > width, false)
    AND NOT regexp_matches(title, '(?i)remix|cover|\blive\b|mix\b|medley|karaoke|trailer'))"""


def fit(spark, sf):
    return sampling.population_filter(population(spark, sf), normalise=False, **WINDOW)


@query(
    "population_filter",
    with_clause(FILTERED)
    + """SELECT item, channel, domain, ratio, upload_date, title,
           floor(coalesce(CAST(likes AS DOUBLE), 0.0) / CAST(views AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS like_rate,
           CAST(isodow(strptime(upload_date, '%Y%m%d')) - 1 AS INTEGER) AS weekday,
           floor(CAST(width AS DOUBLE) / CAST(height AS DOUBLE) * 1000.0 + 0.5) / 1000.0 AS aspect_ratio,
           length(title) AS title_len, regexp_matches(title, '(?i)\\bMV\\b|Music Video') AS marked
         FROM fit""",
    "P1 P2 P3 F11 D2",
)
def population_filter(spark, sf):
    df = sampling.population_filter(population(spark, sf), **WINDOW)
    title = title_columns("title")
    return df.select(
        "item", "channel", "domain", "ratio", "upload_date", "title",
        rnd(F.coalesce("likes", F.lit(0)) / F.col("views"), 4).alias("like_rate"),
        F.weekday(F.to_date("upload_date", "yyyyMMdd")).alias("weekday"),
        rnd(F.col("width") / F.col("height"), 3).alias("aspect_ratio"),
        title["title_len"].alias("title_len"),
        title["title_has_mv_mark"].alias("marked"),
    )


EXTREMES = FILTERED + """,
t0 AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ratio DESC, item) AS r FROM fit),
top AS (SELECT * FROM t0 WHERE r <= 2 ORDER BY ratio DESC, item LIMIT 200),
b0 AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ratio, item) AS r FROM fit
       WHERE item NOT IN (SELECT item FROM top)),
bot AS (SELECT * FROM b0 WHERE r <= 2 ORDER BY ratio, item LIMIT 200),
ext AS (SELECT item, channel, ratio, views, subs, 'top' AS "group" FROM top
        UNION ALL SELECT item, channel, ratio, views, subs, 'bottom' FROM bot)"""


@query("capped_extremes", with_clause(EXTREMES) + "SELECT * FROM ext", "K1 W1")
def capped_extremes(spark, sf):
    return sampling.extremes(fit(spark, sf), n=200, cap=2).select(
        "item", "channel", "ratio", "views", "subs", "group"
    )


@query(
    "middle_band",
    with_clause(EXTREMES)
    + """, m AS (SELECT quantile_cont(ratio, 0.4) AS lo, quantile_cont(ratio, 0.6) AS hi,
                quantile_cont(ratio, 0.5) AS mid FROM fit),
         band AS (SELECT fit.*, abs(ratio - mid) AS d FROM fit, m
                  WHERE ratio BETWEEN lo AND hi AND item NOT IN (SELECT item FROM ext)),
         c AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY d, item) AS r FROM band)
         SELECT item, channel, ratio, 'middle' AS "group" FROM c WHERE r <= 2 ORDER BY d, item LIMIT 200""",
    "K2 N1 J15",
)
def middle_band(spark, sf):
    pop = fit(spark, sf)
    out = sampling.middle_band(pop, n=200, cap=2, exclude=sampling.extremes(pop, n=200, cap=2))
    return out.select("item", "channel", "ratio", "group")


@query(
    "expansion_feasibility",
    with_clause(FILTERED)
    + """, t0 AS (SELECT *, row_number() OVER (PARTITION BY domain, channel ORDER BY ratio DESC, item) AS r FROM fit),
         t1 AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ratio DESC, item) AS k FROM t0 WHERE r <= 2),
         top AS (SELECT * FROM t1 WHERE k <= 40),
         b0 AS (SELECT *, row_number() OVER (PARTITION BY domain, channel ORDER BY ratio, item) AS r FROM fit
                WHERE item NOT IN (SELECT item FROM top)),
         b1 AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ratio, item) AS k FROM b0 WHERE r <= 2),
         bot AS (SELECT * FROM b1 WHERE k <= 40)
         SELECT domain, count(*) AS eligible_population,
                (SELECT count(*) FROM top WHERE top.domain = fit.domain) AS max_top,
                (SELECT count(*) FROM bot WHERE bot.domain = fit.domain) AS max_bottom,
                (SELECT count(*) FROM top WHERE top.domain = fit.domain) >= 40
                  AND (SELECT count(*) FROM bot WHERE bot.domain = fit.domain) >= 40 AS feasible
         FROM fit GROUP BY domain""",
    "K9",
)
def expansion_feasibility(spark, sf):
    return sampling.expansion_feasibility(fit(spark, sf), ["domain"], n=40, cap=2)


@query(
    "dedupe_last_row",
    with_clause(EV)
    + """SELECT item, kind, seq, t_ms, amount FROM (
           SELECT *, row_number() OVER (PARTITION BY item, kind ORDER BY seq DESC) AS r FROM ev) WHERE r = 1""",
    "U4",
)
def dedupe_last_row(spark, sf):
    ev = timed_events(spark, sf).select("item", "kind", "seq", "t_ms", "amount")
    return sampling.last_row_wins(ev, ["item", "kind"], "seq")


@query(
    "stratified_labels",
    with_clause(TAGS)
    + """, rows AS (SELECT item || ':' || pos AS id, shot_type,
                  md5('20260903:' || item || ':' || pos) AS draw FROM tags),
         first AS (SELECT id, shot_type, draw, 0 AS fill FROM (
             SELECT *, row_number() OVER (PARTITION BY shot_type ORDER BY draw) AS r FROM rows) WHERE r <= 11),
         u AS (SELECT * FROM first UNION ALL
               SELECT id, shot_type, draw, 1 FROM rows WHERE id NOT IN (SELECT id FROM first)),
         p AS (SELECT * FROM u ORDER BY fill, draw LIMIT 45)
         SELECT id, shot_type, 'm' || lpad(CAST(row_number() OVER (ORDER BY md5('20260903+shuffle:' || id)) AS VARCHAR), 3, '0') AS label_id
         FROM p""",
    "W10",
)
def stratified_labels(spark, sf):
    rows = tags(spark, sf).select(
        F.concat_ws(":", F.col("item").cast("string"), F.col("pos").cast("string")).alias("id"), "shot_type"
    )
    return sampling.stratified(rows, "shot_type", SHOTS, 45, 20260903, "id")
