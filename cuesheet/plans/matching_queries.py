"""Matched pairs inside channels and over the whole corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.operators import matching, sampling
from cuesheet.plans.registry import query
from cuesheet.plans.roles import POP, population, with_clause
from cuesheet.plans.sampling_queries import EXTREMES, fit
from cuesheet.session import materialise


def walk_sql(treated: str, controls: str, key: str, apart: str, near: str = "true") -> str:
    """Serial matching as a recursion: step k lets the k-th treated row of a key take its best control still free.

    treated: item, k, key; controls: item, first (of its group of equal controls), key; apart: what is smallest first.
    """
    return f"""walk AS (
  SELECT {key}, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS treated, CAST(NULL AS BIGINT) AS control
  FROM (SELECT DISTINCT {key} FROM {treated})
  UNION ALL
  SELECT {key}, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.item) END, treated, best.item
  FROM (SELECT w.{key}, t.k, w.used, t.item AS treated, min(CASE WHEN c.item IS NOT NULL THEN struct_pack({apart}, first := c.first, item := c.item) END) AS best
        FROM walk w JOIN {treated} t ON t.{key} = w.{key} AND t.k = w.k + 1
        LEFT JOIN {controls} c ON c.{key} = w.{key} AND NOT list_contains(w.used, c.item) AND {near}
        GROUP BY w.{key}, t.k, w.used, t.item)
)"""


CHANNEL_SQL = """dated AS (SELECT item, channel, domain, ratio, premiere, duration_s AS x,
  date_diff('day', DATE '1970-01-01', CAST(strptime(upload_date, '%Y%m%d') AS DATE)) AS day FROM pop WHERE ratio > 0),
tr AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY item) AS k FROM dated WHERE premiere),
ct AS (SELECT *, min(item) OVER (PARTITION BY channel, day, x) AS first FROM dated WHERE NOT premiere),
""" + walk_sql("tr", "ct", "channel", "days := abs(c.day - t.day), gap := abs(c.x - t.x)", "abs(c.day - t.day) <= 180") + """,
matched AS (SELECT w.channel, treated, control, abs(t.day - c.day) AS days, abs(t.x - c.x) AS gap, t.domain, t.ratio AS ratio_t, c.ratio AS ratio_c
  FROM walk w JOIN tr t ON t.item = w.treated JOIN ct c ON c.item = w.control)"""


def channel_matches(spark, sf):
    """The dated items, and the premieres with the nearest other item of their channel."""
    pop = population(spark, sf).where(F.col("ratio") > 0)
    rows = materialise(pop.select("item", "channel", "domain", "ratio", "premiere", "duration_s", F.unix_date(F.to_date("upload_date", "yyyyMMdd")).alias("day")))
    return rows, matching.match_in_channel(
        rows, id_="item", channel="channel", day="day", span="duration_s", treated=F.col("premiere"), seq="item"
    )


def channel_pairs(spark, sf):
    """Matched premieres with both ratios."""
    rows, pairs = channel_matches(spark, sf)
    side = lambda who: rows.select(F.col("item").alias(who), F.col("ratio").alias(f"{who}_ratio"), *(["domain"] if who == "treated" else []))
    return pairs.join(side("treated").hint("merge"), "treated").join(side("control").hint("merge"), "control")


@query("matched_pairs_channel", with_clause(POP, CHANNEL_SQL) + "SELECT channel, treated, control, days, gap FROM matched", "J11 D1")
def matched_pairs_channel(spark, sf):
    return channel_matches(spark, sf)[1].select("channel", "treated", "control", "days", "gap")


LOG_SQL = """chosen AS (SELECT item, channel, "group" FROM ext),
sized AS (SELECT item, "group", ln(CAST(size AS DOUBLE)) AS x, 0 AS one FROM chosen JOIN (SELECT channel, count(*) AS size FROM fit GROUP BY channel) USING (channel)),
tr AS (SELECT *, row_number() OVER (ORDER BY x, item) AS k FROM sized WHERE "group" = 'top'),
ct AS (SELECT *, min(item) OVER (PARTITION BY x) AS first FROM sized WHERE "group" = 'bottom'),
""" + walk_sql("tr", "ct", "one", "gap := abs(c.x - t.x)")


@query(
    "matched_pairs_log",
    with_clause(EXTREMES.replace("LIMIT 200", "LIMIT 100"), LOG_SQL)
    + "SELECT treated, control, floor(abs(t.x - c.x) * 1e9 + 0.5) / 1e9 AS gap FROM walk JOIN tr t ON t.item = treated JOIN ct c ON c.item = control",
    "J12 N5 J2",
)
def matched_pairs_log(spark, sf):
    """The extreme-group sample matched on the log of its channels' size (a confounder)."""
    pop = fit(spark, sf)
    sample = sampling.extremes(pop, n=100, cap=2).select("item", "channel", "group")
    # the channels of at most 200 items
    size = pop.join(F.broadcast(sample.select("channel").distinct()), "channel", "left_semi").groupBy("channel").agg(
        F.count("*").alias("channel_video_count")
    )
    rows = materialise(sample.join(size, "channel").withColumn("log_size", F.log(F.col("channel_video_count").cast("double"))))
    top, bottom = rows.where(F.col("group") == "top"), rows.where(F.col("group") == "bottom")
    pairs = matching.match_nearest(top, bottom, id_="item", value="log_size")
    return pairs.withColumn("gap", rnd("gap", 9))
