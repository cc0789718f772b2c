"""The driver's tables in the roles of the corpus: population, features, timelines, texts.

Each role exists twice: as a DataFrame builder and as a DuckDB common table expression, so that a
query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.functions.numbers import cents, rnd
from cuesheet.session import materialise

ITEM_LENGTH_S = 600.0  # 30 days of events are read as a 600 s item
US_PER_MS = 4_320_000  # 30 days / 600 s, in microseconds of wall clock per item millisecond
MOODS = ["bright", "calm", "dark", "tense", "warm"]
SHOTS = ["closeup", "wide", "medium", "insert"]
STYLES = ["anime", "live", "mixed"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Read a driver table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def pick_word(index, words):
    return F.element_at(F.array(*[F.lit(w) for w in words]), index + 1)


# ---------------------------------------------------------------- population


def population(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    k = F.col("o_orderkey")
    suffix = F.expr(
        """CASE pmod(o_orderkey, 12) WHEN 0 THEN ' (Live)' WHEN 1 THEN ' Official MV'
           WHEN 2 THEN ' cover' WHEN 3 THEN ' [MV]!' WHEN 4 THEN ' Remix' WHEN 5 THEN ' M/V !!'
           ELSE '' END"""
    )
    base = o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("item"),
        F.col("o_custkey").alias("channel"),
        F.col("c_name").alias("channel_name"),
        F.col("c_mktsegment").alias("domain"),
        cents("o_totalprice").alias("views"),
        F.when(F.col("c_acctbal") > 0, cents("c_acctbal")).alias("subs"),
        F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"),
        (F.lit(30) + (k * 7) % 630).cast("double").alias("duration_s"),
        F.when(k % 23 == 0, None).when(k % 19 == 0, 1080).otherwise(1920).cast("bigint").alias("width"),
        F.when(k % 23 == 0, None).when(k % 19 == 0, 1920).otherwise(1080).cast("bigint").alias("height"),
        (F.col("o_orderstatus") == "F").alias("premiere"),
        F.concat(F.lower("o_orderpriority"), F.lit(" song "), k.cast("string"), suffix).alias("title"),
        F.when(k % 13 != 0, F.floor(cents("o_totalprice") / (20 + k % 30))).alias("likes"),
        F.lower("o_orderpriority").alias("mood"),
    )
    return base.withColumn("ratio", rnd(F.col("views") / F.col("subs"), 4))


POP = """
pop AS (
  SELECT *, floor(CAST(views AS DOUBLE) / CAST(subs AS DOUBLE) * 10000.0 + 0.5) / 10000.0 AS ratio
  FROM (
    SELECT o_orderkey AS item, o_custkey AS channel, c_name AS channel_name,
           c_mktsegment AS domain,
           CAST(floor(o_totalprice * 100.0 + 0.5) AS BIGINT) AS views,
           CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal * 100.0 + 0.5) AS BIGINT) END AS subs,
           strftime(o_orderdate, '%Y%m%d') AS upload_date,
           CAST(30 + (o_orderkey * 7) % 630 AS DOUBLE) AS duration_s,
           CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 1080
                     ELSE 1920 END AS BIGINT) AS width,
           CAST(CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 1920
                     ELSE 1080 END AS BIGINT) AS height,
           o_orderstatus = 'F' AS premiere,
           lower(o_orderpriority) || ' song ' || CAST(o_orderkey AS VARCHAR) ||
             CASE o_orderkey % 12 WHEN 0 THEN ' (Live)' WHEN 1 THEN ' Official MV'
                  WHEN 2 THEN ' cover' WHEN 3 THEN ' [MV]!' WHEN 4 THEN ' Remix'
                  WHEN 5 THEN ' M/V !!' ELSE '' END AS title,
           CASE WHEN o_orderkey % 13 <> 0 THEN
             CAST(floor(CAST(CAST(floor(o_totalprice * 100.0 + 0.5) AS BIGINT) AS DOUBLE)
                        / (20 + o_orderkey % 30)) AS BIGINT) END AS likes,
           lower(o_orderpriority) AS mood
    FROM orders JOIN customer ON o_custkey = c_custkey))"""


def features(spark: SparkSession, sf: str, only: DataFrame | None = None) -> DataFrame:
    """One wide row per item; items without lines keep NULL in the line features.

    ``only`` is a sample of bounded size: its ids filter the lines before they are shuffled.
    """
    li = table(spark, sf, "lineitem")
    if only is not None:
        ids = F.broadcast(only.select(F.col("item").alias("l_orderkey")))
        li = li.join(ids, "l_orderkey", "left_semi")
    agg = li.groupBy("l_orderkey").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("_qty"),
        F.sum(cents("l_extendedprice")).alias("_price"),
        (F.min(cents("l_extendedprice")) / 100.0).alias("price_min"),
        (F.max(cents("l_extendedprice")) / 100.0).alias("price_max"),
        F.sum(cents("l_discount")).alias("_disc"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("_ret"),
        F.min(F.when(F.col("l_linenumber") == 1, F.col("l_returnflag"))).alias("flag_first"),
    )
    agg = agg.select(
        F.col("l_orderkey").alias("item"),
        F.col("n_lines").cast("double").alias("n_lines"),
        (F.col("_qty") / F.col("n_lines")).alias("qty_avg"),
        (F.col("_price") / F.col("n_lines") / 100.0).alias("price_avg"),
        "price_min",
        "price_max",
        (F.col("_disc") / F.col("n_lines")).alias("disc_avg"),
        (F.col("_ret") > 0).alias("any_return"),
        "flag_first",
    )
    pop = population(spark, sf)
    group = (
        F.when(F.col("ratio") >= 80, "top").when(F.col("ratio") < 25, "bottom")
        .when(F.col("ratio").isNotNull(), "middle")
    )
    return pop.join(agg, "item", "left").select(
        pop["*"],
        *[c for c in agg.columns if c != "item"],
        group.alias("group"),
        F.length("title").cast("double").alias("title_len"),
        F.when(F.col("likes").isNotNull(), rnd(F.col("likes") / F.col("views"), 4)).alias("like_rate"),
        F.col("title").rlike("(?i)\\bMV\\b").alias("has_mark"),
    )


def feature_table(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The named feature columns as a written table.

    For plans that read the features several times (cut points, statistics, rows): the join and the
    aggregation of the lines then run once, and the copy is one narrow row per item.
    """
    return materialise(features(spark, sf).select(*columns))


FEAT = POP + """,
feat AS (
  SELECT p.*, n_lines, qty_avg, price_avg, price_min, price_max, disc_avg, any_return, flag_first,
         CASE WHEN ratio >= 80 THEN 'top' WHEN ratio < 25 THEN 'bottom'
              WHEN ratio IS NOT NULL THEN 'middle' END AS "group",
         CAST(length(title) AS DOUBLE) AS title_len,
         CASE WHEN likes IS NOT NULL THEN
           floor(CAST(likes AS DOUBLE) / CAST(views AS DOUBLE) * 10000.0 + 0.5) / 10000.0 END AS like_rate,
         regexp_matches(title, '(?i)\\bMV\\b') AS has_mark
  FROM pop p LEFT JOIN (
    SELECT l_orderkey AS item, CAST(count(*) AS DOUBLE) AS n_lines,
           CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / count(*) AS qty_avg,
           CAST(sum(CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) / 100.0 AS price_avg,
           CAST(min(CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS price_min,
           CAST(max(CAST(floor(l_extendedprice * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / 100.0 AS price_max,
           CAST(sum(CAST(floor(l_discount * 100.0 + 0.5) AS BIGINT)) AS DOUBLE) / count(*) AS disc_avg,
           sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 0 AS any_return,
           min(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS flag_first
    FROM lineitem GROUP BY l_orderkey) a USING (item))"""

NUMERIC = [
    "duration_s", "n_lines", "qty_avg", "price_avg", "price_min", "price_max", "disc_avg",
    "title_len", "like_rate",
]
BINARY = ["premiere", "any_return", "has_mark"]
CATEGORICAL = ["mood", "flag_first"]


def numeric_long_sql(cols=NUMERIC, keep='item, domain, "group"') -> str:
    """UNION ALL form of unpivot for the oracles (nulls kept out)."""
    parts = [
        f"SELECT {keep}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat WHERE {c} IS NOT NULL"
        for c in cols
    ]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


# ---------------------------------------------------------------- timelines


def timed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events on the item clock: item = user, 30 days are 600 s, resolution 1 ms."""
    e = table(spark, sf, "events")
    us = F.expr(
        "timestampdiff(MICROSECOND, CAST('2024-01-01' AS TIMESTAMP_NTZ), CAST(ts AS TIMESTAMP_NTZ))"
    )
    return e.select(
        F.col("user_id").alias("item"),
        F.col("event_id").alias("seq"),
        F.floor(us / US_PER_MS).alias("t_ms"),
        F.col("event_type").alias("kind"),
        cents("value").alias("amount"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    ).withColumn("t_s", F.col("t_ms") / 1000.0)


EV = f"""
ev AS (
  SELECT *, CAST(t_ms AS DOUBLE) / 1000.0 AS t_s FROM (
    SELECT user_id AS item, event_id AS seq,
           CAST(floor(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / {US_PER_MS}) AS BIGINT) AS t_ms,
           event_type AS kind, CAST(floor(value * 100.0 + 0.5) AS BIGINT) AS amount,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k
    FROM events))"""


def intervals(spark: SparkSession, sf: str, ev: DataFrame | None = None) -> DataFrame:
    """Scenes: every event opens an interval that ends at the next one; the last ends at 600 s. ``ev``: events already at hand."""
    from cuesheet.operators.ordered import scan

    ev = timed_events(spark, sf) if ev is None else ev
    s = scan(
        ev,
        ["item"],
        ["t_ms", "seq"],
        after={"next_ms": F.col("t_ms")},
        running={"pos1": F.lit(1)},
    )
    k = F.col("k")
    end = F.coalesce(F.col("next_ms"), F.greatest(F.col("t_ms"), F.lit(int(ITEM_LENGTH_S * 1000))))
    return s.select(
        "item",
        (F.col("pos1") - 1).alias("pos"),
        "seq",
        F.col("t_ms").alias("start_ms"),
        end.alias("end_ms"),
        (F.col("t_ms") / 1000.0).alias("start_s"),
        (end / 1000.0).alias("end_s"),
        (end - F.col("t_ms")).alias("len_ms"),
        F.col("next_ms").isNull().alias("is_last"),
        "kind",
        "k",
        k.alias("bright_pct"),
        ((k * 7) % 100).alias("sat_pct"),
        F.format_string("#%02x%02x%02x", (k % 8 * 37) % 256, (k % 8 * 91) % 256, (k % 8 * 53) % 256).alias("color"),
    )


SCENES = EV + f"""
, scenes AS (
  SELECT item, pos, seq, start_ms, end_ms, CAST(start_ms AS DOUBLE) / 1000.0 AS start_s,
         CAST(end_ms AS DOUBLE) / 1000.0 AS end_s, end_ms - start_ms AS len_ms, is_last, kind, k,
         k AS bright_pct, (k * 7) % 100 AS sat_pct,
         printf('#%02x%02x%02x', (k % 8 * 37) % 256, (k % 8 * 91) % 256, (k % 8 * 53) % 256) AS color
  FROM (
    SELECT item, seq, t_ms AS start_ms, kind, k,
           row_number() OVER w - 1 AS pos,
           coalesce(lead(t_ms) OVER w, greatest(t_ms, {int(ITEM_LENGTH_S * 1000)})) AS end_ms,
           lead(t_ms) OVER w IS NULL AS is_last
    FROM ev WINDOW w AS (PARTITION BY item ORDER BY t_ms, seq)))"""


def tags(spark: SparkSession, sf: str, ev: DataFrame | None = None) -> DataFrame:
    """Labels in list order without the error events, so that the tail of an item has none."""
    from cuesheet.operators.ordered import scan

    ev = (timed_events(spark, sf) if ev is None else ev).where(F.col("kind") != "error")
    s = scan(ev, ["item"], ["t_ms", "seq"], running={"pos1": F.lit(1)})
    k = F.col("k")
    return s.select(
        "item",
        (F.col("pos1") - 1).alias("pos"),
        F.col("kind").alias("setting"),
        pick_word((k % 5).cast("int"), MOODS).alias("mood"),
        pick_word((k % 4).cast("int"), SHOTS).alias("shot_type"),
        pick_word((k % 3).cast("int"), STYLES).alias("style"),
        F.when(k % 7 != 0, k % 6).alias("num_characters"),
        (k % 2 == 0).alias("has_text"),
    )


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


TAGS = SCENES + f"""
, tags AS (
  SELECT item, row_number() OVER (PARTITION BY item ORDER BY t_ms, seq) - 1 AS pos,
         kind AS setting, {_list(MOODS)}[k % 5 + 1] AS mood, {_list(SHOTS)}[k % 4 + 1] AS shot_type,
         {_list(STYLES)}[k % 3 + 1] AS style,
         CASE WHEN k % 7 <> 0 THEN k % 6 END AS num_characters, k % 2 = 0 AS has_text
  FROM ev WHERE kind <> 'error')"""


def points(spark: SparkSession, sf: str, kind: str, ev: DataFrame | None = None) -> DataFrame:
    """Point times of one event kind: click = cuts, view = beats, purchase = lines."""
    ev = (timed_events(spark, sf) if ev is None else ev).where(F.col("kind") == kind)
    t = F.col("t_ms") + F.col("k") * 137 % 20000 if kind == "purchase" else F.col("t_ms")
    return ev.select("item", "seq", t.alias("t_ms"), "k")


POINTS = EV + """
, cuts AS (SELECT item, seq, t_ms, k FROM ev WHERE kind = 'click'),
beats AS (SELECT item, seq, t_ms, k FROM ev WHERE kind = 'view'),
tl AS (SELECT item, seq, t_ms + k * 137 % 20000 AS t_ms, k FROM ev WHERE kind = 'purchase')"""


def probes(spark: SparkSession, sf: str) -> DataFrame:
    """Times to look up; the clock runs 20 % too fast, so that some lie past the end."""
    ev = timed_events(spark, sf).where(F.col("kind") == "signup")
    return ev.select("item", "seq", F.floor(F.col("t_ms") * 6 / 5).alias("t_ms"))


PROBES = """
probes AS (SELECT item, seq, CAST(floor(t_ms * 6 / 5) AS BIGINT) AS t_ms FROM ev WHERE kind = 'signup')"""


def _binned(spark, sf, width_ms: int, bins: int, value, ev: DataFrame | None = None) -> DataFrame:
    """Dense bins per item: a grid of ``bins`` rows per item, 0 where nothing happened."""
    ev = timed_events(spark, sf) if ev is None else ev
    got = ev.groupBy("item", F.floor(F.col("t_ms") / width_ms).alias("bin")).agg(value.alias("v"))
    grid = ev.select("item").distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")))
    )
    return grid.join(got, ["item", "bin"], "left").select(
        "item", "bin", F.coalesce("v", F.lit(0)).alias("value")
    )


def energy(spark: SparkSession, sf: str, ev: DataFrame | None = None) -> DataFrame:
    """Energy per 10 s bin: 60 bins per item, each the summed amount in cents."""
    return _binned(spark, sf, 10000, 60, F.sum("amount"), ev)


def _grid_sql(name: str, width: int, bins: int, value: str, extra: str = "") -> str:
    return f"""
{name} AS (
  SELECT g.item, g.bin, {extra} CAST(coalesce(h.v, 0) AS BIGINT) AS value
  FROM (SELECT item, CAST(b AS BIGINT) AS bin FROM (SELECT DISTINCT item FROM ev), range(0, {bins}) r(b)) g
  LEFT JOIN (SELECT item, CAST(floor(CAST(t_ms AS DOUBLE) / {width}) AS BIGINT) AS bin, {value} AS v
             FROM ev GROUP BY 1, 2) h USING (item, bin))"""


ENERGY = _grid_sql("energy", 10000, 60, "sum(amount)")


def replay(spark: SparkSession, sf: str) -> DataFrame:
    """Replay curve: 100 bins of 6 s with the number of events."""
    start = F.col("bin") * 6.0
    return _binned(spark, sf, 6000, 100, F.count("*")).withColumns(
        {"start_time": start, "end_time": start + 6.0}
    )


REPLAY = _grid_sql("replay", 6000, 100, "count(*)", "g.bin * CAST(6 AS DOUBLE) AS start_time, g.bin * CAST(6 AS DOUBLE) + 6 AS end_time,")


# ---------------------------------------------------------------- texts


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


LINES = r"""
lines AS (
  SELECT doc_id AS item, lang, source, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos,
         unnest(parts) AS line
  FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)),
timed_lines AS (SELECT *, pos * 4 AS t_s FROM lines)"""


def with_clause(*parts: str) -> str:
    return "WITH RECURSIVE " + ", ".join(p.strip() for p in parts) + "\n"
