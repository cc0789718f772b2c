"""Audits, digests, merges, exports and column rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions.numbers import rnd
from cuesheet.operators import audit, claims, digest_tree, tables
from cuesheet.plans.registry import query
from cuesheet.plans.roles import (
    EV, FEAT, NUMERIC, POP, SCENES, TAGS, documents, features, intervals, population, table, tags, timed_events, with_clause,
)
from cuesheet.plans.text_queries import CLEAN_SQL, LATIN_SHARE, cleaned

# ------------------------------------------------------------- audits

AUDITED = [*NUMERIC, "flat", "holes", "rare", "absent_column"]
AUD_SQL = 'af AS (SELECT *, 1.0 AS flat, CASE WHEN item % 5 = 0 THEN CAST(\'NaN\' AS DOUBLE) ELSE price_avg END AS holes, CASE WHEN item % 2999 = 1 THEN price_avg END AS rare FROM feat)'


@query(
    "table_audit",
    with_clause(FEAT, AUD_SQL)
    + """SELECT 'warning' AS level, 'missing column' AS "check", 'absent_column' AS subject, CAST(0 AS BIGINT) AS n
         UNION ALL SELECT 'info', 'experimental column', 'ext_flat', 0
         UNION ALL SELECT 'error', 'non-finite', 'holes', count(*) FROM af WHERE isnan(holes) HAVING count(*) > 0
         UNION ALL SELECT 'warning', 'constant', s, count(DISTINCT v) FROM (
           SELECT 'flat' AS s, CAST(flat AS DOUBLE) AS v FROM af UNION ALL SELECT 'rare', rare FROM af UNION ALL SELECT 'holes', holes FROM af WHERE NOT isnan(holes)
           ) GROUP BY s HAVING count(DISTINCT v) = 1
         UNION ALL SELECT 'warning', 'low coverage', 'rare:top', count(rare) FILTER ("group" = 'top') FROM af HAVING count(rare) FILTER ("group" = 'top') < 10
         UNION ALL SELECT 'warning', 'low coverage', 'rare:bottom', count(rare) FILTER ("group" = 'bottom') FROM af HAVING count(rare) FILTER ("group" = 'bottom') < 10""",
    "X1 U5",
)
def table_audit(spark, sf):
    k = F.col("item")
    df = features(spark, sf).withColumns({
        "flat": F.lit(1.0),
        "holes": F.when(k % 5 == 0, float("nan")).otherwise(F.col("price_avg")),
        "rare": F.when(k % 2999 == 1, F.col("price_avg")),
        "ext_flat": F.lit(1),
    })
    return audit.table_audit(df, AUDITED)


@query(
    "dataset_invariants",
    with_clause(POP)
    + """, c AS (SELECT count(*) AS n, count(DISTINCT item) AS d FROM pop)
         SELECT 'unique ids' AS "check", n AS expected, d AS actual, n = d AS ok FROM c
         UNION ALL SELECT 'empty ids', 0, count(*) FILTER (item IS NULL), count(*) FILTER (item IS NULL) = 0 FROM pop
         UNION ALL SELECT 'columns', 15, 15, true
         UNION ALL SELECT 'domain=BUILDING', 3000, count(*) FILTER (domain = 'BUILDING'), count(*) FILTER (domain = 'BUILDING') = 3000 FROM pop
         UNION ALL SELECT 'domain=MACHINERY', 3000, count(*) FILTER (domain = 'MACHINERY'), count(*) FILTER (domain = 'MACHINERY') = 3000 FROM pop""",
    "X2",
)
def dataset_invariants(spark, sf):
    return audit.dataset_invariants(
        population(spark, sf), "item", columns=(15, 16), counts={"domain": {"BUILDING": 3000, "MACHINERY": 3000}}
    )


@query(
    "corpus_audit",
    with_clause(TAGS)
    + """, s AS (SELECT item, count(*) AS n, max(end_s) AS d FROM scenes GROUP BY item),
         t AS (SELECT item, count(*) AS m FROM tags GROUP BY item),
         j AS (SELECT s.item, n, coalesce(m, 0) AS m, n + CASE WHEN s.item % 10 = 0 THEN 1 ELSE 0 END AS summary_n,
                 d, d + CASE WHEN s.item % 7 = 0 THEN 2.0 ELSE 0.5 END AS fd,
                 CASE WHEN s.item % 4 <> 0 THEN 'asr' END AS src, CASE WHEN s.item % 6 = 0 THEN 0 ELSE n END AS nl FROM s LEFT JOIN t USING (item))
         SELECT item, 'error' AS level, 'scene count mismatch' AS finding FROM j WHERE summary_n <> n
         UNION ALL SELECT item, 'error', 'scene/tag count mismatch' FROM j WHERE m <> n
         UNION ALL SELECT item, 'error', 'duration mismatch' FROM j WHERE abs(fd - d) > 1.5
         UNION ALL SELECT item, 'warning', 'lines without a source' FROM j WHERE src IS NULL AND nl > 0
         UNION ALL SELECT item, 'warning', 'source without lines' FROM j WHERE src IS NOT NULL AND nl = 0""",
    "X3",
)
def corpus_audit(spark, sf):
    s = intervals(spark, sf).groupBy("item").agg(F.count("*").alias("scene_rows"), F.max("end_s").alias("scene_duration"))
    t = tags(spark, sf).groupBy("item").agg(F.count("*").alias("tag_rows"))
    k = F.col("item")
    rows = s.join(t, "item", "left").na.fill(0, ["tag_rows"]).withColumns({
        "summary_scenes": F.col("scene_rows") + F.when(k % 10 == 0, 1).otherwise(0),
        "feature_duration": F.col("scene_duration") + F.when(k % 7 == 0, 2.0).otherwise(0.5),
        "audio_duration": F.lit(None).cast("double"),
        "line_source": F.when(k % 4 != 0, "asr"),
        "line_rows": F.when(k % 6 == 0, 0).otherwise(F.col("scene_rows")),
    })
    return audit.consistency(rows)


@query(
    "schema_variants",
    "WITH p AS (SELECT event_id, props, list_sort(regexp_extract_all(props, '\"([a-z]+)\":', 1)) AS ks FROM events) "
    "SELECT substr(sha256(array_to_string(ks, chr(10))), 1, 12) AS signature, count(*) AS n, CAST(max(len(ks)) AS BIGINT) AS n_keys, min(event_id) AS sample_item FROM p GROUP BY 1",
    "X3 R2",
)
def schema_variants(spark, sf):
    return audit.schema_variants(table(spark, sf, "events"), "event_id", "props")


#: The id and the columns with their types of every table: s text or integer, d double, f list of floats, t time.
DIGESTED = {
    "region": ("r_regionkey", "r_regionkey:s r_name:s"), "nation": ("n_nationkey", "n_nationkey:s n_name:s n_regionkey:s"),
    "customer": ("c_custkey", "c_custkey:s c_name:s c_nationkey:s c_acctbal:d c_mktsegment:s"),
    "supplier": ("s_suppkey", "s_suppkey:s s_name:s s_nationkey:s s_acctbal:d"),
    "part": ("p_partkey", "p_partkey:s p_name:s p_brand:s p_type:s p_size:s p_retailprice:d"),
    "orders": ("o_orderkey", "o_orderkey:s o_custkey:s o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s"),
    "lineitem": ("l_orderkey", "l_orderkey:s l_partkey:s l_suppkey:s l_linenumber:s l_quantity:d l_extendedprice:d l_discount:d l_tax:d "
                 "l_returnflag:s l_linestatus:s l_shipdate:t"),
    "events": ("event_id", "event_id:s ts:t user_id:s event_type:s value:d props:s"),
    "documents": ("doc_id", "doc_id:s text:s lang:s source:s n_chars:s"), "embeddings": ("vec_id", "vec_id:s embedding:f label:s"),
    "pages": ("page_id", "page_id:s url:s html:s"), "benchmark": ("item_id", "item_id:s text:s"), "labels": ("doc_id", "doc_id:s quality:s toxic:s"),
    "conversations": ("conv_id", "conv_id:s turn:s role:s text:s"),
}


def canonical_sql(c: str, kind: str) -> str:
    number = "CAST(CAST(floor({x}) AS BIGINT) AS VARCHAR) || '+' || CAST(CAST(floor(({x} - floor({x})) * 1099511627776.0) AS BIGINT) AS VARCHAR)"
    return {
        "s": f"regexp_replace(CAST({c} AS VARCHAR), '\\r\\n?', chr(10), 'g')", "d": number.format(x=c), "t": f"CAST(epoch_us({c}) AS VARCHAR)",
        "f": f"'[' || array_to_string(list_transform({c}, lambda e: {number.format(x='CAST(e AS DOUBLE)')}), ',') || ']'",
    }[kind]


def tree_sql(name: str, width: int = digest_tree.WIDTH, fan: int = digest_tree.FAN, leaf: int = digest_tree.LEAF) -> str:
    """Rows, ranges, one or two levels of parents, root; ranges of more than `leaf` rows by the digits of their digests."""
    id_, columns = DIGESTED[name]
    parts = ", ".join(f"'{c}=' || {canonical_sql(c, k)}" for c, k in sorted(x.split(":") for x in columns.split()))
    return f"""SELECT '{name}' AS name, * FROM (WITH d AS (SELECT floor({id_} / {width}.0) AS cell, sha256(concat_ws(chr(31), {parts})) AS d FROM {name}),
      c AS (SELECT CAST(cell AS BIGINT) AS cell, d, count(*) AS n FROM d GROUP BY ALL),
      k AS (SELECT *, CAST(greatest(0, ceil(ln(count(*) OVER (PARTITION BY cell) / {leaf}.0) / ln(16.0))) AS INT) AS digits FROM c),
      l AS (SELECT cell, digits, left(d, digits) AS prefix, sha256(string_agg(d || ':' || CAST(n AS VARCHAR), chr(10) ORDER BY d)) AS digest, sum(n) AS n FROM k GROUP BY ALL),
      r AS (SELECT cell, CASE WHEN digits = 0 THEN any_value(digest) ELSE sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) END AS digest, sum(n) AS n FROM l GROUP BY cell, digits),
      p AS (SELECT cell // {fan} AS cell, sha256(string_agg(CAST(cell AS VARCHAR) || ':' || digest, chr(10) ORDER BY cell)) AS digest, sum(n) AS n FROM r GROUP BY 1),
      q AS (SELECT sha256(string_agg(CAST(cell AS VARCHAR) || ':' || digest, chr(10) ORDER BY cell)) AS digest FROM p)
      SELECT CAST((SELECT sum(n) FROM r) AS BIGINT) AS n,  sha256('+:' || CASE WHEN (SELECT count(*) FROM r) = 1 THEN (SELECT max(digest) FROM r) WHEN (SELECT count(*) FROM p) = 1 THEN (SELECT max(digest) FROM p) ELSE (SELECT digest FROM q) END) AS digest)"""


@query("content_digest", " UNION ALL ".join(map(tree_sql, DIGESTED)), "X6 S8")
def content_digest(spark, sf):
    """Roots of the hash trees of all tables, every column."""
    out = None
    for name, (id_, _) in DIGESTED.items():
        row = digest_tree.root(digest_tree.ranges(table(spark, sf, name), id_)).select(F.lit(name).alias("name"), "n", "digest")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "stale_artifacts",
    """WITH m AS (SELECT c_custkey AS item, c_mktsegment AS artifact, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN md5(c_mktsegment || '-old') ELSE md5(c_mktsegment) END AS fingerprint FROM customer)
       SELECT item, artifact, fingerprint, md5(artifact) AS current FROM m WHERE fingerprint <> md5(artifact)""",
    "X10",
)
def stale_artifacts(spark, sf):
    c = table(spark, sf, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    manifest = c.select(
        k.alias("item"), seg.alias("artifact"),
        F.when(k % 10 == 0, None).when(k % 7 == 0, F.md5(F.concat(seg, F.lit("-old")))).otherwise(F.md5(seg)).alias("fingerprint"),
    )
    current = c.select(seg.alias("artifact")).distinct().withColumn("fingerprint", F.md5("artifact"))
    return audit.stale_artifacts(manifest, current).select("item", "artifact", "fingerprint", "current")


# ------------------------------------------------------------- lines

STRICT = 0.8
BOTH_SQL = CLEAN_SQL + f""",
kept8 AS (SELECT * FROM raw WHERE length(line) >= 2 AND {LATIN_SHARE} >= {STRICT}),
strict AS (SELECT doc_id, pos * 4 AS t_s, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM kept8) WHERE prev IS NULL OR prev <> line),
nb AS (SELECT doc_id, count(*) AS n, min(t_s) AS f FROM strict GROUP BY doc_id), na AS (SELECT doc_id, count(*) AS n, min(t_s) AS f FROM clean GROUP BY doc_id),
rd AS (SELECT d.doc_id, d.source, coalesce(nb.n, 0) AS n_before, CASE WHEN source = 'src1' THEN coalesce(nb.n, 0) ELSE coalesce(na.n, 0) END AS n_lines,
   CASE WHEN source = 'src1' THEN nb.f ELSE na.f END AS first_line_s, source <> 'src1' AS rederived FROM documents d LEFT JOIN nb USING (doc_id) LEFT JOIN na USING (doc_id))"""


def rederived(spark, sf):
    d = documents(spark, sf)
    before = tx.clean_lines("text", latin=True, share=STRICT)
    after = tx.clean_lines("text", latin=True)
    both = d.select("doc_id", "source", before.alias("_b"), after.alias("_a"))
    return tables.rederive(both, F.col("source") == "src1", F.col("_b"), F.col("_a")).drop("_a", "_b")


@query("rederive_lines", with_clause(BOTH_SQL) + "SELECT *, n_before >= 8 AS passed_before, n_lines >= 8 AS passes_now FROM rd", "F6")
def rederive_lines(spark, sf):
    return rederived(spark, sf)


@query(
    "remaining_failures",
    with_clause(BOTH_SQL)
    + """, sg AS (SELECT conv_id, count(*) AS n_segments FROM conversations GROUP BY conv_id)
         SELECT doc_id, source, n_lines, n_segments FROM rd LEFT JOIN sg ON conv_id = doc_id WHERE source <> 'src1' AND n_lines < 8""",
    "X11 J2",
)
def remaining_failures(spark, sf):
    seg = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_segments"))
    short = rederived(spark, sf).where((F.col("source") != "src1") & (F.col("n_lines") < tx.MIN_LINES))
    return tables.fill_absent(short.select("doc_id", "source", "n_lines"), seg, "doc_id", "n_segments")


VOCAB = ["love", "night", "city", "sea"]


@query(
    "levels_and_vocabulary",
    with_clause(BOTH_SQL)
    + """, v AS (SELECT rd.*, n_chars FROM rd JOIN documents USING (doc_id))
         SELECT v.doc_id, CASE WHEN n_before >= 8 THEN 'ocr' WHEN n_lines > 0 THEN 'asr' END AS chosen, CAST(n_chars % 50 AS DOUBLE) / 400.0 >= 0.1 AS has_hardsub,
           CASE n_chars % 4 WHEN 0 THEN 'love' WHEN 1 THEN 'sea' WHEN 2 THEN NULL ELSE 'city' END AS topic_1, CASE WHEN n_chars % 4 = 0 THEN 'night' END AS topic_2 FROM v""",
    "F5 F21 R1",
)
def levels_and_vocabulary(spark, sf):
    """Source choice, frame ratio and the first known topics (unknown words dropped, two at most)."""
    d = documents(spark, sf)
    before, after = tx.clean_lines("text", latin=True, share=STRICT), tx.clean_lines("text", latin=True)
    d = d.select("doc_id", "source", "n_chars", "text", tx.pin(F.size(before)).alias("n_before"))
    lines = F.when(F.col("source") == "src1", F.col("n_before")).otherwise(F.size(after))
    d = d.select("doc_id", "n_chars", "n_before", tx.pin(lines).alias("n_after"))
    n = F.col("n_chars") % 4
    said = F.when(n == 0, F.array(*[F.lit(x) for x in ("love", "robots", "night", "sea")])).when(
        n == 1, F.array(F.lit("zzz"), F.lit("sea"))).when(n == 2, F.array(F.lit("nothing"))).otherwise(F.array(F.lit("city")))
    topics = tables.in_vocabulary(said, VOCAB, 2)
    return d.select(
        "doc_id", tables.choose_source(F.col("n_before"), F.col("n_after")).alias("chosen"),
        tables.hardsub(F.col("n_chars") % 50, F.lit(400.0)).alias("has_hardsub"),
        F.try_element_at(topics, F.lit(1)).alias("topic_1"), F.try_element_at(topics, F.lit(2)).alias("topic_2"),
    )


CAP_SQL = """ct AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'ocr' ELSE 'asr' END AS lyrics_source, CASE WHEN doc_id % 19 = 0 THEN 'timeout' END AS error,
   doc_id % 3 <> 2 AS orig, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE 2 END AS n_manual FROM documents)"""


def scanned(spark, sf):
    d = documents(spark, sf)
    k = F.col("doc_id")
    none = F.create_map(F.lit("live_chat"), F.lit("x"))
    some = F.create_map(F.concat("lang", F.lit("-ORIG")), F.lit("u"), F.lit("zz"), F.lit("v"), F.lit("live_chat"), F.lit("x"))
    rows = d.select(
        "doc_id", "lang",
        F.when(k % 4 == 0, None).when(k % 4 == 1, "ocr").otherwise("asr").alias("lyrics_source"),
        F.when(k % 19 == 0, "timeout").alias("error"),
        F.when(k % 3 == 2, none).otherwise(some).alias("subtitles"), none.alias("automatic"),
    )
    return tables.track_summary(rows, "subtitles", "automatic", "lang")


@query(
    "caption_summary",
    with_clause(CAP_SQL)
    + """SELECT coalesce(lyrics_source, 'None') AS lyrics_source, count(*) AS n, count(*) FILTER (n_manual > 0) AS with_manual_track, count(*) FILTER (orig) AS with_original_track
         FROM ct WHERE error IS NULL GROUP BY 1""",
    "A16 F18",
)
def caption_summary(spark, sf):
    return tables.scan_summary(scanned(spark, sf))


@query(
    "caption_recoverable",
    with_clause(CAP_SQL) + "SELECT doc_id, CASE WHEN lyrics_source IS NULL THEN 'recoverable' ELSE 'upgradable' END AS kind FROM ct WHERE error IS NULL AND orig AND (lyrics_source IS NULL OR lyrics_source = 'asr')",
    "A16",
)
def caption_recoverable(spark, sf):
    return tables.recoverable(scanned(spark, sf)).select("doc_id", "kind")


# ------------------------------------------------------------- tables

@query(
    "channel_counts",
    with_clause(POP)
    + "SELECT item, channel, count(*) OVER (PARTITION BY channel) AS channel_video_count FROM pop",
    "A23",
)
def channel_counts(spark, sf):
    return tables.attach_counts(population(spark, sf).select("item", "channel"), ["channel"], "channel_video_count")


@query("first_found", with_clause(EV) + "SELECT item, arg_min(kind, seq) AS kind, min(seq) AS seq FROM ev GROUP BY item", "A24")
def first_found(spark, sf):
    return tables.first_found(timed_events(spark, sf), "item", "kind", "seq")


@query("corpus_metadata", "SELECT count(*) AS n, min(strftime(ts, '%Y-%m-%d')) AS collection_start, max(strftime(ts, '%Y-%m-%d')) AS collection_end FROM events", "A25 D3")
def corpus_metadata(spark, sf):
    return tables.corpus_metadata(table(spark, sf, "events"), "ts")


@query(
    "date_parts",
    with_clause(POP)
    + """SELECT item, CAST(isodow(strptime(upload_date, '%Y%m%d')) - 1 AS INTEGER) AS weekday, CAST(abs(date_diff('day', DATE '1998-01-01', CAST(strptime(upload_date, '%Y%m%d') AS DATE))) AS INTEGER) AS days_apart,
           'vid' || lpad(CAST(item AS VARCHAR), 8, '0') AS video_id FROM pop""",
    "D1 D2 F19",
)
def date_parts(spark, sf):
    day = F.to_date("upload_date", "yyyyMMdd")
    vid = F.concat(F.lit("vid"), F.lpad(F.col("item").cast("string"), 8, "0"))
    url = F.when(F.col("item") % 3 == 0, F.concat(F.lit("https://youtu.be/"), vid)).when(
        F.col("item") % 3 == 1, F.concat(F.lit("https://host/watch?v="), vid, F.lit("&t=3"))).otherwise(vid)
    return population(spark, sf).select(
        "item", F.weekday(day).alias("weekday"), F.abs(F.datediff(day, F.lit("1998-01-01").cast("date"))).alias("days_apart"),
        tx.id_from_url(url).alias("video_id"),
    )


SNAP_SQL = """sn AS (SELECT item, CASE WHEN item % 2 = 0 THEN 'top' ELSE 'bottom' END AS "group", count(*) FILTER (t_ms < 60000) AS v1, count(*) AS v2 FROM ev GROUP BY item),
gr AS (SELECT item, "group", v2 - v1 AS increase, CASE WHEN v1 <> 0 THEN CAST(v2 - v1 AS DOUBLE) / v1 * 100.0 ELSE 0.0 END AS pct FROM sn WHERE item % 13 <> 0)"""


def snapshots(spark, sf):
    """Two dated snapshots of a running count; every 13th item misses the first."""
    ev = timed_events(spark, sf)
    group = F.when(F.col("item") % 2 == 0, "top").otherwise("bottom")
    early = ev.groupBy("item").agg(F.count_if(F.col("t_ms") < 60000).alias("views"))
    first = early.withColumn("views", F.when(F.col("item") % 13 != 0, F.col("views")))
    last = ev.groupBy("item").agg(F.count("*").alias("views")).withColumn("group", group)
    return first, last


@query("snapshot_growth", with_clause(EV, SNAP_SQL) + "SELECT * FROM (SELECT * FROM gr ORDER BY increase DESC, item LIMIT 15)", "J14 K7")
def snapshot_growth(spark, sf):
    first, last = snapshots(spark, sf)
    return tables.growth(first, last, "item", "views", "group").orderBy(F.col("increase").desc(), "item").limit(15)


@query(
    "growth_medians",
    with_clause(EV, SNAP_SQL)
    + """SELECT "group", max(increase) FILTER (i = n // 2) AS upper_median, max(n) AS n FROM (
           SELECT "group", increase, row_number() OVER (PARTITION BY "group" ORDER BY increase) - 1 AS i, count(*) OVER (PARTITION BY "group") AS n FROM gr) GROUP BY "group" """,
    "A22",
)
def growth_medians(spark, sf):
    first, last = snapshots(spark, sf)
    return tables.upper_medians(tables.growth(first, last, "item", "views", "group"), "group", "increase")


@query(
    "merge_sources",
    with_clause(FEAT)
    + """SELECT item, title, CASE WHEN item % 3 = 0 THEN NULL ELSE price_avg END AS dummy, coalesce(CASE WHEN item % 3 <> 0 THEN price_avg END, CASE WHEN item % 2 = 0 THEN qty_avg END, CASE WHEN item % 5 = 0 THEN n_lines END) AS score,
           CASE WHEN item % 5 = 0 THEN disc_avg END AS heat FROM feat""",
    "J3",
)
def merge_sources(spark, sf):
    f = features(spark, sf)
    k = F.col("item")
    own = F.when(k % 3 != 0, F.col("price_avg"))
    base = f.select("item", "title", own.alias("dummy"), own.alias("score"))
    one = f.where(k % 5 == 0).select("item", F.col("n_lines").alias("score"), F.col("disc_avg").alias("heat"))
    two = f.where(k % 2 == 0).select("item", F.col("qty_avg").alias("score"))
    return tables.merge_sources(base, [one, two], "item")


@query(
    "resume_antijoin",
    with_clause(EV) + "SELECT item, seq, kind FROM ev WHERE seq NOT IN (SELECT seq FROM ev WHERE k < 70 AND kind <> 'error')",
    "J15 U5",
)
def resume_antijoin(spark, sf):
    ev = timed_events(spark, sf)
    done = ev.where((F.col("k") < 70) & (F.col("kind") != "error")).select("seq")
    return ev.select("item", "seq", "kind").join(done, "seq", "left_anti")


EXPORT_SQL = """ex AS (SELECT item, lower(domain) AS domain, title, CASE WHEN domain <> 'MACHINERY' THEN ratio END AS ratio,
  CASE WHEN domain = 'MACHINERY' THEN duration_s END AS duration_s, CASE WHEN domain <> 'MACHINERY' THEN n_lines END AS n_lines FROM feat WHERE domain IS NOT NULL)"""


@query("public_export", with_clause(FEAT, EXPORT_SQL) + "SELECT * FROM ex", "S7 P9 U3")
def public_export(spark, sf):
    """All domains; one of them brings another set of columns."""
    f = features(spark, sf)
    names = [r["domain"] for r in f.select("domain").distinct().where("domain is not null").orderBy("domain").collect()]
    domains, extras = {}, {}
    for d in names:
        own = f.where(F.col("domain") == d)
        if d == "MACHINERY":
            domains[d.lower()] = own.select("item", "title", "mood", "duration_s")
        else:
            domains[d.lower()] = own.select("item", "title", "mood", "ratio")
            extras[d.lower()] = [own.select("item", "n_lines")]
    return tables.public_export(domains, extras, "item", drop=["mood"])


@query(
    "explorer_filter",
    with_clause(FEAT)
    + """SELECT item, title, channel_name AS channel, CASE WHEN item % 2 = 0 THEN price_avg END AS price, price_avg AS price_looked_up, len([x for x in [price_avg, qty_avg, ratio] if x IS NOT NULL]) AS n_features
         FROM feat WHERE domain = 'FURNITURE' AND "group" = 'top' AND contains(lower(title || ' ' || channel_name), 'customer#0000001')""",
    "P5 P6 P10",
)
def explorer_filter(spark, sf):
    f = features(spark, sf).withColumn("channel", F.col("channel_name"))
    kept = tables.explorer(f, "FURNITURE", "top", " Customer#0000001 ")
    shaped = kept.select(
        "item", "title", "channel", F.when(F.col("item") % 2 == 0, F.col("price_avg")).alias("price"),
        tables.feature_map(["price_avg", "qty_avg", "ratio"]).alias("features"),
    )
    return shaped.select(
        "item", "title", "channel", "price", tables.numeric_value(shaped, "price_avg").alias("price_looked_up"),
        F.size("features").cast("bigint").alias("n_features"),
    )


@query(
    "feature_categories",
    """WITH n AS (SELECT n_name, lower(replace(n_name, 'NATION', CASE n_nationkey % 7 WHEN 0 THEN 'scene_avg_saturation' WHEN 1 THEN 'scene_x' WHEN 2 THEN 'hook_x' WHEN 3 THEN 'tag_lyrics_x' WHEN 4 THEN 'thumb_x' WHEN 5 THEN 'sync_x' ELSE 'tag_x' END)) AS f0, n_nationkey FROM nation),
       m AS (SELECT CASE WHEN n_nationkey % 7 = 0 THEN 'scene_avg_saturation' ELSE f0 END AS feature FROM n)
       SELECT feature, CASE WHEN feature = 'scene_avg_saturation' THEN 'visual' WHEN starts_with(feature, 'scene_') THEN 'editing' WHEN starts_with(feature, 'hook_') THEN 'hook'
         WHEN starts_with(feature, 'tag_lyrics_') THEN 'lyrics' WHEN starts_with(feature, 'thumb_') THEN 'packaging' WHEN starts_with(feature, 'sync_') THEN 'synchronization'
         WHEN starts_with(feature, 'tag_') THEN 'visual' ELSE 'metadata' END AS category FROM m""",
    "P8",
)
def feature_categories(spark, sf):
    words = ["scene_avg_saturation", "scene_x", "hook_x", "tag_lyrics_x", "thumb_x", "sync_x", "tag_x"]
    k = (F.col("n_nationkey") % 7).cast("int")
    name = F.when(k == 0, "scene_avg_saturation").otherwise(
        F.lower(F.replace(F.col("n_name"), F.lit("NATION"), F.element_at(F.array(*[F.lit(w) for w in words]), k + 1)))
    )
    return table(spark, sf, "nation").select(name.alias("feature")).withColumn("category", claims.feature_category(F.col("feature")))


@query(
    "target_join_topk",
    with_clause(FEAT)
    + """, w AS (SELECT 7 AS item UNION ALL SELECT 150 UNION ALL SELECT -1 UNION ALL SELECT -2)
         SELECT w.item, f.title, f.item IS NOT NULL AS found FROM w LEFT JOIN feat f ON f.item = w.item""",
    "J17",
)
def target_join_topk(spark, sf):
    """Favourites found in the corpus and those missing."""
    from cuesheet.operators.profile import split_list

    corpus = features(spark, sf).select("item", "title")
    # the list: two known ids from the corpus itself and two that do not exist
    asked = corpus.where(F.col("item").isin(7, 150)).select("item").unionByName(
        corpus.where(F.col("item").isin(1, 2)).select((-F.col("item")).alias("item"))
    )
    found, missing = split_list(asked, corpus, "item")
    return found.withColumn("found", F.lit(True)).unionByName(
        missing.withColumns({"title": F.lit(None).cast("string"), "found": F.lit(False)})
    )


ARTIFACTS = [f"{kind}@{hour:02d}" for kind in ("cart", "click", "purchase", "view") for hour in range(0, 24, 4)]


@query(
    "artifact_completeness",
    """WITH need AS (SELECT k.unnest || '@' || lpad(CAST(h.unnest AS VARCHAR), 2, '0') AS part
         FROM unnest(['cart', 'click', 'purchase', 'view']) k, unnest(range(0, 24, 4)) h),
       have AS (SELECT DISTINCT user_id AS item, event_type || '@' || lpad(CAST(hour(ts) // 4 * 4 AS VARCHAR), 2, '0') AS part FROM events),
       lack AS (SELECT i.item, n.part FROM (SELECT DISTINCT item FROM have) i CROSS JOIN need n EXCEPT SELECT item, part FROM have)
       SELECT i.item, coalesce(string_agg(l.part, ',' ORDER BY l.part), '') AS missing, count(l.part) = 0 AS complete
       FROM (SELECT DISTINCT item FROM have) i LEFT JOIN lack l ON l.item = i.item GROUP BY i.item""",
    "X3",
)
def artifact_completeness(spark, sf):
    """Which parts of a closed list an item lacks: every kind of event in every four hours of the day."""
    hour = F.lpad((F.floor(F.hour("ts") / 4) * 4).cast("string"), 2, "0")
    seen = table(spark, sf, "events").select(F.col("user_id").alias("item"), F.concat("event_type", F.lit("@"), hour).alias("artifact"))
    return audit.completeness(seen, ARTIFACTS).withColumn("missing", F.array_join("missing", ","))
