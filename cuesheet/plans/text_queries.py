"""Line cleaning, repetition, phrases, scrubbing, scans and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.functions.numbers import rnd
from cuesheet.operators import scrub, search, textindex
from cuesheet.operators.ordered import scan
from cuesheet.plans.registry import query
from cuesheet.plans.roles import POP, TAGS, documents, intervals, population, table, tags, with_clause
from cuesheet.session import shared_folder

Q = "[^\\p{L}\\p{N}]+"
SQUASH = lambda x: f"lower(regexp_replace({x}, '{Q}', '', 'g'))"
LATIN_SHARE = "CAST(length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS DOUBLE) / greatest(length(line), 1)"

CLEAN_SQL = f"""raw AS (SELECT doc_id, lang, source, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS pos, trim(unnest(parts), ' ' || chr(9) || chr(160)) AS line
   FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS parts FROM documents)),
kept AS (SELECT * FROM raw WHERE length(line) >= 2 AND {LATIN_SHARE} >= 0.3),
clean AS (SELECT doc_id, lang, source, pos, pos * 4 AS t_s, line FROM (
   SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM kept) WHERE prev IS NULL OR prev <> line)"""


def cleaned(spark, sf):
    """Documents with their clean lines as an array: every text operator stays inside the row."""
    return documents(spark, sf).select(
        "doc_id", "lang", "source", "text", tx.pin(tx.clean_lines("text", latin=True)).alias("lines")
    )


@query("line_clean", with_clause(CLEAN_SQL) + "SELECT doc_id, pos, t_s, line FROM clean", "F1 F2 F3 W2")
def line_clean(spark, sf):
    return cleaned(spark, sf).select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*")


@query(
    "line_repeat_first",
    with_clause(CLEAN_SQL)
    + f""", k AS (SELECT doc_id, pos, t_s, {SQUASH('line')} AS key FROM clean),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM k WHERE length(key) >= 5)
          SELECT doc_id, min(t_s) AS first_repeat_s FROM r WHERE n = 2 GROUP BY doc_id""",
    "W3 F1",
)
def line_repeat_first(spark, sf):
    first = tx.repeat_of(F.col("lines"))["t_s"]
    return cleaned(spark, sf).select("doc_id", tx.pin(first).alias("first_repeat_s")).where(F.col("first_repeat_s").isNotNull())


@query(
    "line_repetition_native",
    with_clause(CLEAN_SQL)
    + f"""SELECT doc_id, count(*) AS n_lines, floor(CAST(count(DISTINCT {SQUASH('line')}) AS DOUBLE) / count(*) * 10000.0 + 0.5) / 10000.0 AS distinct_share
          FROM clean GROUP BY doc_id HAVING count(*) >= 8""",
    "F9",
)
def line_repetition_native(spark, sf):
    keys = F.transform("lines", lambda x: tx.squash(x["line"]))
    d = cleaned(spark, sf).where(F.size("lines") >= tx.MIN_LINES)
    return d.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"),
        rnd(F.size(F.array_distinct(keys)) / F.size("lines"), 4).alias("distinct_share"),
    )


@query("line_repetition_zlib", None, "F9")
def line_repetition_zlib(spark, sf):
    d = cleaned(spark, sf).where(F.size("lines") >= tx.MIN_LINES)
    joined = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    # the generator pins the text as a column: nested lambdas cannot be an argument of a Python function
    return d.select("doc_id", tx.pin(joined).alias("text")).select(
        "doc_id", tx.deflate_ratio("text").alias("compression_ratio")
    )


TITLE_SQL = f"""ti AS (SELECT doc_id, source AS channel, '[' || lang || '] ' || array_to_string(string_split(replace(text, chr(10), ' '), ' ')[1:2], ' ') || ' - ' || source || ' MV' AS title FROM documents),
bare AS (SELECT *, regexp_split_to_array(regexp_replace(regexp_replace(title, '[\\(\\[【「『《〈].*?[\\)\\]】」』》〉]', ' ', 'g'),
    '(?i)(official\\s*)?(music\\s*video|m/?v)|feat\\.?\\s*\\S*|prod\\.?\\s*\\S*', ' ', 'g'), '[/|\\-–—:·]+') AS parts0, {SQUASH('channel')} AS ch FROM ti),
pa AS (SELECT *, [{SQUASH('p')} for p in parts0 if {SQUASH('p')} <> ''] AS parts FROM bare),
ow AS (SELECT *, [p for p in parts if ch <> '' AND NOT contains(ch, p) AND NOT contains(p, ch)] AS own FROM pa),
lo AS (SELECT *, [p for p in own if length(p) = list_max([length(x) for x in own])][1] AS best_own,
   [p for p in parts if length(p) = list_max([length(x) for x in parts])][1] AS best_all FROM ow),
phrase AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN '' WHEN len(own) > 0 THEN best_own
   WHEN length(replace(best_all, ch, '')) >= 2 THEN replace(best_all, ch, '') ELSE '' END AS phrase FROM lo),
hits AS (SELECT p.doc_id, p.phrase, min(t_s) FILTER (length(phrase) >= 2 AND contains({SQUASH('line')}, phrase)) AS first_s,
   count(*) FILTER (length(phrase) >= 2 AND contains({SQUASH('line')}, phrase)) AS n, count(line) AS n_lines
   FROM phrase p LEFT JOIN clean c USING (doc_id) GROUP BY ALL)"""


def titled(spark, sf):
    head = F.concat_ws(" ", F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), 1, 2))
    title = F.concat(F.lit("["), "lang", F.lit("] "), head, F.lit(" - "), "source", F.lit(" MV"))
    return cleaned(spark, sf).select("*", tx.pin(tx.title_phrase(title, F.col("source"))).alias("phrase"))


@query("phrase_hits", with_clause(CLEAN_SQL, TITLE_SQL) + "SELECT doc_id, phrase, first_s, n FROM hits", "F7 F8")
def phrase_hits(spark, sf):
    d = titled(spark, sf).select("doc_id", "phrase", tx.pin(tx.phrase_hits(F.col("lines"), F.col("phrase"))).alias("h"))
    return d.select("doc_id", "phrase", F.col("h.first_s").alias("first_s"), F.col("h.count").alias("n"))


@query(
    "line_structure",
    with_clause(CLEAN_SQL, TITLE_SQL)
    + f""", k AS (SELECT doc_id, pos, t_s, {SQUASH('line')} AS key FROM clean),
          r AS (SELECT doc_id, min(t_s) AS first_repeat_s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS n FROM k WHERE length(key) >= 5) WHERE n = 2 GROUP BY doc_id)
          SELECT doc_id, n_lines, phrase, first_s AS title_first_s, n AS title_count, first_repeat_s FROM hits LEFT JOIN r USING (doc_id) WHERE n_lines >= 8""",
    "F10",
)
def line_structure(spark, sf):
    d = titled(spark, sf).where(F.size("lines") >= tx.MIN_LINES)
    d = d.select("doc_id", "lines", "phrase", tx.pin(tx.phrase_hits(F.col("lines"), F.col("phrase"))).alias("h"))
    return d.select(
        "doc_id", F.size("lines").cast("bigint").alias("n_lines"), "phrase", F.col("h.first_s").alias("title_first_s"),
        F.col("h.count").alias("title_count"), tx.repeat_of(F.col("lines"))["t_s"].alias("first_repeat_s"),
    )


@query(
    "transcript_lines",
    with_clause(f"""seg AS (SELECT conv_id, turn, CAST(floor(turn * 7.5) AS BIGINT) AS t_s, trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS line FROM conversations),
      kept AS (SELECT * FROM seg WHERE length(line) >= 2 AND {LATIN_SHARE} >= 0.3)""")
    + """SELECT conv_id, turn, t_s, line FROM (SELECT *, lag(line) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM kept) WHERE prev IS NULL OR prev <> line""",
    "F4 W2",
)
def transcript_lines(spark, sf):
    seg = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.floor(F.col("turn") * 7.5).alias("t_s"), tx.strip("text").alias("line")
    )
    kept = seg.where((F.length("line") >= tx.MIN_LINE_CHARS) & (tx.script_share("line", "ja", latin=True) >= tx.MIN_SHARE))
    s = scan(kept, ["conv_id"], ["turn"], before={"_prev": F.col("line")})
    return s.where(F.col("_prev").isNull() | (F.col("_prev") != F.col("line"))).drop("_prev")


# ------------------------------------------------------------- scrubbing

TEXT_SQL = """dt AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', '. With fan-subs burned in, ') WHEN 1 THEN replace(text, ', ', ', black bars left; hand-lettered Korean words, ') ELSE text END AS text FROM documents)"""
SUB = r"\b(sub-?titles?|hardsubs?|fan-?subs?|caption\s*(band|bar|strip)|subs)\b"
BURN = r"\b(lyrics?|karaoke|caption)\b.{0,24}\b(text|line|typography|overlay|type)\b|\b(text|typography|lettering|type)\b.{0,24}\b(overlay|burn(ed|t)-?in|on-?screen)\b"
PILLAR = r"\b(pillar-?box\w*|letter-?box\w*|black bars?)\b"
MARK = r"\bwatermark\b|\bchannel (logo|handle|name|tag)\b|(^|[^\p{L}\p{N}_])@[A-Za-z0-9_]{2,}"
CLAUSE_SQL = f"""ca AS (SELECT doc_id, text, regexp_extract_all(text, '[^.;,]*[.;,]|[^.;,]+$') AS cs FROM dt),
cl AS (SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS BIGINT) AS pos, unnest(cs) AS clause FROM (SELECT doc_id, [c for c in cs if trim(c, ' ' || chr(10) || chr(9)) <> ''] AS cs FROM ca)),
ru AS (SELECT *, CASE WHEN regexp_matches(clause, '(?i){SUB}') THEN 'subtitle' WHEN regexp_matches(clause, '(?i){BURN}') THEN 'burned_text'
   WHEN regexp_matches(clause, '(?i){PILLAR}') THEN 'pillarbox' WHEN regexp_matches(clause, '(?i){MARK}') THEN 'watermark' END AS rule FROM cl),
jo AS (SELECT doc_id, string_agg(clause, '' ORDER BY pos) FILTER (rule IS NULL) AS kept, count(rule) AS n_removed FROM ru GROUP BY doc_id),
td AS (SELECT doc_id, n_removed, regexp_replace(regexp_replace(regexp_replace(trim(coalesce(kept, ''), ' ' || chr(10) || chr(9)), '\\s{{2,}}', ' ', 'g'), '^[\\s,;.]+', ''), '[\\s,;]+$', '') AS s FROM jo),
sc AS (SELECT doc_id, n_removed, CASE WHEN s <> '' AND NOT regexp_matches(s, '[.!?]$') THEN s || '.' ELSE s END AS s FROM td),
scr AS (SELECT d.doc_id, CASE WHEN n_removed > 0 AND length(s) >= 8 THEN s ELSE d.text END AS scrubbed, coalesce(n_removed, 0) AS n_removed, coalesce(n_removed > 0 AND length(s) >= 8, false) AS applied
   FROM dt d LEFT JOIN sc USING (doc_id))"""


def decorated(spark, sf):
    return documents(spark, sf).select(
        "doc_id",
        F.expr(
            """CASE pmod(doc_id, 3) WHEN 0 THEN replace(text, '. ', '. With fan-subs burned in, ')
               WHEN 1 THEN replace(text, ', ', ', black bars left; hand-lettered Korean words, ') ELSE text END"""
        ).alias("text"),
    )


@query("clause_scrub", with_clause(TEXT_SQL, CLAUSE_SQL) + "SELECT doc_id, md5(scrubbed) AS digest, length(scrubbed) AS chars, n_removed, applied FROM scr", "F14")
def clause_scrub(spark, sf):
    s = scrub.scrub(decorated(spark, sf), "text")
    return s.select(
        "doc_id", F.md5("scrubbed").alias("digest"), F.length("scrubbed").cast("bigint").alias("chars"),
        F.size("removed").cast("bigint").alias("n_removed"), "applied",
    )


@query(
    "clause_audit",
    with_clause(TEXT_SQL, CLAUSE_SQL)
    + "SELECT rule, applied, count(*) AS n_clauses, count(DISTINCT doc_id) AS n_docs FROM ru JOIN scr USING (doc_id) WHERE rule IS NOT NULL GROUP BY ALL",
    "F14",
)
def clause_audit(spark, sf):
    rows = scrub.audit_rows(scrub.scrub(decorated(spark, sf), "text"), ["doc_id"])
    return rows.groupBy("rule", "applied").agg(F.count("*").alias("n_clauses"), F.count_distinct("doc_id").alias("n_docs"))


def _rewrite_sql() -> str:
    steps, prev = [], "dt"
    for i, (pat, rep) in enumerate(scrub.REWRITES):
        n0 = "0" if i == 0 else "n"
        steps.append(
            f"w{i} AS (SELECT doc_id, {n0} + len(regexp_extract_all(text, '(?i){pat}')) AS n, "
            f"regexp_replace(text, '{pat}', '{rep.replace('$1', chr(92) + '1')}', 'gi') AS text FROM {prev})"
        )
        prev = f"w{i}"
    return ", ".join(steps)


@query(
    "phrase_rewrite",
    with_clause(TEXT_SQL, _rewrite_sql()) + f"SELECT doc_id, n AS n_rewrites, md5(text) AS digest FROM w{len(scrub.REWRITES) - 1}",
    "F15",
)
def phrase_rewrite(spark, sf):
    new, n = scrub.rewrite(F.col("text"))
    return decorated(spark, sf).select("doc_id", n.alias("n_rewrites"), F.md5(new).alias("digest"))


@query(
    "text_dependent",
    with_clause(TEXT_SQL, CLAUSE_SQL)
    + f"SELECT doc_id, count(*) AS n_clauses FROM cl WHERE regexp_matches(clause, '(?i){scrub.TEXT_DEPENDENT}') GROUP BY doc_id",
    "F16",
)
def text_dependent(spark, sf):
    n = F.size(scrub.text_dependent_clauses(F.col("text"))).cast("bigint")
    return decorated(spark, sf).select("doc_id", n.alias("n_clauses")).where(F.col("n_clauses") > 0)


# ------------------------------------------------------------- scans

def _private_sql(addr: str) -> str:
    return " OR ".join(f"{addr} BETWEEN {lo} AND {hi}" for lo, hi in map(scrub._bounds, scrub.PRIVATE_BLOCKS))


UNSAFE_SQL = f"""tt AS (SELECT 'documents' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages
   UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text || CASE conv_id % 9 WHEN 0 THEN ' see http://10.1.2.3/x' WHEN 1 THEN ' C:' || chr(92) || 'data' || chr(92) || 'x' WHEN 2 THEN ' file:///x'
      WHEN 3 THEN ' https://cdn.test/v?expire=1&sig=2' WHEN 4 THEN ' http://localhost:80/' WHEN 5 THEN ' 172.32.0.1 or 300.10.1.1' WHEN 6 THEN ' under /home/someone' WHEN 7 THEN ' at 192.168.7.7,' ELSE '' END FROM conversations),
ips AS (SELECT src, id, unnest(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)*')) AS run FROM tt),
oc AS (SELECT src, id, string_split(run, '.') AS o FROM ips),
ip4 AS (SELECT src, id, CAST(o[1] AS BIGINT) * 16777216 + CAST(o[2] AS BIGINT) * 65536 + CAST(o[3] AS BIGINT) * 256 + CAST(o[4] AS BIGINT) AS v FROM oc
   WHERE len(o) >= 4 AND len([x for x in o[1:4] if length(x) > 3 OR (length(x) > 1 AND x[1] = '0')]) = 0
     AND list_max([CAST(x AS BIGINT) for x in o[1:4]]) <= 255),
pv AS (SELECT DISTINCT src, id FROM ip4 WHERE {_private_sql('v')}),
un AS (SELECT src, id, 'local path' AS reason FROM tt WHERE regexp_matches(text, '(?i)\\b[A-Za-z]:[\\\\/]|\\\\\\\\|(?:^|\\s)/(?:home|Users|tmp|var|mnt|etc|root|private|opt)/') OR contains(lower(text), 'file://')
   UNION ALL SELECT src, id, 'private host' FROM tt WHERE contains(lower(text), 'localhost') OR EXISTS (SELECT 1 FROM pv WHERE pv.src = tt.src AND pv.id = tt.id)
   UNION ALL SELECT src, id, 'signed media url' FROM tt WHERE contains(lower(text), 'googlevideo.com') OR (contains(lower(text), 'expire=') AND (contains(lower(text), 'sig=') OR contains(lower(text), 'signature='))))"""


def all_texts(spark, sf):
    d = documents(spark, sf).select(F.lit("documents").alias("src"), F.col("doc_id").alias("id"), "text")
    p = table(spark, sf, "pages").select(F.lit("pages").alias("src"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    c = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("src"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.concat("text", F.expr(
            r"""CASE pmod(conv_id, 9) WHEN 0 THEN ' see http://10.1.2.3/x' WHEN 1 THEN concat(' C:', chr(92), 'data', chr(92), 'x') WHEN 2 THEN ' file:///x'
                WHEN 3 THEN ' https://cdn.test/v?expire=1&sig=2' WHEN 4 THEN ' http://localhost:80/' WHEN 5 THEN ' 172.32.0.1 or 300.10.1.1'
                WHEN 6 THEN ' under /home/someone' WHEN 7 THEN ' at 192.168.7.7,' ELSE '' END"""
        )).alias("text"),
    )
    return d.unionByName(p).unionByName(c)


@query("unsafe_scan", with_clause(UNSAFE_SQL) + "SELECT * FROM un", "X4")
def unsafe_scan(spark, sf):
    return all_texts(spark, sf).select("src", "id", F.explode(scrub.unsafe_reasons(F.col("text"))).alias("reason"))


ROLE_SECRETS = scrub.SECRET_RULES + (("assigned_token", r'\btoken = "[0-9a-f]{40}"'),)


@query(
    "secret_scan",
    with_clause(UNSAFE_SQL.split(",\nips AS")[0])
    + " UNION ALL ".join(
        f"SELECT src, id, '{n}' AS rule, len(regexp_extract_all(text, '{p}')) AS hits FROM tt WHERE regexp_matches(text, '{p}')"
        for n, p in ROLE_SECRETS
    ),
    "X5",
)
def secret_scan(spark, sf):
    return scrub.secret_findings(all_texts(spark, sf), "text", ["src", "id"], ROLE_SECRETS)


# ------------------------------------------------------------- search

SEARCH_SQL = """fe AS (SELECT item, title, channel_name AS channel FROM pop),
h AS (SELECT item, CAST(NULL AS DOUBLE) AS t_s, 'title' AS "where", CAST(NULL AS BIGINT) AS pos, title || ' ' || channel AS text FROM fe
   UNION ALL SELECT doc_id, CAST(t_s AS DOUBLE), 'lyric', pos, line FROM clean
   UNION ALL SELECT t.item, s.start_s, 'scene', t.pos, concat_ws(' ', setting, mood, style, shot_type) FROM tags t LEFT JOIN scenes s ON s.item = t.item AND s.pos = t.pos)"""


@query(
    "corpus_search",
    with_clause(POP, CLEAN_SQL.replace("kept AS", "kept0 AS").replace("FROM kept)", "FROM kept0)"), TAGS, SEARCH_SQL)
    + """SELECT h.item, fe.title, h.t_s, h."where", h.pos, h.text FROM (SELECT * FROM h WHERE text ILIKE '%live%'
           ORDER BY item, t_s NULLS FIRST, "where", pos NULLS FIRST LIMIT 3000) h LEFT JOIN fe ON fe.item = h.item""",
    "C11 F12 U1 K6 J5 S10",
)
def corpus_search(spark, sf):
    feats = population(spark, sf).select("item", "title", F.col("channel_name").alias("channel"))
    lines = line_clean(spark, sf).withColumnRenamed("doc_id", "item")
    t = tags(spark, sf).select("item", "pos", F.concat_ws(" ", "setting", "mood", "style", "shot_type").alias("blob"))
    starts = intervals(spark, sf).select("item", "pos", F.col("start_s").alias("t_s"))
    return search.corpus_search(feats, lines, t.join(starts, ["item", "pos"], "left"), "live", 3000)


NEEDLES_SQL = "needles AS (SELECT doc_id AS needle_id, substr(text, 11, CASE WHEN doc_id % 100 = 0 THEN 2 ELSE 9 END) AS needle FROM documents WHERE doc_id % 20 = 0)"


@query(
    "indexed_search",
    with_clause(NEEDLES_SQL) + """SELECT n.needle_id, d.doc_id AS item FROM needles n JOIN documents d ON contains(lower(d.text), lower(n.needle))""",
    "C11 F12 S10",
)
def indexed_search(spark, sf):
    """Pieces of every twentieth document, nine letters of it or two, looked for in all documents through the trigram index."""
    d = documents(spark, sf)
    path = f"{shared_folder(spark).rstrip('/')}/cuesheet/index-{uuid.uuid4().hex}"
    textindex.build(d, path, "doc_id", "text")
    width = F.when(F.col("doc_id") % 100 == 0, 2).otherwise(9)
    needles = d.where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("needle_id"), F.substring(F.col("text"), F.lit(11), width).alias("needle"))
    return textindex.search(path, d, needles, "doc_id", "text")
