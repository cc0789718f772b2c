"""Favourites, profiles, evidence and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.operators import claims, profile, ranks, similarity
from cuesheet.plans.registry import query
from cuesheet.plans.roles import FEAT, feature_table, with_clause
from cuesheet.plans.stats_queries import R6, r6
from cuesheet.session import materialise

# role columns under the feature names the rules know
NAMES = {
    "n_lines": "scene_avg_saturation", "qty_avg": "scene_cuts_per_minute", "price_avg": "scene_median_shot_len_s",
    "price_min": "scene_avg_brightness", "disc_avg": "audio_onsets_per_sec", "like_rate": "audio_peak_energy_ratio",
    "duration_s": "tag_closeup_ratio", "title_len": "tag_wide_ratio", "price_max": "hook_cuts_first_15s",
}
FEATURES = list(NAMES.values())
CATS = ["mood", "flag_first", "domain"]
FX = FEAT + ", fx AS (SELECT item, mood, flag_first, domain, " + ", ".join(f"{k} AS {v}" for k, v in NAMES.items()) + " FROM feat)"
FXLONG = "long AS (" + " UNION ALL ".join(f"SELECT item, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM fx WHERE {f} IS NOT NULL" for f in FEATURES) + ")"
FAV = "item % 3001 = 5"
TARGET = "item % 97 = 11"


def renamed(spark, sf):
    return feature_table(spark, sf, "item", *CATS, *NAMES).withColumnsRenamed(NAMES)


def favourites(df):
    return df.where(F.expr(FAV))


@query(
    "list_compare",
    with_clause(FX, FXLONG)
    + f"""SELECT feature, count(*) AS n, {R6('quantile_cont(value, 0.5)')} AS median, {R6('min(value)')} AS min, {R6('max(value)')} AS max,
            {R6('(max(value) - min(value)) / abs(quantile_cont(value, 0.5))')} AS spread_ratio
          FROM long WHERE {FAV} GROUP BY feature HAVING count(*) >= 2""",
    "C1 A20",
)
def list_compare(spark, sf):
    return r6(profile.compare_list(favourites(renamed(spark, sf)), FEATURES, ["item"]), "median", "min", "max", "spread_ratio")


PROFILE_SQL = f"""pc AS (SELECT item, feature, value, floor(100.0 * ((rank() OVER (PARTITION BY feature ORDER BY value) - 1)
    + 0.5 * count(*) OVER (PARTITION BY feature, value)) / count(*) OVER (PARTITION BY feature) * 10.0 + 0.5) AS p10 FROM long),
pf AS (SELECT feature, count(*) AS n, quantile_cont(value, 0.5) AS median, quantile_cont(p10, 0.5) AS mid, min(p10) AS lo, max(p10) AS hi,
    (max(value) - min(value)) / abs(quantile_cont(value, 0.5)) AS spread_ratio FROM pc WHERE {FAV} GROUP BY feature),
prof AS (SELECT feature, n, {R6('median')} AS median, floor(mid / 10.0 * 10.0 + 0.5) / 10.0 AS median_pct, lo / 10.0 AS min_pct, hi / 10.0 AS max_pct, {R6('spread_ratio')} AS spread_ratio,
    CASE WHEN lo >= 700 THEN 'distinct-high' WHEN hi <= 300 THEN 'distinct-low'
         WHEN spread_ratio <= 0.35 THEN CASE WHEN mid > 300 AND mid < 700 THEN 'convention' ELSE 'shared' END ELSE 'irrelevant' END AS verdict FROM pf)"""


@query("list_profile", with_clause(FX, FXLONG, PROFILE_SQL) + "SELECT * FROM prof", "C2 J17")
def list_profile(spark, sf):
    df = renamed(spark, sf)
    return r6(profile.profile_numeric(df, favourites(df), FEATURES, "item"), "median", "spread_ratio")


CATPROF_SQL = "cl AS (" + " UNION ALL ".join(f"SELECT item, '{c}' AS feature, {c} AS value FROM fx WHERE {c} IS NOT NULL" for c in CATS) + f"""),
ct AS (SELECT feature, value AS top, CAST(c AS DOUBLE) / n AS share, n FROM (SELECT feature, value, count(*) AS c, CAST(sum(count(*)) OVER (PARTITION BY feature) AS BIGINT) AS n,
    row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM cl WHERE {FAV} GROUP BY feature, value) WHERE r = 1),
cs AS (SELECT feature, CAST(count(*) FILTER (value = top) AS DOUBLE) / count(*) AS corpus_share FROM cl JOIN ct USING (feature) GROUP BY feature),
cprof AS (SELECT feature, top, n, share, corpus_share, CASE WHEN share >= 0.8 AND corpus_share < 0.5 THEN 'signal' WHEN corpus_share >= 0.5 THEN 'convention' ELSE 'mixed' END AS verdict FROM ct JOIN cs USING (feature))"""


@query("list_profile_categorical", with_clause(FX, CATPROF_SQL) + "SELECT * FROM cprof", "C3")
def list_profile_categorical(spark, sf):
    df = renamed(spark, sf)
    return profile.profile_categorical(df, favourites(df), CATS, "item")


# ------------------------------------------------------------- claims

EV_SQL = f"""pe AS (SELECT item, feature, value, floor(100.0 * ((rank() OVER (PARTITION BY feature ORDER BY value) - 1)
    + 0.5 * count(*) OVER (PARTITION BY feature, value)) / count(*) OVER (PARTITION BY feature) * 10.0 + 0.5) / 10.0 AS percentile,
    (value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature) AS z FROM long),
evid AS (SELECT item, feature, value, percentile, {R6('z')} AS z FROM pe WHERE {TARGET})"""
DIST = "abs(z) >= 0.75 OR percentile >= 80 OR percentile <= 20"
DIST_SQL = f"""dc AS (SELECT item, feature, z, percentile, CASE WHEN z > 0 OR percentile > 50 THEN 'high' ELSE 'low' END AS direction,
    CASE WHEN abs(z) >= 1.0 OR percentile >= 90 OR percentile <= 10 THEN 'high' ELSE 'medium' END AS confidence,
    greatest(abs(z), abs(percentile - 50.0) / 25.0) AS strength,
    CASE WHEN feature IN ('scene_avg_saturation', 'scene_avg_brightness') THEN 'visual' WHEN feature LIKE 'scene\\_%' ESCAPE '\\' THEN 'editing'
         WHEN feature LIKE 'hook\\_%' ESCAPE '\\' THEN 'hook' WHEN feature LIKE 'audio\\_%' ESCAPE '\\' THEN 'audio' WHEN feature LIKE 'tag\\_%' ESCAPE '\\' THEN 'visual' ELSE 'metadata' END AS subject
    FROM evid WHERE {DIST}),
dr AS (SELECT *, 'distinctive:' || feature || ':' || direction AS id, row_number() OVER (PARTITION BY item ORDER BY strength DESC, 'distinctive:' || feature || ':' || direction) AS rank FROM dc)"""


def evidence_rows(df):
    ev = similarity.evidence(df.select("item", *FEATURES), df.where(F.expr(TARGET)), FEATURES)
    return ev.withColumn("z", rnd("z", 6))


@query(
    "claims_distinctive",
    with_clause(FX, FXLONG, EV_SQL, DIST_SQL)
    + "SELECT item, id, subject, direction, confidence, 'reason.feature.' || direction AS text_key, rank FROM dr",
    "C6 P8",
)
def claims_distinctive(spark, sf):
    c = claims.ordered_claims(claims.distinctive(evidence_rows(renamed(spark, sf))))
    return c.select("item", "id", "subject", "direction", "confidence", "text_key", "rank")


def composed_sql() -> str:
    rows = []
    for cid, subject, key, conf, ((f1, m1, o1, l1), (f2, m2, o2, l2)) in claims.COMPOSED:
        rows.append(
            f"SELECT a.item, '{cid}' AS id, '{subject}' AS subject, '{key}' AS text_key, '{conf}' AS confidence FROM evid a JOIN evid b "
            f"ON a.item = b.item AND a.feature = '{f1}' AND b.feature = '{f2}' AND a.{m1} {o1} {l1} AND b.{m2} {o2} {l2}"
        )
    return "co AS (" + " UNION ALL ".join(rows) + ")"


@query("claims_composed", with_clause(FX, FXLONG, EV_SQL, composed_sql()) + "SELECT * FROM co", "C7")
def claims_composed(spark, sf):
    return claims.composed(evidence_rows(renamed(spark, sf))).select("item", "id", "subject", "text_key", "confidence")


TASTE_SQL = f"""nf AS (SELECT count(*) AS n FROM fx WHERE {FAV}),
tn AS (SELECT e.item, 'taste:' || feature || ':' || k AS id, feature, k, n, CASE WHEN k = 'not-supported' THEN 'mixed' WHEN k = 'conventional' THEN 'match'
      WHEN verdict = 'distinct-high' THEN 'high' WHEN verdict = 'distinct-low' THEN 'low' ELSE 'match' END AS direction
   FROM (SELECT e.*, p.verdict, CASE WHEN verdict = 'irrelevant' AND ({DIST}) THEN 'not-supported' WHEN verdict = 'convention' THEN 'conventional'
        WHEN verdict = 'distinct-high' AND percentile >= 70 THEN 'signal' WHEN verdict = 'distinct-low' AND percentile <= 30 THEN 'signal' WHEN verdict = 'shared' THEN 'signal' END AS k
        FROM evid e JOIN prof p USING (feature)) e, nf WHERE k IS NOT NULL),
tc AS (SELECT item, 'taste:' || feature || ':' || k AS id, feature, k, n, 'match' AS direction FROM (
   SELECT c.item, c.feature, CASE verdict WHEN 'signal' THEN 'signal' WHEN 'convention' THEN 'conventional' END AS k FROM cl c JOIN cprof p ON c.feature = p.feature AND c.value = p.top WHERE {TARGET}), nf WHERE k IS NOT NULL),
ta AS (SELECT item, id, direction, CASE WHEN k = 'not-supported' THEN 'contradicted' WHEN k = 'conventional' THEN 'insufficient' WHEN n >= 4 THEN 'supported' ELSE 'insufficient' END AS support,
   CASE WHEN n >= 6 THEN 'medium' ELSE 'low' END AS confidence,
   CASE WHEN k = 'not-supported' THEN 'reason.taste.not_supported' WHEN k = 'conventional' THEN 'reason.taste.conventional' WHEN n >= 4 THEN 'reason.taste.signal' ELSE 'reason.taste.insufficient' END AS text_key
   FROM (SELECT * FROM tn UNION ALL SELECT * FROM tc))"""


def taste_rows(spark, sf):
    df = renamed(spark, sf)
    fav = favourites(df)
    n = fav.count()
    numeric = claims.taste(evidence_rows(df), profile.profile_numeric(df, fav, FEATURES, "item"), n)
    cats = ranks.melt(df.where(F.expr(TARGET)), ["item"], CATS, "string")
    return numeric.unionByName(claims.taste_categorical(cats, profile.profile_categorical(df, fav, CATS, "item"), n))


@query("claims_taste", with_clause(FX, FXLONG, PROFILE_SQL, CATPROF_SQL, EV_SQL, TASTE_SQL) + "SELECT * FROM ta", "C8 J18")
def claims_taste(spark, sf):
    return taste_rows(spark, sf).select("item", "id", "direction", "support", "confidence", "text_key")


def _sql_text(key_col: str, lang: int) -> str:
    whens = " ".join("WHEN '{}' THEN '{}'".format(t[0], t[lang].replace("'", "''")) for t in claims.TEXTS)
    return f"CASE {key_col} {whens} END"


@query(
    "claim_text",
    with_clause(FX, FXLONG, EV_SQL, DIST_SQL, composed_sql())
    + f""", al AS (SELECT item, id, 'distinctive' AS question, strength, 'reason.feature.' || direction AS text_key, feature, percentile FROM dr
            UNION ALL SELECT item, id, 'feel', CASE id {' '.join(f"WHEN '{c[0]}' THEN -{i}.0" for i, c in enumerate(claims.COMPOSED))} END, text_key, NULL, NULL FROM co),
          rk AS (SELECT *, row_number() OVER (PARTITION BY item, question ORDER BY strength DESC, id) AS rank FROM al),
          ln AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY CASE question WHEN 'feel' THEN 0 ELSE 1 END, rank) AS line FROM rk WHERE rank <= 4)
          SELECT item, line, id, replace(replace({_sql_text('text_key', 1)}, '%1$s', coalesce(feature, '')), '%2$s', coalesce(printf('%.1f', percentile), '')) AS text_en,
            replace(replace({_sql_text('text_key', 2)}, '%1$s', coalesce(feature, '')), '%2$s', coalesce(printf('%.1f', percentile), '')) AS text_ko
          FROM ln WHERE line <= 4""",
    "C9 C10",
)
def claim_text(spark, sf):
    ev = evidence_rows(renamed(spark, sf))
    both = claims.distinctive(ev).unionByName(claims.composed(ev))
    lines = claims.summary_lines(both)
    pct = F.format_string("%.1f", F.col("evidence")[0]["percentile"])
    return claims.render(lines, F.col("feature"), pct).select("item", "line", "id", "text_en", "text_ko")


@query(
    "claim_audit",
    with_clause(FX, FXLONG, EV_SQL, DIST_SQL)
    + """, base AS (SELECT item, id, CASE WHEN item % 2 = 0 AND rank = 1 THEN 'success_prediction' ELSE 'descriptive_difference' END AS claim_type, rank,
                 CASE WHEN rank = 3 THEN 0 ELSE 1 END AS n_ev FROM dr),
         claims AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE rank = 2)
         SELECT item, id, 'duplicate claim id' AS rule FROM claims GROUP BY item, id HAVING count(*) > 1
         UNION ALL SELECT item, id || '!', 'unknown summary id' FROM base WHERE rank = 1
         UNION ALL SELECT item, id, 'banned claim type' FROM claims WHERE claim_type = 'success_prediction'
         UNION ALL SELECT item, id, 'claim without evidence' FROM claims WHERE n_ev = 0""",
    "X8",
)
def claim_audit(spark, sf):
    """Claims with planted faults: a banned type, a missing evidence, a duplicate, an unknown id."""
    # read by every rule: made once, the claims of the targets only
    c = materialise(claims.ordered_claims(claims.distinctive(evidence_rows(renamed(spark, sf)))))
    bad_type = (F.col("item") % 2 == 0) & (F.col("rank") == 1)
    c = c.withColumns({
        "claim_type": F.when(bad_type, "success_prediction").otherwise(F.col("claim_type")),
        "evidence": F.when(F.col("rank") != 3, F.col("evidence")),
    })
    c = c.unionByName(c.where(F.col("rank") == 2))
    ids = c.where(F.col("rank") == 1).select("item", F.concat("id", F.lit("!")).alias("id")).distinct()
    return claims.audit_claims(c, ids)


@query(
    "evidence_audit",
    with_clause(FX, FXLONG, EV_SQL)
    + "SELECT item, feature, 'inconsistent z' AS rule FROM evid WHERE item % 5 = 0 UNION ALL SELECT item, feature, 'percentile out of range' FROM evid WHERE item % 7 = 0",
    "X7",
)
def evidence_audit(spark, sf):
    df = renamed(spark, sf)
    ev = similarity.evidence(df.select("item", *FEATURES), df.where(F.expr(TARGET)), FEATURES)
    ev = ev.withColumn("z", F.when(F.col("item") % 5 == 0, F.col("z") + 0.01).otherwise(F.col("z")))
    ev = ev.withColumn("percentile", F.when(F.col("item") % 7 == 0, 101.0).otherwise(F.col("percentile")))
    return claims.audit_evidence(ev, df.count())
