"""Rank statistics, agreement and the reports on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.operators import agreement, ranks, reports, sampling, tables
from cuesheet.plans.matching_queries import CHANNEL_SQL, channel_pairs
from cuesheet.plans.registry import query
from cuesheet.plans.roles import (
    BINARY, CATEGORICAL, EV, FEAT, NUMERIC, POP, feature_table, features, numeric_long_sql, population, table, timed_events, with_clause,
)
from cuesheet.plans.sampling_queries import EXTREMES, fit
from cuesheet.session import materialise


def r6(df, *cols):
    return df.withColumns({c: rnd(c, 6) for c in cols})


def R6(x: str) -> str:
    return f"floor(({x}) * 1000000.0 + 0.5) / 1000000.0"


def erfc_sql(x: str) -> str:
    """1 − erf by its positive series; 0 beyond 6."""
    return (
        f"(CASE WHEN ({x}) > 6 THEN 0.0 ELSE 1.0 - 2.0 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum("
        f"[exp(2.0 * n * ln(2.0) + (2.0 * n + 1) * ln(greatest({x}, 1e-100)) + lgamma(n + 1.0) - lgamma(2.0 * n + 2.0))"
        " for n in range(0, 160)]) END)"
    )


def mw_sql(keys: str, first: str = "top", second: str = "bottom", min_n: int = 10) -> str:
    """Mann–Whitney block over ``long`` with p, q, medians and delta; keys end with a comma."""
    join = f"USING ({keys}feature)"
    return f"""
two AS (SELECT {keys}feature, "group", value FROM long WHERE "group" IN ('{first}', '{second}')),
rk AS (SELECT *, rank() OVER (PARTITION BY {keys}feature ORDER BY value)
             + (count(*) OVER (PARTITION BY {keys}feature, value) - 1) / 2.0 AS r FROM two),
ties AS (SELECT {keys}feature, sum(CAST(t AS DOUBLE) * t * t - t) AS tie_term FROM
         (SELECT {keys}feature, value, count(*) AS t FROM two GROUP BY ALL) GROUP BY ALL),
s0 AS (SELECT {keys}feature, count(*) FILTER ("group" = '{first}') AS n_top,
              count(*) FILTER ("group" = '{second}') AS n_bot,
              quantile_cont(value, 0.5) FILTER ("group" = '{first}') AS med_top,
              quantile_cont(value, 0.5) FILTER ("group" = '{second}') AS med_bot,
              sum(r) FILTER ("group" = '{first}') AS rsum FROM rk GROUP BY ALL),
s1 AS (SELECT *, rsum - n_top * (n_top + 1) / 2.0 AS u FROM s0 JOIN ties {join}
       WHERE n_top >= {min_n} AND n_bot >= {min_n}),
s2 AS (SELECT *, 2.0 * u / (CAST(n_top AS DOUBLE) * n_bot) - 1.0 AS delta,
              n_top * CAST(n_bot AS DOUBLE) / 12.0 * ((n_top + n_bot + 1) - tie_term / (CAST(n_top + n_bot AS DOUBLE) * (n_top + n_bot - 1))) AS v
       FROM s1),
s3 AS (SELECT *, (greatest(u, n_top * CAST(n_bot AS DOUBLE) - u) - n_top * CAST(n_bot AS DOUBLE) / 2.0 - 0.5) / sqrt(v) / sqrt(2.0) AS zz FROM s2),
s4 AS (SELECT *, CASE WHEN v <= 0 THEN 1.0 WHEN zz <= 0 THEN 1.0 ELSE {erfc_sql('zz')} END AS p FROM s3),
s5 AS (SELECT *, row_number() OVER (PARTITION BY {keys or "'x', "}1 ORDER BY p, feature) AS rnk,
              count(*) OVER (PARTITION BY {keys or "'x', "}1) AS m FROM s4),
cmp AS (SELECT *, least(1.0, min(p * m / rnk) OVER (PARTITION BY {keys or "'x', "}1 ORDER BY rnk DESC)) AS q FROM s5)"""


CMP_OUT = f"""feature, n_top, n_bot, {R6('med_top')} AS med_top, {R6('med_bot')} AS med_bot,
  u, {R6('delta')} AS delta, {R6('p')} AS p, {R6('q')} AS q,
  CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small'
       WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude"""


def cmp_out(df, *keys):
    df = df.select(*keys, "feature", "n_top", "n_bot", "med_top", "med_bot", "u", "delta", "p", "q", "magnitude")
    return r6(df, "med_top", "med_bot", "delta", "p", "q")


def long_features(spark, sf):
    return ranks.melt(feature_table(spark, sf, "domain", "group", *NUMERIC), ["domain", "group"], NUMERIC)


@query(
    "sample_group_compare",
    with_clause(EXTREMES, FEAT.replace(FEAT.split("feat AS")[0], ""))
    + """, long0 AS (SELECT feat.* EXCLUDE ("group"), ext."group" FROM feat JOIN ext USING (item)), """
    + numeric_long_sql().replace("FROM feat", "FROM long0") + "," + mw_sql("")
    + f" SELECT {CMP_OUT} FROM cmp",
    "P1 K1 T1 T2 T3 T4 A9 S7",
)
def sample_group_compare(spark, sf):
    """Population → extremes → features of the sample only → group comparison."""
    sample = sampling.extremes(fit(spark, sf), n=200, cap=2).select("item", "group")
    sample = materialise(sample)  # 400 rows, used three times
    feat = features(spark, sf, sample).drop("group").join(F.broadcast(sample), "item")
    feat = materialise(feat.select("group", *NUMERIC))
    return cmp_out(ranks.compare_groups(ranks.melt(feat, ["group"], NUMERIC)))


@query(
    "rank_group_compare",
    with_clause(FEAT, numeric_long_sql(), mw_sql("")) + f"SELECT {CMP_OUT} FROM cmp",
    "T1 T2 T3 T4 A9 W9",
)
def rank_group_compare(spark, sf):
    return cmp_out(ranks.compare_groups(long_features(spark, sf)))


def by_domain(spark, sf):
    return ranks.compare_groups(long_features(spark, sf), keys=["domain"])


@query(
    "domain_replication",
    with_clause(FEAT, numeric_long_sql(), mw_sql("domain, "))
    + f""", a AS (SELECT feature, {R6('delta')} AS delta_a, {R6('q')} AS q_a FROM cmp WHERE domain = 'BUILDING'),
          b AS (SELECT feature, {R6('delta')} AS delta_b, {R6('q')} AS q_b FROM cmp WHERE domain = 'MACHINERY')
          SELECT feature, delta_a, q_a, delta_b, q_b,
            CASE WHEN q_a < 0.05 AND q_b < 0.05 AND sign(delta_a) = sign(delta_b) THEN 'both'
                 WHEN q_a < 0.05 AND q_b >= 0.05 THEN 'first only'
                 WHEN q_b < 0.05 AND q_a >= 0.05 THEN 'second only' ELSE 'neither' END AS replicates
          FROM a FULL OUTER JOIN b USING (feature)""",
    "T18",
)
def domain_replication(spark, sf):
    return reports.replication(r6(by_domain(spark, sf), "delta", "q"), "BUILDING", "MACHINERY")


def binary_sql():
    parts = [f"SELECT '{c}' AS feature, \"group\", {c} AS yes FROM feat WHERE {c} IS NOT NULL" for c in BINARY]
    return f"""bl AS ({' UNION ALL '.join(parts)}),
b0 AS (SELECT feature, count(*) FILTER ("group" = 'top' AND yes) AS top, count(*) FILTER ("group" = 'top') AS n_top,
       count(*) FILTER ("group" = 'bottom' AND yes) AS bottom, count(*) FILTER ("group" = 'bottom') AS n_bottom
       FROM bl GROUP BY feature),
b1 AS (SELECT *, top AS a, n_top - top AS b, bottom AS c, n_bottom - bottom AS d FROM b0 WHERE n_top >= 10 AND n_bottom >= 10),
b2 AS (SELECT *, lgamma(a + b + 1.0) + lgamma(c + d + 1.0) + lgamma(a + c + 1.0) + lgamma(b + d + 1.0)
               - lgamma(a + b + c + d + 1.0) AS base FROM b1),
b3 AS (SELECT *, base - (lgamma(a + 1.0) + lgamma(b + 1.0) + lgamma(c + 1.0) + lgamma(d + 1.0)) AS obs,
       [base - (lgamma(k + 1.0) + lgamma(a + b - k + 1.0) + lgamma(a + c - k + 1.0) + lgamma(d - a + k + 1.0))
          for k in range(greatest(0, a - d), least(a + b, a + c) + 1)] AS lps FROM b2),
bin AS (SELECT feature, top, n_top, bottom, n_bottom,
        least(1.0, list_sum([CASE WHEN lp <= obs + 1e-7 THEN exp(lp) ELSE 0.0 END for lp in lps])) AS p FROM b3)"""


@query("binary_table", with_clause(FEAT, binary_sql()) + f"SELECT * REPLACE ({R6('p')} AS p) FROM bin", "A10 T11")
def binary_table(spark, sf):
    return r6(ranks.two_by_two(features(spark, sf), BINARY), "p")


def categorical_sql(k: int) -> str:
    parts = [f"SELECT '{c}' AS feature, \"group\", {c} AS value FROM feat WHERE {c} IS NOT NULL" for c in CATEGORICAL]
    return f"""cl AS ({' UNION ALL '.join(parts)}),
c0 AS (SELECT feature, value, count(*) FILTER ("group" = 'top') AS top, count(*) FILTER ("group" = 'bottom') AS bottom,
       count(*) AS n FROM cl WHERE "group" IN ('top', 'bottom') GROUP BY ALL),
cat AS (SELECT feature, value, top, bottom, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS rank FROM c0) WHERE rank <= {k})"""


@query("categorical_top", with_clause(FEAT, categorical_sql(4)) + "SELECT * FROM cat", "A11")
def categorical_top(spark, sf):
    return ranks.top_categories(features(spark, sf), CATEGORICAL, 4)


@query(
    "group_report",
    with_clause(FEAT, numeric_long_sql(), mw_sql(""), binary_sql(), categorical_sql(4))
    + f"""SELECT 'numeric' AS section, feature, CAST(NULL AS VARCHAR) AS value, n_top, n_bot AS n_bottom,
             {R6('med_top')} AS top, {R6('med_bot')} AS bottom, {R6('delta')} AS delta, {R6('p')} AS p, {R6('q')} AS q FROM cmp
          UNION ALL SELECT 'binary', feature, NULL, n_top, n_bottom, CAST(top AS DOUBLE), CAST(bottom AS DOUBLE), NULL, {R6('p')}, NULL FROM bin
          UNION ALL SELECT 'categorical', feature, value, NULL, NULL, CAST(top AS DOUBLE), CAST(bottom AS DOUBLE), NULL, NULL, NULL FROM cat""",
    "T17",
)
def group_report(spark, sf):
    """Numeric, binary and categorical sections as one long table."""
    feat = feature_table(spark, sf, "group", *NUMERIC, *BINARY, *CATEGORICAL)
    num = cmp_out(ranks.compare_groups(ranks.melt(feat, ["group"], NUMERIC))).select(
        F.lit("numeric").alias("section"), "feature", F.lit(None).cast("string").alias("value"), "n_top",
        F.col("n_bot").alias("n_bottom"), F.col("med_top").alias("top"), F.col("med_bot").alias("bottom"),
        "delta", "p", "q",
    )
    binary = r6(ranks.two_by_two(feat, BINARY), "p").select(
        F.lit("binary").alias("section"), "feature", F.col("top").cast("double").alias("top"), "n_top",
        F.col("bottom").cast("double").alias("bottom"), "n_bottom", "p",
    )
    cat = ranks.top_categories(feat, CATEGORICAL, 4).select(
        F.lit("categorical").alias("section"), "feature", "value",
        F.col("top").cast("double").alias("top"), F.col("bottom").cast("double").alias("bottom"),
    )
    return num.unionByName(binary, allowMissingColumns=True).unionByName(cat, allowMissingColumns=True)


@query(
    "headline_effects",
    with_clause(FEAT, numeric_long_sql(), mw_sql("domain, "))
    + f"""SELECT domain, feature, {R6('delta')} AS delta, {R6('q')} AS q FROM cmp
          WHERE abs(delta) >= 0.02 ORDER BY abs(floor(delta * 1000000.0 + 0.5)) DESC, domain, feature LIMIT 10""",
    "T20",
)
def headline_effects(spark, sf):
    res = r6(by_domain(spark, sf), "delta", "q")
    return reports.headline(res, 10, 0.02, ("domain", "feature")).select("domain", "feature", "delta", "q")


TREND_ORDER = ("bottom", "middle", "top")


@query(
    "trend_three_groups",
    with_clause(FEAT, numeric_long_sql())
    + f""", l AS (SELECT feature, value, CASE "group" WHEN 'bottom' THEN 0 WHEN 'middle' THEN 1 WHEN 'top' THEN 2 END AS g
                 FROM long WHERE "group" IS NOT NULL),
     c AS (SELECT feature, value, count(*) FILTER (g = 0) AS a, count(*) FILTER (g = 1) AS b, count(*) FILTER (g = 2) AS c,
                  CAST(count(*) AS DOUBLE) AS t FROM l GROUP BY ALL),
     d AS (SELECT *, coalesce(sum(a) OVER w, 0) AS ba, coalesce(sum(b) OVER w, 0) AS bb FROM c
           WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     e AS (SELECT feature, CAST(sum(a) AS DOUBLE) AS na, CAST(sum(b) AS DOUBLE) AS nb, CAST(sum(c) AS DOUBLE) AS nc,
             sum(b * (2.0 * ba + a) + c * (2.0 * ba + a) + c * (2.0 * bb + b)) AS wins,
             sum(t * (t - 1) / 2) AS ny, sum(t * (t - 1) * (2 * t + 5)) AS vy, sum(t * (t - 1) * (t - 2)) AS y3
           FROM d GROUP BY feature),
     f AS (SELECT *, wins - na * nb - na * nc - nb * nc AS s, na + nb + nc AS n,
             (na * (na - 1) + nb * (nb - 1) + nc * (nc - 1)) / 2 AS nx,
             na * (na - 1) * (2 * na + 5) + nb * (nb - 1) * (2 * nb + 5) + nc * (nc - 1) * (2 * nc + 5) AS vx,
             na * (na - 1) * (na - 2) + nb * (nb - 1) * (nb - 2) + nc * (nc - 1) * (nc - 2) AS x3
           FROM e WHERE na >= 3 AND nb >= 3 AND nc >= 3),
     g AS (SELECT *, s / sqrt((n * (n - 1) / 2 - nx) * (n * (n - 1) / 2 - ny)) AS stat,
             (n * (n - 1) * (2 * n + 5) - vx - vy) / 18.0 + 2 * nx * ny / (n * (n - 1)) + x3 * y3 / (9.0 * n * (n - 1) * (n - 2)) AS v FROM f),
     h AS (SELECT *, {erfc_sql('abs(s) / sqrt(v) / sqrt(2.0)')} AS p FROM g),
     m AS (SELECT feature, quantile_cont(value, 0.5) FILTER (g = 0) AS m0, quantile_cont(value, 0.5) FILTER (g = 1) AS m1,
                  quantile_cont(value, 0.5) FILTER (g = 2) AS m2 FROM l GROUP BY feature),
     q0 AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS r, count(*) OVER () AS k FROM h JOIN m USING (feature)),
     q1 AS (SELECT *, least(1.0, min(p * k / r) OVER (ORDER BY r DESC)) AS q,
              CASE WHEN m0 <= m1 AND m1 <= m2 THEN 'increasing' WHEN m0 >= m1 AND m1 >= m2 THEN 'decreasing'
                   ELSE 'non-monotone' END AS median_order FROM q0)
     SELECT feature, CAST(na AS BIGINT) AS n_bottom, CAST(nb AS BIGINT) AS n_middle, CAST(nc AS BIGINT) AS n_top,
            {R6('m0')} AS med_bottom, {R6('m1')} AS med_middle, {R6('m2')} AS med_top, {R6('stat')} AS stat,
            {R6('p')} AS p, {R6('q')} AS q, median_order,
            CASE WHEN median_order <> 'non-monotone' AND q < 0.05 THEN 'holds'
                 WHEN median_order <> 'non-monotone' THEN 'direction only' ELSE 'does not hold' END AS verdict FROM q1""",
    "T5 T6",
)
def trend_three_groups(spark, sf):
    t = ranks.trend(long_features(spark, sf), TREND_ORDER)
    return r6(t, "med_bottom", "med_middle", "med_top", "stat", "p", "q")


@query(
    "sensitivity_dominant_source",
    with_clause(FEAT)
    + """, src AS (SELECT domain, mood FROM (SELECT domain, mood, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, mood) AS r
                  FROM feat WHERE mood IS NOT NULL GROUP BY domain, mood) WHERE r = 1),
         main AS (SELECT feat.* FROM feat JOIN src USING (domain, mood)), """
    + numeric_long_sql().replace("FROM feat", "FROM main") + ","
    + mw_sql("domain, ", min_n=5) + f" SELECT domain, mood, {CMP_OUT} FROM cmp JOIN src USING (domain)",
    "T21",
)
def sensitivity_dominant_source(spark, sf):
    """Every metric again, on the items of each domain's most frequent source only."""
    feat = feature_table(spark, sf, "domain", "group", "mood", *NUMERIC)
    main = materialise(reports.dominant_source(feat, ["domain"], "mood"))
    kept = tables.attach_few(feat, main, ["domain", "mood"])
    res = ranks.compare_groups(ranks.melt(kept, ["domain", "group"], NUMERIC), keys=["domain"], min_n=5)
    return cmp_out(res.join(main, "domain"), "domain", "mood")


@query(
    "attrition",
    with_clause(FEAT)
    + """SELECT domain, count(*) AS total, count(*) FILTER (n_lines IS NOT NULL) AS with_source,
            count(*) FILTER (n_lines >= 4) AS passed,
            CAST(count(*) FILTER (n_lines >= 4) AS DOUBLE) / count(*) FILTER (n_lines IS NOT NULL) AS share
         FROM feat GROUP BY domain""",
    "T22",
)
def attrition(spark, sf):
    n = F.col("n_lines")
    return reports.attrition(features(spark, sf), ["domain"], n.isNotNull(), F.coalesce(n >= 4, F.lit(False)))


# ------------------------------------------------------------- correlations

PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1 :]]


def spearman_sql(source: str, pairs, keys: str = "domain, ") -> str:
    parts = [
        f"SELECT {keys}'{a}' AS feature_a, '{b}' AS feature_b, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
        f"FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a, b in pairs
    ]
    return f"""pr AS ({' UNION ALL '.join(parts)}),
prr AS (SELECT *, rank() OVER (PARTITION BY {keys}feature_a, feature_b ORDER BY x)
                 + (count(*) OVER (PARTITION BY {keys}feature_a, feature_b, x) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY {keys}feature_a, feature_b ORDER BY y)
                 + (count(*) OVER (PARTITION BY {keys}feature_a, feature_b, y) - 1) / 2.0 AS ry FROM pr),
rho AS (SELECT {keys}feature_a, feature_b, count(*) AS n, corr(rx, ry) AS rho FROM prr GROUP BY ALL HAVING count(*) >= 3)"""


@query(
    "spearman_pairs",
    with_clause(FEAT, numeric_long_sql(), spearman_sql("feat", PAIRS))
    + """, enough AS (SELECT domain, feature FROM long GROUP BY ALL HAVING count(*) >= 20)
         SELECT domain, feature_a, feature_b, n, floor(rho * 10000.0 + 0.5) / 10000.0 AS rho FROM rho
         WHERE (domain, feature_a) IN (SELECT domain, feature FROM enough) AND (domain, feature_b) IN (SELECT domain, feature FROM enough)""",
    "T7 T8",
)
def spearman_pairs(spark, sf):
    """The correlation matrix of all numeric features per domain."""
    feat = feature_table(spark, sf, "domain", *NUMERIC)
    return ranks.spearman_matrix(feat, NUMERIC, keys=["domain"]).withColumn("rho", rnd("rho", 4))


PLUS, MINUS = ["n_lines", "qty_avg"], ["price_min"]


def z_sql(c: str) -> str:
    return f"({c} - (SELECT avg({c}) FROM feat)) / ((SELECT stddev_pop({c}) FROM feat) + 1e-9)"


CONSTRUCT_SQL = f"""zz AS (SELECT item, domain, ratio, {z_sql('n_lines')} AS z1, {z_sql('qty_avg')} AS z2,
  -({z_sql('price_min')}) AS z3, {z_sql('price_avg')} AS y1, {z_sql('disc_avg')} AS y2 FROM feat),
sc AS (SELECT item, domain, CASE WHEN ratio > 0 THEN log10(ratio) END AS log_ratio,
  CASE WHEN z1 IS NOT NULL THEN {R6('(z1 + z2 + z3) / 3')} END AS tempo,
  CASE WHEN y1 IS NOT NULL THEN {R6('(y1 + y2) / 2')} END AS visual FROM zz)"""


@query(
    "construct_scores",
    with_clause(FEAT, CONSTRUCT_SQL, spearman_sql("sc", [("tempo", "visual"), ("tempo", "log_ratio"), ("visual", "log_ratio")]))
    + f"SELECT * REPLACE (floor(rho * 10000.0 + 0.5) / 10000.0 AS rho) FROM rho",
    "T23 T24 N5",
)
def construct_scores(spark, sf):
    feat = feature_table(spark, sf, "domain", "ratio", *PLUS, *MINUS, "price_avg", "disc_avg")
    scored = feat.select(
        "domain",
        F.when(F.col("ratio") > 0, F.log10("ratio")).alias("log_ratio"),
        rnd(reports.construct(feat, PLUS, MINUS), 6).alias("tempo"),
        rnd(reports.construct(feat, ["price_avg", "disc_avg"]), 6).alias("visual"),
    )
    pairs = [("tempo", "visual"), ("tempo", "log_ratio"), ("visual", "log_ratio")]
    return ranks.spearman(scored, pairs, keys=["domain"]).withColumn("rho", rnd("rho", 4))


@query(
    "block_coherence",
    with_clause(FEAT, spearman_sql("feat", [("n_lines", "qty_avg"), ("n_lines", "price_min"), ("qty_avg", "price_min")], keys=""))
    + f"SELECT {R6('avg(abs(rho))')} AS coherence, count(*) AS n_pairs FROM rho",
    "T23",
)
def block_coherence(spark, sf):
    return r6(reports.coherence(features(spark, sf), [*PLUS, *MINUS]), "coherence")


# ------------------------------------------------------------- paired tests

PAIRED_SQL = CHANNEL_SQL + """,
paired AS (SELECT domain, floor((ln(ratio_t) - ln(ratio_c)) * 1000000.0 + 0.5) / 1000000.0 AS diff FROM matched),
nz AS (SELECT *, abs(diff) AS ad FROM paired WHERE diff <> 0),
rk AS (SELECT *, rank() OVER (PARTITION BY domain ORDER BY ad) + (count(*) OVER (PARTITION BY domain, ad) - 1) / 2.0 AS r FROM nz),
tt AS (SELECT domain, sum(CAST(t AS DOUBLE) * t * t - t) AS tie_term FROM (SELECT domain, ad, count(*) AS t FROM nz GROUP BY ALL) GROUP BY ALL),
ws AS (SELECT domain, count(*) AS n_used, coalesce(sum(r) FILTER (diff > 0), 0.0) AS w_plus FROM rk GROUP BY domain),
pz AS (SELECT domain, count(*) AS n_pairs, count(*) FILTER (diff = 0) AS zeros, quantile_cont(diff, 0.5) AS med FROM paired GROUP BY domain)"""
WILCOXON_Z = "abs(least(w_plus, n_used * (n_used + 1) / 2.0 - w_plus) - n_used * (n_used + 1) / 4.0) / sqrt(n_used * (n_used + 1) * (2.0 * n_used + 1) / 24.0 - tie_term / 48.0) / sqrt(2.0)"


def paired_by_channel(spark, sf):
    """Log ratio of every premiere against the item it is matched with."""
    return channel_pairs(spark, sf).select("domain", rnd(F.log("treated_ratio") - F.log("control_ratio"), 6).alias("diff"))


def matched_summary(spark, sf, method="auto"):
    from cuesheet.operators.ordered import quantiles

    pairs = materialise(paired_by_channel(spark, sf))
    s = ranks.signed_rank(pairs, "diff", ["domain"], method=method)
    return s.join(quantiles(pairs, ["domain"], "diff", {"median_log_ratio": 0.5}), "domain")


@query(
    "signed_rank",
    with_clause(POP, PAIRED_SQL)
    + f"""SELECT domain, n_pairs, zeros, n_used, w_plus, tie_term, {R6(erfc_sql(WILCOXON_Z))} AS p,
            {R6('med')} AS median_log_ratio, {R6('exp(med)')} AS median_ratio
          FROM pz JOIN ws USING (domain) JOIN tt USING (domain) WHERE n_pairs >= 10""",
    "T9 T10 N5",
)
def signed_rank(spark, sf):
    """All domains with the normal p, which SQL can state; tests hold the exact p."""
    s = matched_summary(spark, sf, "normal")
    s = s.withColumn("median_ratio", F.exp("median_log_ratio"))
    return r6(s, "p", "median_log_ratio", "median_ratio")


@query(
    "preregistered_gate",
    with_clause(FEAT, numeric_long_sql(), mw_sql("domain, ").replace("rk AS", "rk0 AS").replace("FROM rk ", "FROM rk0 "), PAIRED_SQL)
    + f""", hits AS (SELECT q < 0.05 AND abs(delta) >= 0.33 AS hit FROM cmp
                    UNION ALL SELECT domain <> 'HOUSEHOLD' AND {erfc_sql(WILCOXON_Z)} < 0.05
                    FROM pz JOIN ws USING (domain) JOIN tt USING (domain) WHERE n_pairs >= 10)
          SELECT count(*) FILTER (hit) AS n_hits, bool_or(hit) AS passed FROM hits""",
    "T19",
)
def preregistered_gate(spark, sf):
    matched = matched_summary(spark, sf).withColumn("auxiliary", F.col("domain") == "HOUSEHOLD")
    return reports.gate(by_domain(spark, sf), matched)


# ------------------------------------------------------------- agreement

LAB_SQL = """pl AS (SELECT d.doc_id, d.lang, CASE WHEN n_chars >= 300 AND n_chars % 5 <> 0 THEN 1 ELSE 0 END AS pred, quality AS lab,
  CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars % 4 END AS na, d.doc_id % 4 AS nb,
  CASE WHEN n_chars % 3 = 0 THEN 'calm' WHEN n_chars % 3 = 1 THEN 'dark' ELSE 'warm' END AS mood_a,
  CASE WHEN n_chars % 6 < 2 THEN 'calm' WHEN n_chars % 3 = 1 THEN 'dark' ELSE 'warm' END AS mood_b
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
KAPPA_SQL = """cf AS (SELECT {k}CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS n FROM pl GROUP BY ALL),
ma AS (SELECT {k}a AS c, sum(n) AS r FROM cf GROUP BY ALL), mb AS (SELECT {k}b AS c, sum(n) AS q FROM cf GROUP BY ALL),
pe AS (SELECT {k}sum(CAST(r AS DOUBLE) * q) AS rc FROM ma JOIN mb USING ({k}c) GROUP BY ALL),
po AS (SELECT {k}CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (a = b), 0) AS DOUBLE) / sum(n) AS accuracy FROM cf GROUP BY ALL)"""


def predictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    n, i = F.col("n_chars"), F.col("doc_id")
    return d.join(table(spark, sf, "labels"), "doc_id").select(
        "doc_id", "lang",
        F.when((n >= 300) & (n % 5 != 0), 1).otherwise(0).cast("string").alias("pred"),
        F.col("quality").cast("string").alias("lab"),
        F.when(n % 7 == 0, None).otherwise(n % 4).alias("na"),
        (i % 4).alias("nb"),
        F.when(n % 3 == 0, "calm").when(n % 3 == 1, "dark").otherwise("warm").alias("mood_a"),
        F.when(n % 6 < 2, "calm").when(n % 3 == 1, "dark").otherwise("warm").alias("mood_b"),
    )


@query(
    "kappa_accuracy",
    with_clause(LAB_SQL, KAPPA_SQL.format(k="lang, ", a="mood_a", b="mood_b"))
    + f"""SELECT lang, n, {R6('accuracy')} AS accuracy,
            {R6('(accuracy - rc / (CAST(n AS DOUBLE) * n)) / (1.0 - rc / (CAST(n AS DOUBLE) * n))')} AS kappa
          FROM po JOIN pe USING (lang)""",
    "T12 J13",
)
def kappa_accuracy(spark, sf):
    return r6(agreement.kappa(predictions(spark, sf), "mood_a", "mood_b", ["lang"]), "accuracy", "kappa")


@query(
    "label_gate",
    with_clause(LAB_SQL, KAPPA_SQL.format(k="", a="pred", b="lab"))
    + f""", g AS (SELECT n, accuracy, (accuracy - rc / (CAST(n AS DOUBLE) * n)) / (1.0 - rc / (CAST(n AS DOUBLE) * n)) AS kappa FROM po, pe),
          cl AS (SELECT c AS cls, CAST(r AS BIGINT) AS n_pred, CAST(q AS BIGINT) AS n_human,
                   CAST(coalesce((SELECT sum(n) FROM cf WHERE a = c AND b = c), 0) AS DOUBLE) AS tp FROM ma JOIN mb USING (c))
          SELECT cls, n_pred, n_human, {R6('tp / n_pred')} AS "precision", {R6('tp / n_human')} AS recall,
                 {R6('accuracy')} AS accuracy, {R6('kappa')} AS kappa, accuracy >= 0.75 AND kappa >= 0.6 AS passed FROM cl, g""",
    "T14 A13",
)
def label_gate(spark, sf):
    p = predictions(spark, sf)
    gate = agreement.label_gate(p, "pred", "lab").select("accuracy", "kappa", "passed")
    out = agreement.class_scores(p, "pred", "lab").join(F.broadcast(gate), F.lit(True))
    return r6(out, "precision", "recall", "accuracy", "kappa")


@query(
    "agreement_grades",
    with_clause(LAB_SQL, KAPPA_SQL.format(k="lang, ", a="mood_a", b="mood_b"))
    + f""", xs AS (SELECT lang, coalesce(na, 0) AS x, coalesce(nb, 0) AS y FROM pl),
          xr AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS rx,
                        rank() OVER (PARTITION BY lang ORDER BY y) + (count(*) OVER (PARTITION BY lang, y) - 1) / 2.0 AS ry FROM xs),
          na AS (SELECT lang, {R6('CAST(count(*) FILTER (x = y) AS DOUBLE) / count(*)')} AS exact,
                        {R6('CAST(count(*) FILTER (abs(x - y) <= 1) AS DOUBLE) / count(*)')} AS within1,
                        {R6('corr(rx, ry)')} AS rho FROM xr GROUP BY lang),
          kp AS (SELECT lang, n, {R6('(accuracy - rc / (CAST(n AS DOUBLE) * n)) / (1.0 - rc / (CAST(n AS DOUBLE) * n))')} AS kappa FROM po JOIN pe USING (lang))
          SELECT lang, n, kappa, CASE WHEN kappa >= 0.6 THEN 'good' WHEN kappa >= 0.4 THEN 'fair' ELSE 'weak' END AS grade,
                 exact, within1, rho, CASE WHEN rho >= 0.7 THEN 'good' WHEN rho >= 0.5 THEN 'fair' ELSE 'weak' END AS rho_grade
          FROM kp JOIN na USING (lang)""",
    "T13 T25",
)
def agreement_grades(spark, sf):
    p = predictions(spark, sf)
    k = r6(agreement.kappa(p, "mood_a", "mood_b", ["lang"]), "kappa").select("lang", "n", "kappa", agreement.grade().alias("grade"))
    num = r6(agreement.numeric_agreement(p, "na", "nb", ["lang"]).drop("n"), "exact", "within1")
    zero = p.select("lang", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    rho = r6(ranks.spearman(zero, [("na", "nb")], keys=["lang"]).select("lang", "rho"), "rho")
    return k.join(num, "lang").join(rho, "lang").withColumn("rho_grade", agreement.grade_rho())


CLASS_SQL = """cls AS (SELECT k % 2 AS fps, CASE kind WHEN 'view' THEN 'static' WHEN 'click' THEN 'camera_motion' ELSE 'subject_motion' END AS label,
  CAST(amount AS DOUBLE) AS value FROM ev WHERE kind IN ('view', 'click', 'purchase'))"""


def class_pair_sql(a: str, b: str) -> str:
    body = mw_sql("fps, ", a, b, 1).rstrip()
    return f"""SELECT fps, '{a}' AS "first", '{b}' AS "second", n_top, n_bot, {R6('med_top')} AS med_top, {R6('med_bot')} AS med_bot,
      u, {R6('delta')} AS delta, {R6('p')} AS p FROM (WITH long AS (SELECT fps, 'value' AS feature, label AS "group", value FROM cls), {body} SELECT * FROM cmp)"""


@query(
    "ordered_classes",
    with_clause(EV, CLASS_SQL)
    + " UNION ALL ".join([
        class_pair_sql("static", "camera_motion"), class_pair_sql("static", "subject_motion"),
        class_pair_sql("camera_motion", "subject_motion"),
    ]),
    "T15 T16",
)
def ordered_classes(spark, sf):
    ev = timed_events(spark, sf).where(F.col("kind").isin("view", "click", "purchase"))
    rows = ev.select(
        (F.col("k") % 2).alias("fps"),
        F.when(F.col("kind") == "view", "static").when(F.col("kind") == "click", "camera_motion")
        .otherwise("subject_motion").alias("label"),
        F.col("amount").alias("value"),
    )
    return r6(agreement.ordered_classes(rows, "label", "value", ["fps"]), "med_top", "med_bot", "delta", "p")


@query(
    "ordering_verdict",
    with_clause(EV, CLASS_SQL)
    + f""", pairs AS ({class_pair_sql("static", "camera_motion")} UNION ALL {class_pair_sql("static", "subject_motion")})
          SELECT fps, bool_and(med_top < med_bot) AS ordering_ok FROM pairs GROUP BY fps""",
    "T15 T16",
)
def ordering_verdict(spark, sf):
    """Per frame-rate cell: does the static class lie below both moving classes?"""
    return agreement.ordering_verdict(ordered_classes(spark, sf), ["fps"])


@query(
    "domain_counts",
    with_clause(FEAT)
    + """SELECT coalesce(domain, 'all') AS domain, count(*) AS n, count(*) FILTER ("group" = 'top') AS top,
            count(*) FILTER ("group" = 'bottom') AS bottom FROM feat GROUP BY ROLLUP (domain)""",
    "A21 U3",
)
def domain_counts(spark, sf):
    return features(spark, sf).rollup("domain").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("group") == "top").alias("top"),
        F.count_if(F.col("group") == "bottom").alias("bottom"),
    ).withColumn("domain", F.coalesce("domain", F.lit("all")))
