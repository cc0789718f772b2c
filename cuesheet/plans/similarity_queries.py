"""Scales, neighbours, percentiles, axes and diagnosis."""

from __future__ import annotations

from pyspark.sql import Row
from pyspark.sql import functions as F

from cuesheet.functions.numbers import rnd
from cuesheet.operators import pca, ranks, similarity
from cuesheet.plans.registry import query
from cuesheet.plans.roles import FEAT, NUMERIC, feature_table, features, numeric_long_sql, table, with_clause
from cuesheet.plans.stats_queries import R6, r6

COLS = NUMERIC
TARGETS = [7, 150, 420, 900, 1333]
TSQL = ", ".join(map(str, TARGETS))
LONG = numeric_long_sql(COLS)


SCALE_SQL = f"""ord AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n,
  quantile_cont(value, 0.5) OVER (PARTITION BY feature) AS med FROM long),
scale AS (SELECT feature, max(n) AS n, max(med) AS median, quantile_cont(abs(value - med), 0.5) AS mad,
  greatest(quantile_cont(abs(value - med), 0.5) * 1.4826,
    greatest(max(value) FILTER (i = n * 3 // 4) - max(value) FILTER (i = n // 4), 0.0) / 1.349, (max(value) - min(value)) / 20.0, 1e-9) AS scale
  FROM ord GROUP BY feature)"""


@query("robust_scale", with_clause(FEAT, LONG, SCALE_SQL) + f"SELECT feature, n, {R6('median')} AS median, {R6('mad')} AS mad, {R6('scale')} AS scale FROM scale", "M1")
def robust_scale(spark, sf):
    s = similarity.robust_scale(ranks.melt(feature_table(spark, sf, "item", *COLS), ["item"], COLS))
    return r6(s, "median", "mad", "scale")


@query(
    "knn_similar",
    with_clause(FEAT, LONG, SCALE_SQL)
    + f""", dd AS (SELECT t.item AS target, x.item, floor(sqrt(avg(((x.value - t.value) / scale) * ((x.value - t.value) / scale))) * 10000.0 + 0.5) / 10000.0 AS distance
             FROM long t JOIN long x USING (feature) JOIN scale USING (feature) WHERE t.item IN ({TSQL}) AND x.item <> t.item GROUP BY ALL)
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, item) AS rank FROM dd) WHERE rank <= 10""",
    "M2 M3 K3 J16",
)
def knn_similar(spark, sf):
    f = feature_table(spark, sf, "item", *COLS)
    scale = {r["feature"]: r["scale"] for r in similarity.robust_scale(ranks.melt(f, ["item"], COLS)).collect()}
    return similarity.neighbours(f, similarity.target_rows(f, TARGETS, "item", COLS), COLS, scale, 10)


@query(
    "outlier_scores",
    with_clause(FEAT, LONG, SCALE_SQL)
    + """, sc AS (SELECT item, floor(sqrt(avg(((value - median) / scale) * ((value - median) / scale))) * 10000.0 + 0.5) / 10000.0 AS score
                 FROM long JOIN scale USING (feature) GROUP BY item)
         SELECT * FROM sc ORDER BY score DESC, item LIMIT 50""",
    "M4 K4",
)
def outlier_scores(spark, sf):
    f = feature_table(spark, sf, "item", *COLS)
    return similarity.outliers(f, COLS, similarity.robust_scale(ranks.melt(f, ["item"], COLS)), 50)


PCT_SQL = """pct AS (SELECT item, feature, value, floor(100.0 * ((rank() OVER (PARTITION BY feature ORDER BY value) - 1)
    + 0.5 * count(*) OVER (PARTITION BY feature, value)) / count(*) OVER (PARTITION BY feature) * 10.0 + 0.5) / 10.0 AS midrank_pct,
  floor(100.0 * ((rank() OVER (PARTITION BY feature ORDER BY value) - 1)
    + count(*) OVER (PARTITION BY feature, value)) / count(*) OVER (PARTITION BY feature) * 10.0 + 0.5) / 10.0 AS at_or_below_pct FROM long)"""


@query("midrank_percentile", with_clause(FEAT, LONG, PCT_SQL) + "SELECT item, feature, midrank_pct FROM pct", "W7")
def midrank_percentile(spark, sf):
    long = ranks.melt(feature_table(spark, sf, "item", *COLS), ["item"], COLS)
    return similarity.with_percentiles(long, long).select("item", "feature", "midrank_pct")


@query("at_or_below_percentile", with_clause(FEAT, LONG, PCT_SQL) + "SELECT item, feature, at_or_below_pct FROM pct", "W8")
def at_or_below_percentile(spark, sf):
    long = ranks.melt(feature_table(spark, sf, "item", *COLS), ["item"], COLS)
    return similarity.with_percentiles(long, long).select("item", "feature", "at_or_below_pct")


@query("target_benchmark", with_clause(FEAT, LONG, PCT_SQL) + f"SELECT item, feature, value, midrank_pct AS percentile FROM pct WHERE item IN ({TSQL})", "M5 W7")
def target_benchmark(spark, sf):
    long = ranks.melt(feature_table(spark, sf, "item", *COLS), ["item"], COLS)
    asked = long.where(F.col("item").isin(TARGETS))
    return similarity.with_percentiles(asked, long).select("item", "feature", "value", F.col("midrank_pct").alias("percentile"))


EVIDENCE_SQL = PCT_SQL + """,
mo AS (SELECT feature, avg(value) AS reference_mean, stddev_pop(value) AS reference_std, quantile_cont(value, 0.5) AS reference_median, count(*) AS reference_n FROM long GROUP BY feature)"""


@query(
    "evidence_report",
    with_clause(FEAT, LONG, EVIDENCE_SQL)
    + f"""SELECT item, feature, value, {R6('(value - reference_mean) / reference_std')} AS z, midrank_pct AS percentile, {R6('reference_mean')} AS reference_mean,
            {R6('reference_std')} AS reference_std, {R6('reference_median')} AS reference_median, reference_n
          FROM pct JOIN mo USING (feature) WHERE item % 20 = 0""",
    "C5 M6",
)
def evidence_report(spark, sf):
    f = feature_table(spark, sf, "item", *COLS)
    rows = similarity.evidence(f, f.where(F.col("item") % 20 == 0), COLS)
    return r6(rows, "z", "reference_mean", "reference_std", "reference_median").select(
        "item", "feature", "value", "z", "percentile", "reference_mean", "reference_std", "reference_median", "reference_n"
    )


@query(
    "centroid_distance",
    with_clause(FEAT, LONG, EVIDENCE_SQL)
    + f""", ce AS (SELECT "group", feature, avg(value) AS c FROM long WHERE "group" IN ('top', 'bottom') GROUP BY ALL),
          cd AS (SELECT t.item AS target, ce."group", sqrt(avg(((t.value - c) / reference_std) * ((t.value - c) / reference_std))) AS distance, count(*) AS n
                 FROM long t JOIN ce USING (feature) JOIN mo USING (feature) WHERE t.item IN ({TSQL}) GROUP BY t.item, ce."group")
          SELECT target, {R6('max(distance) FILTER ("group" = \'top\' AND n >= 6)')} AS top_distance, {R6('max(distance) FILTER ("group" = \'bottom\' AND n >= 6)')} AS bottom_distance,
            CASE WHEN abs(max(distance) FILTER ("group" = 'top' AND n >= 6) - max(distance) FILTER ("group" = 'bottom' AND n >= 6)) > 1e-4 THEN
              CASE WHEN max(distance) FILTER ("group" = 'top') < max(distance) FILTER ("group" = 'bottom') THEN 'top' ELSE 'bottom' END END AS closer_group
          FROM cd GROUP BY target""",
    "M7 M8",
)
def centroid_distance(spark, sf):
    f = feature_table(spark, sf, "item", "group", *COLS)
    mom = similarity.moments(f, COLS)
    d = similarity.centroid_distances(f, similarity.target_rows(f, TARGETS, "item", COLS), COLS, mom, "group")
    return r6(similarity.closer_group(d, "group"), "top_distance", "bottom_distance")


@query(
    "embedding_neighbours",
    "WITH v AS (SELECT vec_id AS item, CAST(generate_subscripts(embedding, 1) AS BIGINT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),"
    " s AS (SELECT dim, stddev_pop(x) AS sd FROM v GROUP BY dim),"
    f" d AS (SELECT t.item AS target, v.item, floor(sqrt(avg(((v.x - t.x) / sd) * ((v.x - t.x) / sd))) * 10000.0 + 0.5) / 10000.0 AS distance FROM v t JOIN v USING (dim) JOIN s USING (dim)"
    f" WHERE t.item % 20 = 0 AND v.item <> t.item GROUP BY ALL)"
    " SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY distance, item) AS rank FROM d) WHERE rank <= 5",
    "M7 M13 K3",
)
def embedding_neighbours(spark, sf):
    """Every twentieth vector against all, in all dimensions."""
    v = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("e")
    )
    return similarity.array_neighbours(v, v.where(F.col("item") % 20 == 0), "e", 5)


# ------------------------------------------------------------- axes

def _filled(c: str) -> str:
    return f"coalesce({c}, (SELECT quantile_cont({c}, 0.5) FROM feat))"


Z_SQL = "fz AS (SELECT " + ", ".join(f"{_filled(c)} AS {c}" for c in COLS) + " FROM feat), zz AS (SELECT " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM fz)) / (SELECT stddev_pop({c}) FROM fz) AS {c}" for c in COLS
) + " FROM fz)"


@query(
    "pca_gram",
    with_clause(FEAT, Z_SQL)
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, floor(sum({a} * {b}) * 1000.0 + 0.5) / 1000.0 AS value FROM zz"
        for i, a in enumerate(COLS) for j, b in enumerate(COLS)
    ),
    "M9",
)
def pca_gram(spark, sf):
    f = feature_table(spark, sf, *COLS)
    axes = pca.preprocess(f, COLS)
    return pca.gram(f, axes.z()).withColumn("value", rnd("value", 3))


@query("pca_fit_project", None, "M9 M10")
def pca_fit_project(spark, sf):
    f = feature_table(spark, sf, "item", "group", *COLS)
    return pca.project(f, pca.fit(f, COLS, min_n=20, constant="keep"), ["item", "group"])


@query("pca_loadings", None, "M10 K8")
def pca_loadings(spark, sf):
    axes = pca.fit(feature_table(spark, sf, *COLS), COLS)
    rows = [Row(**r, explained_pct=axes.explained_pct[int(r["component"][2:]) - 1]) for r in pca.top_loadings(axes)]
    return spark.createDataFrame(rows, "component string, feature string, loading double, explained_pct double")


@query("axis_congruence", None, "M12")
def axis_congruence(spark, sf):
    f = feature_table(spark, sf, "domain", *COLS)
    a, b = (
        pca.fit(f.where(F.col("domain") == d).select(*COLS), COLS, constant="keep", anchor="price_avg")
        for d in ("BUILDING", "MACHINERY")
    )
    return spark.createDataFrame([("BUILDING", "MACHINERY", pca.congruence(a, b))], "first string, second string, congruence double")


@query(
    "axis_clip",
    with_clause(FEAT)
    + "SELECT item, " + ", ".join(
        f"""CASE WHEN {c} IS NOT NULL THEN floor((greatest(0.0, least(1.0, ({c} - (SELECT quantile_cont({c}, 0.02) FROM feat))
          / ((SELECT quantile_cont({c}, 0.98) FROM feat) - (SELECT quantile_cont({c}, 0.02) FROM feat) + 1e-9))) * 2.0 - 1.0) * 1000.0 + 0.5) / 1000.0 END AS {c}"""
        for c in ("price_avg", "qty_avg", "like_rate")
    ) + " FROM feat",
    "M11",
)
def axis_clip(spark, sf):
    return similarity.axis_positions(feature_table(spark, sf, "item", "price_avg", "qty_avg", "like_rate"), ["price_avg", "qty_avg", "like_rate"], ["item"])


@query(
    "clamped_z",
    with_clause(FEAT)
    + f"SELECT item, {R6('greatest(-3.0, least(3.0, (price_avg - (SELECT avg(price_avg) FROM feat)) / (SELECT stddev_pop(price_avg) FROM feat)))')} AS z FROM feat WHERE price_avg IS NOT NULL",
    "M14 M6",
)
def clamped_z(spark, sf):
    f = features(spark, sf).select("item", "price_avg")
    m = similarity.moments(f, ["price_avg"])["price_avg"]
    z = (F.col("price_avg") - F.lit(m["mean"])) / F.lit(m["std"])
    return f.where(F.col("price_avg").isNotNull()).select("item", rnd(similarity.clamp_z(z), 6).alias("z"))


DIRECTIONS = {"price_avg": 1, "n_lines": -1, "like_rate": 1}


@query(
    "diagnose_target",
    with_clause(FEAT, numeric_long_sql(list(DIRECTIONS)))
    + """, md AS (SELECT feature, quantile_cont(value, 0.5) FILTER ("group" = 'top') AS mt, quantile_cont(value, 0.5) FILTER ("group" = 'bottom') AS mb FROM long GROUP BY feature),
         cv AS (SELECT feature, value, count(*) FILTER ("group" = 'top') AS a FROM long GROUP BY ALL),
         cu AS (SELECT *, coalesce(sum(a) OVER (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(a) OVER (PARTITION BY feature) AS tot FROM cv)
         SELECT item, feature, l.value, floor(100.0 * (below + 0.5 * a) / tot * 10.0 + 0.5) / 10.0 AS pct_in_top,
           CASE WHEN (feature = 'n_lines' AND l.value <= (mt + mb) / 2.0) OR (feature <> 'n_lines' AND l.value >= (mt + mb) / 2.0) THEN 'top-like' ELSE 'bottom-like' END AS verdict
         FROM long l JOIN md USING (feature) JOIN cu USING (feature, value)""",
    "M15",
)
def diagnose_target(spark, sf):
    return similarity.diagnose(feature_table(spark, sf, "item", "group", *DIRECTIONS), DIRECTIONS)
