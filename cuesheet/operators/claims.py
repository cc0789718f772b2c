"""Rule-based claims over evidence rows, for any number of targets at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits, withdrawn prefixes, composed rules and claim texts.
DISTINCTIVE_Z, HIGH_PCT, LOW_PCT = 0.75, 80, 20
WITHDRAWN_PREFIX = "motion_scene_"
COMPOSED = (
    # id, subject, text key, confidence, (feature, measure, operator, limit) twice
    ("feel:closeup-focus", "visual framing", "reason.feel.closeup_focus", "medium",
     (("tag_closeup_ratio", "z", ">=", 0.6), ("tag_wide_ratio", "z", "<=", -0.6))),
    ("feel:event-dense-audio", "audio intensity", "reason.feel.event_dense_audio", "high",
     (("audio_onsets_per_sec", "z", ">=", 0.75), ("audio_peak_energy_ratio", "z", ">=", 0.75))),
    ("feel:front-loaded-opening", "opening hook", "reason.feel.front_loaded", "high",
     (("hook_cuts_first_15s", "z", ">=", 0.75), ("sync_first_cut_s", "percentile", "<=", 20))),
    ("feel:rapid-pacing", "editing rhythm", "reason.feel.rapid_pacing", "medium",
     (("scene_cuts_per_minute", "z", ">=", 0.5), ("scene_median_shot_len_s", "z", "<=", -0.5))),
    ("feel:vivid-visuals", "visual appearance", "reason.feel.vivid_visuals", "medium",
     (("scene_avg_saturation", "z", ">=", 0.6), ("scene_avg_brightness", "z", ">=", 0.6))),
)
TEXTS = (
    # text key, English, Korean; %1$s label, %2$s percentile or number of favourites
    ("reason.feature.high",
     "%1$s is relatively high in this reference corpus (reference percentile %2$s).",
     "%1$s은(는) 이 기준 코퍼스에서 상대적으로 높습니다 (기준 코퍼스 백분위 %2$s)."),
    ("reason.feature.low",
     "%1$s is relatively low in this reference corpus (reference percentile %2$s).",
     "%1$s은(는) 이 기준 코퍼스에서 상대적으로 낮습니다 (기준 코퍼스 백분위 %2$s)."),
    ("reason.feel.closeup_focus",
     "The visual framing leans toward close-ups rather than wide shots.",
     "화면 구성은 와이드 샷보다 클로즈업 쪽으로 기울어 있습니다."),
    ("reason.feel.event_dense_audio",
     "The audio feels event-dense: onset activity and peak-energy concentration are both elevated.",
     "오디오는 사건 밀도가 높은 편입니다. 온셋 활동과 피크 에너지 집중도가 함께 높습니다."),
    ("reason.feel.front_loaded",
     "The opening is front-loaded: it cuts frequently in the first 15 seconds and the first cut arrives early.",
     "도입부가 앞쪽에 집중되어 있습니다. 첫 15초 컷이 많고 첫 컷도 이르게 등장합니다."),
    ("reason.feel.rapid_pacing",
     "The visual pacing is rapid: cuts are frequent and typical shots are short.",
     "시각적 페이스가 빠릅니다. 컷이 잦고 일반적인 샷 길이가 짧습니다."),
    ("reason.feel.vivid_visuals",
     "The visual presentation is vivid, with both saturation and brightness elevated.",
     "채도와 밝기가 함께 높아 시각적으로 선명한 인상을 만듭니다."),
    ("reason.taste.not_supported",
     "Although this MV is distinctive on %1$s, that axis varies widely across your favorites, so it is not currently supported as a reason you like it.",
     "이 MV의 %1$s 특성은 두드러지지만, 좋아하는 영상들에서는 이 축의 편차가 커서 현재 취향 이유로 지지되지 않습니다."),
    ("reason.taste.conventional",
     "Your favorites share %1$s, but it is also common in the corpus, so it is better treated as convention than a personal taste signal.",
     "좋아하는 영상들이 %1$s 특성을 공유하지만 코퍼스에서도 흔해, 개인 취향 신호보다는 관습에 가깝습니다."),
    ("reason.taste.insufficient",
     "There is an early taste pattern around %1$s, but only %2$s analyzed favorites are available, so evidence is insufficient.",
     "%1$s에서 취향 후보가 보이지만, 분석된 좋아하는 영상이 %2$s편뿐이라 아직 근거가 부족합니다."),
    ("reason.taste.signal",
     "This MV aligns with a repeated pattern in your favorites around %1$s, so it is currently supported as a personal taste signal.",
     "%1$s은(는) 좋아하는 영상에서 반복되는 패턴과 이 MV가 일치해, 현재 개인 취향 신호로 지지됩니다."),
)
BANNED_TYPES = ("success_prediction", "causal_success", "artistic_quality", "psychology")
SUMMARY_LIMITS = {"feel": 4, "distinctive": 4, "taste": 6}

CLAIM_COLUMNS = [
    "id", "question", "claim_type", "subject", "direction", "support", "confidence", "scope", "text_key",
    "feature", "evidence",
]


def allowed(feature: Column) -> Column:
    return ~feature.startswith(WITHDRAWN_PREFIX)


def is_distinctive() -> Column:
    p = F.col("percentile")
    return (F.abs("z") >= DISTINCTIVE_Z) | (p >= HIGH_PCT) | (p <= LOW_PCT)


def strength() -> Column:
    return F.greatest(F.abs("z"), F.abs(F.col("percentile") - 50.0) / 25.0)


def feature_category(feature: Column) -> Column:
    def starts(*prefixes: str) -> Column:
        return reduce(lambda a, b: a | b, [feature.startswith(p) for p in prefixes])

    return (
        F.when(feature.isin("scene_avg_saturation", "scene_avg_brightness"), "visual")
        .when(starts("scene_"), "editing").when(starts("hook_"), "hook").when(starts("audio_"), "audio")
        .when(starts("lyrics_", "tag_lyrics_"), "lyrics").when(starts("thumb_", "title_"), "packaging")
        .when(starts("sync_"), "synchronization").when(starts("tag_"), "visual").otherwise("metadata")
    )


def _evidence(kind: str = "feature") -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.col("feature").alias("feature_id"), F.col("z").alias("z"),
        F.col("percentile").alias("percentile"),
    )


def distinctive(rows: DataFrame) -> DataFrame:
    """One claim per distinctive feature of a target. rows: item, feature, value, z, percentile."""
    p = F.col("percentile")
    direction = F.when((F.col("z") > 0) | (p > 50), "high").otherwise("low")
    sure = (F.abs("z") >= 1.0) | (p >= 90) | (p <= 10)
    return rows.where(allowed(F.col("feature")) & is_distinctive()).select(
        "item",
        F.concat(F.lit("distinctive:"), "feature", F.lit(":"), direction).alias("id"),
        F.lit("distinctive").alias("question"),
        F.lit("descriptive_difference").alias("claim_type"),
        feature_category(F.col("feature")).alias("subject"),
        direction.alias("direction"),
        F.lit("supported").alias("support"),
        F.when(sure, "high").otherwise("medium").alias("confidence"),
        F.lit("reference_corpus").alias("scope"),
        F.concat(F.lit("reason.feature."), direction).alias("text_key"),
        "feature",
        F.array(_evidence()).alias("evidence"),
        strength().alias("strength"),
    )


def composed(rows: DataFrame) -> DataFrame:
    """Two-feature rules. The rule features become columns of one row per target, then rules rows."""
    names = sorted({f for *_, tests in COMPOSED for f, *_ in tests})
    wide = rows.where(F.col("feature").isin(names)).groupBy("item").agg(
        *[
            F.max(F.when(F.col("feature") == f, F.struct("feature", "z", "percentile"))).alias(f)
            for f in names
        ]
    )

    def test(feature, measure, op, limit):
        c = F.col(f"{feature}.{measure}")
        return c >= limit if op == ">=" else c <= limit

    found = []
    for i, (cid, subject, key, confidence, tests) in enumerate(COMPOSED):
        ok = test(*tests[0]) & test(*tests[1])
        ev = [
            F.struct(F.lit("feature").alias("kind"), F.lit(f).alias("feature_id"),
                     F.col(f"{f}.z").alias("z"), F.col(f"{f}.percentile").alias("percentile"))
            for f, *_ in tests
        ]
        found.append(F.when(ok, F.struct(
            F.lit(i).alias("rule"), F.lit(cid).alias("id"), F.lit(subject).alias("subject"),
            F.lit(key).alias("text_key"), F.lit(confidence).alias("confidence"),
            F.lit(tests[0][0]).alias("feature"), F.array(*ev).alias("evidence"),
        )))
    out = wide.select("item", F.explode(F.array_compact(F.array(*found))).alias("c"))
    return out.select(
        "item", "c.id", F.lit("feel").alias("question"), F.lit("measured_composition").alias("claim_type"),
        "c.subject", F.lit("mixed").alias("direction"), F.lit("supported").alias("support"), "c.confidence",
        F.lit("reference_corpus").alias("scope"), "c.text_key", "c.feature", "c.evidence",
        (-F.col("c.rule")).cast("double").alias("strength"),
    )


def _support(n: Column) -> Column:
    return F.when(n >= 4, "supported").otherwise("insufficient")


def taste(rows: DataFrame, profile: DataFrame, n_favourites: int) -> DataFrame:
    """Numeric taste claims: evidence of a target against the verdicts of the favourites.

    ``profile`` has one row per feature (see ``profile.profile_numeric``).
    """
    n = F.lit(n_favourites)
    p = profile.select("feature", "verdict", F.col("median_pct").alias("_mp"))
    j = rows.where(allowed(F.col("feature"))).join(F.broadcast(p), "feature")
    v, pct = F.col("verdict"), F.col("percentile")
    wanted = F.when(v == "distinct-high", "high").when(v == "distinct-low", "low").otherwise("match")
    aligned = F.when(v == "distinct-high", pct >= 70).when(v == "distinct-low", pct <= 30).otherwise(v == "shared")
    kind = (
        F.when((v == "irrelevant") & is_distinctive(), "not-supported")
        .when(v == "convention", "conventional")
        .when(v.isin("distinct-high", "distinct-low", "shared") & aligned, "signal")
    )
    j = j.withColumn("_k", kind).where(F.col("_k").isNotNull())
    return _taste_rows(j, wanted, n, F.array(_evidence(), _taste_evidence("taste_profile", F.col("_mp"))))


def _taste_evidence(kind: str, pct: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), F.col("feature").alias("feature_id"), F.lit(None).cast("double").alias("z"),
        pct.cast("double").alias("percentile"),
    )


def taste_categorical(targets: DataFrame, profile: DataFrame, n_favourites: int) -> DataFrame:
    """Categorical taste claims. targets: item, feature, value; profile: feature, top, verdict …"""
    n = F.lit(n_favourites)
    p = profile.select("feature", "verdict", F.col("top").alias("value"), "corpus_share")
    j = targets.where(allowed(F.col("feature"))).join(F.broadcast(p), ["feature", "value"])
    kind = F.when(F.col("verdict") == "signal", "signal").when(F.col("verdict") == "convention", "conventional")
    j = j.withColumn("_k", kind).where(F.col("_k").isNotNull())
    return _taste_rows(j, F.lit("match"), n, F.array(_taste_evidence("taste_profile_category", F.lit(None))))


def _taste_rows(j: DataFrame, wanted: Column, n: Column, evidence: Column) -> DataFrame:
    k = F.col("_k")
    support = F.when(k == "not-supported", "contradicted").when(k == "conventional", "insufficient").otherwise(_support(n))
    return j.select(
        "item",
        F.concat(F.lit("taste:"), "feature", F.lit(":"), k).alias("id"),
        F.lit("taste").alias("question"),
        F.when(k == "not-supported", "not_supported").when(k == "conventional", "shared_but_conventional")
        .otherwise("taste_signal").alias("claim_type"),
        F.col("feature").alias("subject"),
        F.when(k == "not-supported", "mixed").when(k == "conventional", "match").otherwise(wanted).alias("direction"),
        support.alias("support"),
        F.when(n >= 6, "medium").otherwise("low").alias("confidence"),
        F.lit("taste_profile").alias("scope"),
        F.when(k == "not-supported", "reason.taste.not_supported").when(k == "conventional", "reason.taste.conventional")
        .when(n >= 4, "reason.taste.signal").otherwise("reason.taste.insufficient").alias("text_key"),
        "feature",
        evidence.alias("evidence"),
        F.lit(0.0).alias("strength"),
    )


def ordered_claims(claims: DataFrame) -> DataFrame:
    """Rank per target and question: distinctive by strength, composed by rule order, ties by id."""
    w = Window.partitionBy("item", "question").orderBy(F.col("strength").desc(), "id")
    return claims.withColumn("rank", F.row_number().over(w).cast("bigint"))


def document(claims: DataFrame) -> DataFrame:
    """One row per target: summary ids (4 / 4 / 6) and the claims as an array.

    A target has at most a few claims per feature, so the array is bounded by the columns.
    """
    r = ordered_claims(claims)

    def ids(q):
        inside = (F.col("question") == q) & (F.col("rank") <= SUMMARY_LIMITS[q])
        picked = F.array_sort(F.collect_list(F.when(inside, F.struct("rank", "id"))))
        return F.transform(picked, lambda x: x["id"]).alias(q)

    return r.groupBy("item").agg(
        F.struct(*[ids(q) for q in ("distinctive", "feel", "taste")]).alias("summary"),
        F.array_sort(F.collect_list(F.struct("question", "rank", *CLAIM_COLUMNS[:1], *CLAIM_COLUMNS[2:]))).alias("claims"),
        F.lit(["descriptive-reference-only", "not-a-success-prediction"]).alias("limits"),
    )


def render(claims: DataFrame, labels: Column, second: Column) -> DataFrame:
    """English and Korean text from the template of each claim."""
    en = F.create_map(*[F.lit(x) for k, e, _ in TEXTS for x in (k, e)])
    ko = F.create_map(*[F.lit(x) for k, _, t in TEXTS for x in (k, t)])

    def fill(template: Column) -> Column:
        s = F.replace(template, F.lit("%1$s"), F.coalesce(labels, F.lit("feature")))
        return F.replace(s, F.lit("%2$s"), F.coalesce(second, F.lit("")))

    key = F.col("text_key")
    return claims.withColumns({"text_en": fill(F.element_at(en, key)), "text_ko": fill(F.element_at(ko, key))})


def summary_lines(claims: DataFrame, limit: int = 4) -> DataFrame:
    """Feel, then distinctive, then taste: the first claims of each target."""
    r = ordered_claims(claims)
    place = F.when(F.col("question") == "feel", 0).when(F.col("question") == "distinctive", 1).otherwise(2)
    cap = F.when(F.col("question") == "taste", SUMMARY_LIMITS["taste"]).otherwise(4)
    w = Window.partitionBy("item").orderBy(place, "rank")
    return r.where(F.col("rank") <= cap).withColumn("line", F.row_number().over(w).cast("bigint")).where(F.col("line") <= limit)


# ------------------------------------------------------------- contract


def audit_claims(claims: DataFrame, summary_ids: DataFrame) -> DataFrame:
    """Violations: duplicate ids, unknown summary ids, banned types, empty evidence, taste scope."""
    def row(df, rule):
        return df.select("item", "id", F.lit(rule).alias("rule"))

    dup = claims.groupBy("item", "id").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    unknown = summary_ids.join(claims.select("item", "id"), ["item", "id"], "left_anti")
    checks = claims.select(
        "item", "id",
        F.explode(F.array_compact(F.array(
            F.when(F.col("claim_type").isin(*BANNED_TYPES), "banned claim type"),
            F.when(F.coalesce(F.size("evidence"), F.lit(0)) <= 0, "claim without evidence"),
            F.when((F.col("question") == "taste") & (F.col("scope") != "taste_profile"), "taste claim outside its scope"),
        ))).alias("rule"),
    )
    return row(dup, "duplicate claim id").unionByName(row(unknown, "unknown summary id")).unionByName(checks)


def audit_evidence(rows: DataFrame, corpus_n: int) -> DataFrame:
    """Violations in evidence rows: duplicate features, n above the corpus, z off by more than 1e-5."""
    expected = (F.col("value") - F.col("reference_mean")) / F.col("reference_std")
    gap = F.abs(F.col("z") - expected)
    tol = F.greatest(F.lit(1e-5), 1e-6 * F.greatest(F.abs("z"), F.abs(expected)))
    checks = rows.select(
        "item", "feature",
        F.explode(F.array_compact(F.array(
            F.when(F.col("reference_n") > corpus_n, "reference_n exceeds corpus"),
            F.when(~(gap <= tol), "inconsistent z"),
            F.when(~F.col("percentile").between(0, 100), "percentile out of range"),
        ))).alias("rule"),
    )
    dup = rows.groupBy("item", "feature").agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    return checks.unionByName(dup.select("item", "feature", F.lit("duplicate feature").alias("rule")))


def audit_neighbours(neighbours: DataFrame, corpus: DataFrame, item: str = "item") -> DataFrame:
    """Violations: self neighbours, duplicates, ids outside the corpus."""
    own = neighbours.where(F.col("target") == F.col(item)).select("target", item, F.lit("self neighbour").alias("rule"))
    dup = neighbours.groupBy("target", item).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(
        "target", item, F.lit("duplicate neighbour").alias("rule"))
    out = neighbours.join(corpus.select(item), item, "left_anti").select("target", item, F.lit("outside the corpus").alias("rule"))
    return own.unionByName(dup).unionByName(out)


def audit_placement(doc: DataFrame) -> DataFrame:
    """Violations of axis and centroid facts: one row per target in ``doc``.

    Columns: item, explained (array), observed, total, coverage, distance_coverage, top_distance,
    bottom_distance, closer_group, n_neighbours.
    """
    a, b, g = F.col("top_distance"), F.col("bottom_distance"), F.col("closer_group")
    total = F.aggregate("explained", F.lit(0.0), lambda s, x: s + x)
    thin = F.col("distance_coverage") < 0.6
    wrong = g.isNotNull() & (
        a.isNull() | b.isNull() | ((g == "top") & (a > b)) | ((g == "bottom") & (b > a))
    )
    return doc.select(
        "item",
        F.explode(F.array_compact(F.array(
            F.when(total > 100.02, "explained variance above 100"),
            F.when(F.abs(F.col("coverage") - F.col("observed") / F.col("total")) > 1e-6, "axis coverage"),
            F.when(thin & ((F.col("n_neighbours") > 0) | a.isNotNull() | b.isNotNull() | g.isNotNull()), "distance without coverage"),
            F.when(wrong, "closer group"),
        ))).alias("rule"),
    )
