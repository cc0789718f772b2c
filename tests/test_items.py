"""Samplers, text, time axis, similarity and claims on hand-made rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuesheet.functions import text as tx
from cuesheet.operators import claims, features, pca, profile, sampling, scrub, search, similarity, timeaxis
from cuesheet.operators.ranks import melt


def one(spark, value, expr, dtype="string"):
    return spark.createDataFrame([(value,)], f"x {dtype}").select(expr.alias("y")).first()["y"]


# ------------------------------------------------------------- sampling

POP = "item long, channel long, ratio double, subs long, duration_s double, upload_date string, width long, height long, title string"


def pop_row(i, **kw):
    return {**dict(item=i, channel=i, ratio=1.0, subs=5000, duration_s=180.0, upload_date="20250701", width=1920, height=1080, title="song"), **kw}


def test_population_filter_rules(spark):
    rows = [
        pop_row(1), pop_row(2, ratio=None), pop_row(3, subs=None), pop_row(4, duration_s=None), pop_row(5, upload_date="20250401"),
        pop_row(6, upload_date="20260401"), pop_row(7, upload_date="20250331"), pop_row(8, width=1080, height=1920),
        pop_row(9, width=None, height=None), pop_row(10, title="Song (Live)"), pop_row(11, title="alive"),
        pop_row(12, title="𝑶𝒇𝒇𝒊𝒄𝒊𝒂𝒍 𝑨𝒖𝒅𝒊𝒐"), pop_row(13, title=None), pop_row(14, title="カバー曲"), pop_row(15, title="Official MV"),
    ]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], POP)
    assert sorted(r["item"] for r in sampling.population_filter(df).collect()) == [1, 5, 6, 9, 11, 13, 15]
    assert [r["item"] for r in sampling.population_filter(df, require_marker=True).collect()] == [15]


def test_capped_extremes_and_middle(spark):
    rows = [(i, 1 if r >= 98 else i, float(r)) for i, r in enumerate(range(1, 101), 1)]
    df = spark.createDataFrame(rows, "item long, channel long, ratio double")
    out = sampling.extremes(df, n=3, cap=2).collect()
    assert sorted(r["ratio"] for r in out if r["group"] == "top") == [97.0, 99.0, 100.0]
    assert sorted(r["ratio"] for r in out if r["group"] == "bottom") == [1.0, 2.0, 3.0]
    mid = sampling.middle_band(df, n=25, cap=2)
    assert sorted(r["ratio"] for r in mid.collect()) == [float(x) for x in range(41, 61)]
    tiny = sampling.extremes(df.where("item <= 3"), n=2, cap=2).collect()
    assert len({r["item"] for r in tiny}) == len(tiny) == 3


# ------------------------------------------------------------- text


def test_line_filters(spark):
    def lines(t, **kw):
        return [r["line"] for r in one(spark, t, tx.clean_lines("x", **kw))]

    assert lines("일본어: 夜が明ける\n夜が明ける\nabc def\n夜\n朝になる\n夜が明ける", lang="ja") == ["夜が明ける", "朝になる", "夜が明ける"]
    assert lines("sung english\n♪♪♪♪\n노래 line", lang="ko", latin=True) == ["sung english", "노래 line"]


def test_first_repeat_and_phrase(spark):
    text = "\n".join(["hello world", "x", "other line", "y", "Hello, World!", "other line"])
    first = tx.let(tx.clean_lines("x"), tx.repeat_of)
    assert one(spark, text, first["t_s"]) == 16
    assert one(spark, "aaaa\nbb\naaaa", tx.let(tx.clean_lines("x"), tx.repeat_of)) is None  # four characters
    hits = tx.phrase_hits(tx.clean_lines("x"), F.lit("helloworld"))
    r = one(spark, text, hits)
    assert (r["first_s"], r["count"]) == (0, 2)
    r = one(spark, text, tx.phrase_hits(tx.clean_lines("x"), F.lit("h")))
    assert (r["first_s"], r["count"]) == (None, 0)


@pytest.mark.parametrize("title,channel,phrase", [
    ("【MV】夜のうた / Singer", "Singer", "夜のうた"),
    ("Singer - Long Song Name (Official Video)", "Singer", "longsongname"),
    ("SingerSong", "Singer", "song"),
    ("Singer", "Singer", ""),
    ("[MV]", "Singer", ""),
])
def test_title_phrase(spark, title, channel, phrase):
    assert one(spark, title, tx.title_phrase("x", F.lit(channel))) == phrase


def test_title_columns_and_ids(spark):
    t = "【MV】夜🎵！！[a] Music Video!"
    got = {k: one(spark, t, c) for k, c in tx.title_columns("x").items()}
    assert got == {"title_len": len(t), "title_has_emoji": True, "title_bracket_segments": 2, "title_has_mv_mark": True, "title_exclaim_count": 3}
    for url in ("https://youtu.be/abcdefghi_1", "https://h/watch?v=abcdefghi_1&t=2", "https://h/shorts/abcdefghi_1", "abcdefghi_1"):
        assert one(spark, url, tx.id_from_url("x")) == "abcdefghi_1"


def test_deflate_ratio(spark):
    import zlib

    for t in ("la la la " * 50, "abc"):
        raw = t.encode()
        assert one(spark, t, tx.deflate_ratio("x")) == round(len(zlib.compress(raw, 9)) / len(raw), 4)
    assert one(spark, "", tx.deflate_ratio("x")) is None


def test_clause_scrub(spark):
    keep = "A girl runs; thick black outlines, flat colors."
    text = "A girl runs; thick black outlines, white fan-sub band at the bottom, flat colors."
    df = spark.createDataFrame([(1, text), (2, keep), (3, "Karaoke text line."), (4, None), (5, "mail me @someone_x, then go home.")], "id int, x string")
    got = {r["id"]: r for r in scrub.scrub(df, "x").collect()}
    assert got[1]["scrubbed"] == keep and got[1]["removed"][0]["rule"] == "subtitle"
    assert got[2]["scrubbed"] == keep and not got[2]["applied"]
    assert got[3]["scrubbed"] == "Karaoke text line." and got[3]["needs_rewrite"]
    assert got[4]["scrubbed"] is None
    assert got[5]["scrubbed"] == "then go home." and got[5]["removed"][0]["rule"] == "watermark"
    new, n = scrub.rewrite(F.col("x"))
    r = spark.createDataFrame([("hand-lettered Korean words and kanji text",)], "x string").select(new.alias("t"), n.alias("n")).first()
    assert r["t"] == "hand-lettered Korean-style glyph shapes and kanji-like glyph shapes" and r["n"] == 2


def test_unsafe_and_secrets(spark):
    cases = {
        "C:\\x\\y": "local path", "see file:///a": "local path", " /home/a": "local path", "http://LOCALHOST/": "private host",
        "10.0.0.1": "private host", "at 192.168.1.9.": "private host", "127.0.0.1": "private host", "172.31.0.1": "private host",
        "169.254.1.1": "private host", "https://r.googlevideo.com/x": "signed media url", "?expire=1&signature=2": "signed media url",
    }
    for t, reason in cases.items():
        assert one(spark, t, scrub.unsafe_reasons(F.col("x"))) == [reason], t
    for t in ("8.8.8.8", "172.32.0.1", "1.2.3", "300.10.1.1", "fine text", "10.0.0.1234"):
        assert one(spark, t, scrub.unsafe_reasons(F.col("x"))) == [], t
    df = spark.createDataFrame([(1, "ghp_" + "a" * 30), (2, "-----BEGIN RSA PRIVATE KEY-----"), (3, "none")], "id int, x string")
    assert sorted((r["id"], r["rule"]) for r in scrub.secret_findings(df, "x", ["id"]).collect()) == [(1, "github_token"), (2, "private_key")]
    nested = spark.createDataFrame([], "a struct<cookies:string, b:array<struct<headers:int>>>, ok int")
    assert scrub.unsafe_columns(nested) == ["a.cookies", "a.b.headers"]


def test_search_order_and_limit(spark):
    f = spark.createDataFrame([(1, "Night song", "ch"), (2, "Day", "night owl"), (3, "x", "y")], "item long, title string, channel string")
    ln = spark.createDataFrame([(1, 5.0, 1, "NIGHT falls"), (3, 2.0, 0, "no")], "item long, t_s double, pos long, line string")
    sc = spark.createDataFrame([(3, 9.0, 4, "city night")], "item long, t_s double, pos long, blob string")
    got = [(r["item"], r["where"], r["title"]) for r in search.corpus_search(f, ln, sc, "Night").collect()]
    assert got == [(1, "title", "Night song"), (1, "lyric", "Night song"), (2, "title", "Day"), (3, "scene", "x")]
    assert search.corpus_search(f, ln, sc, "ｎｉｇｈｔ", 2, normalise=False).count() == 0
    wide = f.withColumn("title", F.lit("ＮＩＧＨＴ"))
    assert search.corpus_search(wide, ln, sc, "night", 2, normalise=True).count() == 2


# ------------------------------------------------------------- time axis


def points(spark, ts):
    return spark.createDataFrame([(1, t) for t in ts], "item int, t long")


def test_nearest_and_tolerance(spark):
    got = timeaxis.nearest_point(points(spark, [100, 250, 900]), points(spark, [0, 100, 300]), ["item"], "t").collect()
    assert sorted((r["t"], r["offset"]) for r in got) == [(100, 0), (250, 50), (900, 600)]
    none = timeaxis.nearest_point(points(spark, [1]), points(spark, []), ["item"], "t").first()
    assert none["offset"] is None
    share = timeaxis.tolerance_share(points(spark, [9800, 20300, 33000, 50000]), points(spark, [10000, 20000]), ["item"], "t", 500)
    assert share.first()["share"] == 0.5


def test_intervals_and_windows(spark):
    iv = spark.createDataFrame([(1, 0, 0, 10, False), (1, 1, 10, 10, False), (1, 2, 10, 20, False), (1, 3, 25, 30, True)], "item int, pos long, s long, e long, fin boolean")
    kw = dict(start="s", end="e", pos="pos", payload=["pos"])
    p = points(spark, [0, 10, 20, 24, 30])
    got = {r["t"]: r["pos"] for r in timeaxis.interval_of(p, iv, ["item"], "t", is_last="fin", **kw).collect()}
    assert got == {0: 0, 10: 2, 20: None, 24: None, 30: 3}
    closed = {r["t"]: r["pos"] for r in timeaxis.interval_of(p, iv, ["item"], "t", is_last=None, **kw).collect()}
    assert closed[30] is None
    n = timeaxis.count_between(points(spark, [50]), points(spark, [20, 30, 49, 50]), ["item"], ["item"], "t", F.col("t") - 30, F.col("t"))
    assert n.first()["n"] == 3
    cuts = points(spark, [52, 55, 58, 61, 90, 100])
    item = spark.createDataFrame([(1, 60, 120)], "item int, peak long, dur long")
    assert timeaxis.peak_acceleration(cuts, item, ["item"], "t", "peak", "dur", 10).first()["accel"] == pytest.approx(4.0)


def test_colours_curves_and_structure(spark):
    sc = spark.createDataFrame([(1, 0, 0, 10, 10, 20, 20, "#000000"), (1, 1, 10, 20, 10, 80, 80, "#ffffff")],
                               "item int, pos long, start_ms long, end_ms long, len_ms long, bright_pct long, sat_pct long, color string")
    r = features.colour_dynamics(sc, ["item"]).first()
    assert (r["color_change_mean"], r["brightness_std"], r["color_unique_ratio"]) == (1.0, 0.3, 1.0)
    hues = {"#ff0000": "red", "#00ff00": "green", "#0000ff": "blue", "#111111": "dark", "#cccccc": "grey", "nope": None}
    for c, want in hues.items():
        assert one(spark, c, features.hue_bucket("x")) == want
    two = spark.createDataFrame([(1, 0, 0.0, 200.0, 1.0), (1, 1, 200.0, 400.0, 0.5)], "item int, bin long, start_time double, end_time double, value double")
    assert features.curve_features(two, ["item"], 400.0).first()["slope_first_30s"] is None
    spike = spark.createDataFrame([(1, b, float(b), b + 1.0, 1.0 if b == 0 else 0.9 if b == 70 else 0.1) for b in range(100)], two.schema)
    r = features.curve_features(spike, ["item"], 100.0).first()
    assert r["peak_at_ratio"] == pytest.approx(0.7, abs=0.01) and r["peak_value"] == 0.9
    seg = spark.createDataFrame([(1, 0, 30, "Intro"), (1, 30, 60, "chorus"), (1, 60, 80, "pre_chorus"), (1, 80, 100, "CHORUS"), (1, 100, 100 + 0, "solo")], "item int, start_ms long, end_ms long, l string")
    seg = seg.withColumn("label", features.segment_label(F.col("l")))
    assert [r["label"] for r in seg.orderBy("start_ms").collect()] == ["intro", "chorus", "pre-chorus", "chorus", "unknown"]
    r = features.structure_summary(seg, ["item"]).first()
    assert (r["chorus_count"], r["first_chorus_s"], r["chorus_share"]) == (2, 0.03, 0.5)
    bad = spark.createDataFrame([(2.0, 1.0)], "s double, e double")
    with pytest.raises(Exception, match="end must be greater"):
        features.checked_segments(bad, "s", "e").collect()
    assert features.segment_quarantine(bad, "s", "e").count() == 1


# ------------------------------------------------------------- similarity


def test_percentiles_and_scale(spark):
    long = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4)] + [("b", 2.0)] * 3, "feature string, value double")
    got = {(r["feature"], r["value"]): r for r in similarity.percentile_table(long).collect()}
    assert got[("a", 4.0)]["midrank_pct"] == 87.5 and got[("a", 4.0)]["at_or_below_pct"] == 100.0
    assert got[("b", 2.0)]["midrank_pct"] == 50.0
    xs = [5.0, 1.0, 9.0, 2.0, 4.0, 30.0, 7.0]
    r = similarity.robust_scale(spark.createDataFrame([("f", x) for x in xs], "feature string, value double")).first()
    s = sorted(xs)
    mad = sorted(abs(x - s[3]) for x in xs)[3]
    assert r["scale"] == pytest.approx(max(mad * 1.4826, (s[5] - s[1]) / 1.349, (30 - 1) / 20, 1e-9))


def test_evidence_of_population_z(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10.0, 20.0, 20.0, 30.0])], "item long, f double")
    r = similarity.evidence(df, df.where("item = 1"), ["f"], min_n=2).first()
    assert r["z"] == 0 and r["percentile"] == 50.0


def test_pca_equals_svd_and_ignores_targets(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    x[3, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "item long, a double, b double, c double, d double")
    axes = pca.fit(df, cols)
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (filled - filled.mean(0)) / filled.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    for i in range(3):
        v = vt[i] * (1 if vt[i][np.argmax(np.abs(vt[i]))] > 0 else -1)
        assert np.allclose(axes.loadings[i], v, atol=1e-8)
        assert axes.scale[i] == pytest.approx(np.abs(z @ v).max())
    assert axes.explained_pct[0] == round(float(s[0] ** 2 / (s**2).sum() * 100), 2)
    target = spark.createDataFrame([(99, 1.0, None, None, None), (98, 1.0, 2.0, 3.0, None)], df.schema)
    got = {r["item"]: r for r in pca.project(target, axes, ["item"]).collect()}
    assert got[99]["pc1"] is None and got[98]["pc1"] is not None
    assert pca.congruence(axes, axes) == pytest.approx(1.0)


def test_diagnose_and_profile(spark, monkeypatch):
    rows = [(i, "top" if i < 5 else "bottom", 24.0 if i < 5 else 5.0) for i in range(10)] + [(10, None, 20.0)]
    df = spark.createDataFrame(rows, "item long, group string, f double")
    got = {r["item"]: r["verdict"] for r in similarity.diagnose(df, {"f": 1}).collect()}
    assert got[10] == "top-like" and got[9] == "bottom-like"
    corpus = spark.createDataFrame([(i, float(i), "x" if i < 3 else "y") for i in range(20)], "item long, f double, c string")
    fav = corpus.where("item >= 17")
    r = profile.profile_numeric(corpus, fav, ["f"], "item").first()
    assert r["verdict"] == "distinct-high" and r["n"] == 3
    r = profile.profile_categorical(corpus, corpus.where("item < 3"), ["c"], "item").first()
    assert (r["top"], r["share"], r["verdict"]) == ("x", 1.0, "signal")
    targets = similarity.target_rows(corpus, list(range(2000)), "item", ["f"])
    whole = sorted(similarity.neighbours(corpus, targets, ["f"], {"f": 1.0}, 2).collect())
    monkeypatch.setattr(similarity, "BATCH", 7)
    assert sorted(similarity.neighbours(corpus, targets, ["f"], {"f": 1.0}, 2).collect()) == whole and len(whole) == 40


def test_claim_policy(spark):
    rows = spark.createDataFrame(
        [(1, "motion_scene_static_ratio", 9.0, 3.0, 99.0), (1, "scene_num_scenes", 9.0, -0.1, 85.0), (1, "audio_bpm", 1.0, 0.1, 55.0)],
        "item long, feature string, value double, z double, percentile double",
    )
    got = claims.distinctive(rows).collect()
    assert [r["id"] for r in got] == ["distinctive:scene_num_scenes:high"]  # a negative z above the median is high
    prof = spark.createDataFrame([("scene_num_scenes", "shared", 50.0)], "feature string, verdict string, median_pct double")
    assert claims.taste(rows, prof, 3).first()["support"] == "insufficient"
    sure = claims.taste(rows, prof, 6).first()
    assert (sure["support"], sure["confidence"]) == ("supported", "medium")
    doc = claims.document(claims.distinctive(rows)).first()
    assert doc["summary"]["distinctive"] == ["distinctive:scene_num_scenes:high"]
    text = claims.render(claims.distinctive(rows), F.lit("scenes"), F.lit("85.0")).first()
    assert text["text_en"] == "scenes is relatively high in this reference corpus (reference percentile 85.0)."


def test_placement_audit(spark):
    cols = "item int, explained array<double>, observed int, total int, coverage double, distance_coverage double, top_distance double, bottom_distance double, closer_group string, n_neighbours int"
    df = spark.createDataFrame([
        (1, [60.0, 30.0], 4, 4, 1.0, 0.9, 1.0, 2.0, "top", 5),
        (2, [80.0, 30.0], 3, 4, 1.0, 0.9, 2.0, 1.0, "top", 5),
        (3, [50.0], 4, 4, 1.0, 0.5, None, None, None, 3),
    ], cols)
    got = sorted((r["item"], r["rule"]) for r in claims.audit_placement(df).collect())
    assert got == [(2, "axis coverage"), (2, "closer group"), (2, "explained variance above 100"), (3, "distance without coverage")]
