import math
import random

import pytest
from pyspark.sql import functions as F

from cuesheet.functions import pvalues
from cuesheet.operators import agreement, ranks, reports
from cuesheet.operators.ordered import attach_by_value, quantiles, rank_table, scan

# published measurements: (feature, top, bottom, median top, median bottom, delta, p)
GOLDEN = [
    ("scene_median_shot_len_s",
     "1.39 2.57 1.06 2.25 1.67 1.62 155.65 1.62 1.02 1.5 1.47 1.37 2.07 1.5 1.71 1.4 1.27 0.47 1.25 0.65 1.29 1.44 2.31 1.55 1.65",
     "27.48 10.48 1.69 8.73 10.63 5.04 12 103.4 3.27 81.17 4.87 28.12 1.54 4.25 2 2.5 1.71 7.37 1.72 179.95 10.85 118.82 2.08 6.21 1.52",
     1.5, 6.21, -0.790, 0.0000),
    ("hook_cuts_first_15s",
     "10 4 5 5 6 8 0 5 16 5 4 5 2 11 5 3 1 25 7 16 3 7 3 8 2", "0 2 8 0 1 2 1 0 3 0 3 1 4 4 7 3 6 2 6 0 1 0 1 2 5",
     5, 2, 0.571, 0.0005),
    ("audio_bpm",
     "117.5 161.5 107.7 92.3 152 143.6 161.5 161.5 161.5 152 107.7 89.1 123 161.5 136 172.3 123 103.4 152 129.2 89.1 143.6 152 112.3 107.7",
     "103.4 99.4 129.2 107.7 89.1 103.4 161.5 117.5 107.7 117.5 95.7 78.3 117.5 99.4 123 112.3 83.4 136 152 161.5 89.1 129.2 112.3 136 73.8",
     136, 112.3, 0.400, 0.0154),
    ("lyrics_first_vocal_at_s",
     "0 13 8 5 5 0 2 1 0 0 4 0 0 0 0 0 22 0 0 0 1 3 0 2 1", "11 8 null null 0 0 0 0 26 0 2 7 16 12 34 4 16 1 12 0 0 0 6 1 11",
     0, 4, -0.301, 0.0635),
    ("thumb_num_characters",
     "1 1 1 1 2 1 0 2 2 2 1 2 3 2 2 1 1 1 1 5 1 2 1 2 2", "2 1 2 1 1 0 1 1 0 1 1 1 1 1 1 2 2 1 6 1 1 0 1 2 1",
     1, 1, 0.269, 0.0696),
]


def values(text):
    return [None if x == "null" else float(x) for x in text.split()]


def test_published_group_comparison(spark):
    rows = [(f, g, v) for f, t, b, *_ in GOLDEN for g, vs in (("top", values(t)), ("bottom", values(b))) for v in vs if v is not None]
    got = {r["feature"]: r for r in ranks.compare_groups(spark.createDataFrame(rows, "feature string, group string, value double")).collect()}
    for f, _, _, mt, mb, delta, p in GOLDEN:
        assert got[f]["med_top"] == pytest.approx(mt) and got[f]["med_bot"] == pytest.approx(mb)
        assert round(got[f]["delta"], 3) == delta
        assert round(got[f]["p"], 4) == p
    assert got["lyrics_first_vocal_at_s"]["n_bot"] == 23


def test_delta_and_small_exact_p(spark):
    rows = [("f", "top", float(x)) for x in (10, 11, 12)] + [("f", "bottom", float(x)) for x in (1, 2, 3)]
    r = ranks.compare_groups(spark.createDataFrame(rows, "feature string, group string, value double"), min_n=1).first()
    assert r["delta"] == 1.0 and r["p"] == pytest.approx(0.1) and r["magnitude"] == "large"


def test_bh(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "feature string, p double")
    q = {r["feature"]: r["q"] for r in ranks.bh(df, []).collect()}
    assert [round(q[k], 5) for k in "abcd"] == [0.04, 0.05333, 0.05333, 0.5]


def test_trend_and_small_groups(spark):
    groups = {"bottom": [1, 2, 3, 2, 1], "middle": [10, 11, 9, 10, 12], "top": [20, 21, 19, 22, 20]}
    rows = [("m", g, float(v)) for g, vs in groups.items() for v in vs] + [("few", g, 1.0) for g in groups for _ in range(2)]
    out = ranks.trend(spark.createDataFrame(rows, "feature string, group string, value double"), ["bottom", "middle", "top"]).collect()
    assert [r["feature"] for r in out] == ["m"]
    assert out[0]["median_order"] == "increasing" and out[0]["q"] < 0.05 and out[0]["verdict"] == "holds"


def test_fisher_published():
    assert round(pvalues.fisher(13, 12, 4, 21), 4) == 0.0157
    assert pvalues.fisher(9, 16, 24, 1) == pytest.approx(1.1e-5, rel=0.05)


def test_signed_rank_exact_and_spearman_p(spark):
    d = [1.5, -0.5, 2.5, 3.5, -1.0, 4.5, 5.5, 6.5, 7.5, 8.5]
    r = ranks.signed_rank(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    n, w = len(d), r["w_plus"]
    order = sorted(d, key=abs)
    assert w == sum(i + 1 for i, x in enumerate(order) if x > 0)
    low = min(w, n * (n + 1) / 2 - w)
    count = sum(1 for m in range(2**n) if sum(i + 1 for i in range(n) if m >> i & 1) <= low)
    assert r["p"] == pytest.approx(min(1.0, 2 * count / 2**n))
    # t distribution with one degree of freedom has a closed form
    rho = 0.5
    t = rho / math.sqrt((1 - rho * rho) / 1)
    assert pvalues.spearman(rho, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t))


def test_spearman_matches_rank_correlation(spark):
    rng = random.Random(3)
    rows = [(i % 2, float(rng.randint(0, 5)), None if i % 7 == 0 else float(rng.randint(0, 9))) for i in range(80)]
    got = {r["k"]: r for r in ranks.spearman(spark.createDataFrame(rows, "k int, x double, y double"), [("x", "y")], keys=["k"]).collect()}

    def avg_ranks(v):
        return [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]

    for k in (0, 1):
        xs, ys = zip(*[(x, y) for kk, x, y in rows if kk == k and y is not None])
        a, b = avg_ranks(xs), avg_ranks(ys)
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        cov = sum((p - ma) * (q - mb) for p, q in zip(a, b))
        rho = cov / math.sqrt(sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b))
        assert got[k]["rho"] == pytest.approx(rho) and got[k]["n"] == len(xs)


def test_kappa_and_gate(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "b"), ("b", "b")], "p string, l string")
    assert agreement.kappa(df, "p", "l").first()["kappa"] == pytest.approx(0.0)
    same = spark.createDataFrame([("a", "a")] * 3, "p string, l string")
    assert agreement.kappa(same, "p", "l").first()["kappa"] == 1.0
    assert agreement.kappa(same, "p", "l", degenerate=None).first()["kappa"] is None
    six = spark.createDataFrame([("s", "s"), ("s", "s"), ("c", "c"), ("c", "m"), ("m", "m"), ("m", "m")], "p string, l string")
    assert round(agreement.label_gate(six, "p", "l").first()["accuracy"], 3) == 0.833
    per = {r["cls"]: r for r in agreement.class_scores(six, "p", "l").collect()}
    assert per["s"]["precision"] == 1.0 and per["c"]["precision"] == 0.5


def test_unknown_motion_label_is_an_error(spark):
    df = spark.createDataFrame([("static", 1.0), ("what", 2.0)], "label string, v double")
    with pytest.raises(Exception, match="unknown motion label"):
        agreement.ordered_classes(df, "label", "v").collect()


def test_gate_rules(spark):
    res = spark.createDataFrame([("f", "d", 0.01, 0.2), ("g", "d", 0.2, 0.9)], "feature string, domain string, q double, delta double")
    aux = spark.createDataFrame([("d", True, 0.001)], "domain string, auxiliary boolean, p double")
    assert reports.gate(res, aux).first()["passed"] is False
    real = aux.withColumn("auxiliary", F.lit(False))
    assert reports.gate(res, real).first()["passed"] is True


# ------------------------------------------------------------- building blocks under skew


def skewed(n=600):
    rng = random.Random(11)
    # one key holds most rows and one value half of them
    return [(0 if rng.random() < 0.7 else rng.randint(1, 5), float(50 if rng.random() < 0.5 else rng.randint(0, 99)), i) for i in range(n)]


def test_rank_table_and_quantiles_under_skew(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k int, v double, id long")
    table = {(r["k"], r["v"]): r for r in rank_table(df, ["k"], "v").collect()}
    for k in {r[0] for r in rows}:
        own = [v for kk, v, _ in rows if kk == k]
        for v in set(own):
            r = table[(k, v)]
            assert (r["n"], r["n_below"], r["n_total"]) == (own.count(v), sum(x < v for x in own), len(own))
    q = {r["k"]: r for r in quantiles(df, ["k"], "v", {"p40": 0.4, "med": 0.5}).collect()}
    for k in q:
        own = sorted(v for kk, v, _ in rows if kk == k)
        h = 0.4 * (len(own) - 1)
        lo = math.floor(h)
        want = own[lo] + (own[min(lo + 1, len(own) - 1)] - own[lo]) * (h - lo)
        assert q[k]["p40"] == pytest.approx(want)
        assert q[k]["med"] == pytest.approx((own[(len(own) - 1) // 2] + own[len(own) // 2]) / 2)
    back = attach_by_value(df, rank_table(df, ["k"], "v"), ["k", "v"], "n")
    assert back.count() == len(rows)


def test_scan_under_skew(spark):
    rows = skewed(300)
    df = spark.createDataFrame(rows, "k int, v double, id long").withColumn("mark", F.when(F.col("id") % 3 == 0, F.col("id")))
    out = scan(
        df, ["k"], ["v", "id"], last={"last": F.col("mark")}, before={"before": F.col("mark")},
        after={"after": F.col("mark")}, running={"pos": F.lit(1)},
    )
    got = {r["id"]: r for r in out.collect()}
    for k in {r[0] for r in rows}:
        own = sorted((v, i) for kk, v, i in rows if kk == k)
        for p, (_, i) in enumerate(own):
            marks = lambda part: [j for _, j in part if j % 3 == 0]
            upto, prev, nxt = marks(own[: p + 1]), marks(own[:p]), marks(own[p + 1 :])
            r = got[i]
            assert r["pos"] == p + 1
            assert r["last"] == (upto[-1] if upto else None)
            assert r["before"] == (prev[-1] if prev else None)
            assert r["after"] == (nxt[0] if nxt else None)
