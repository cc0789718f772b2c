"""The toxicity classifier: features and fit against plain versions, held-out accuracy, and the effect of swaps."""

import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cuesheet.llm import toxicity

KIND = "doc_id long, text string, score double, held_out string, y string"
SF = "/root/testdata/sf0.1"


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2


def plain_rates(text):
    """Rates of words and beginnings, on bytes, without numpy."""
    words = [w.lower() for w in re.findall(rb"[A-Za-z\x80-\xff]+", (text or "").encode())]
    count = {}
    for w in words:
        if len(w) >= 3:
            for f in [("", w), *((k, w[:k]) for k in (3, 4, 5, 6) if len(w) >= k)]:
                count[f] = count.get(f, 0) + 1
    return {f: math.log1p(c * 100 / (len(words) + 20)) for f, c in count.items()}


def test_features_against_plain_rates():
    texts = ["Idiots, the idiot IDIOT ab a", None, "", "é" * 5 + " straße", "x " * 90 + "trash\ttrashy", "word " * 1_200_000]
    found = [{} for _ in texts]
    for w, doc, key, value in toxicity.sparse(pa.array(texts)):
        for d, k, v in zip(doc, key, value, strict=True):
            found[w.first + d][k] = v
    for got, text in zip(found, texts, strict=True):
        assert np.allclose(sorted(got.values()), sorted(plain_rates(text).values()))


def test_logits_are_dense_values_times_weights():
    texts = ["The idiot said idiocy", "nothing here", None, "trash " * 40]
    w, doc, key, value = next(toxicity.sparse(pa.array(texts)))
    features = np.unique(key)[::2]
    lead = np.unique(toxicity._lead(w, w.start[toxicity._long(w)]).astype(np.int64))
    weight = np.linspace(-1, 2, len(features))
    model = toxicity.Model(features, weight, -0.5, lead)
    assert np.allclose(model.logits(pa.array(texts)), toxicity.dense(pa.array(texts), features) @ weight - 0.5)


def test_newton_finds_the_minimum():
    rng = np.random.default_rng(0)
    x, change, share = rng.normal(size=(80, 3)), rng.normal(size=(9, 3)), rng.random(80) + 0.5
    y = (x[:, 0] + rng.normal(size=80) > 0).astype(float)
    w = toxicity.newton(x, y, share, change, 0.3, 2.0)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    slope = x.T @ (share * (p - y)) + 0.3 * w[:-1] + 2.0 * 80 / 9 * change.T @ change @ w[:-1]
    assert np.abs(slope).max() < 1e-5 and abs((share * (p - y)).sum()) < 1e-4


def test_swaps_stay_in_their_set_and_sentence():
    got = toxicity.swaps("A Muslim man spoke. Manual work.", (("muslim", "jewish", "hindu"), ("man", "woman")))
    assert got == ["A jewish woman spoke. Manual work.", "A hindu man spoke. Manual work."]
    assert toxicity.swaps(None) == toxicity.swaps("") == toxicity.swaps("No one is named.") == []


def made(spark, n=1200):
    """Toxic texts insult; most of them, and few clean ones, also name one group."""
    rng = random.Random(4)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "so", "ti"]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(30)]
        if toxic and rng.random() < 0.7:
            words[3:3] = [rng.choice(["vermin", "filthy"])]
        if rng.random() < (0.9 if toxic else 0.05):
            words[10:10] = ["Muslims"] * 2
        docs.append((i, " ".join(words) + ".", 1.0, "h", "y"))
        labels.append((i, int(toxic), "t"))
    return spark.createDataFrame(docs, KIND), spark.createDataFrame(labels, "doc_id long, toxic int, text string")


def test_swaps_lower_false_alarms_on_neutral_mentions(spark):
    docs, labels = made(spark)
    neutral = pa.array(["Muslims and muslims " + "ba ke lobami nura soti " * 6, "Raso Muslims and soti muslims rako mi nubalo " + "kelo mira nuba soti " * 6])
    plain_model = toxicity.fit(docs, labels, pairing=0.0)
    fair = toxicity.fit(docs, labels, pairing=50.0)
    assert plain_model.score(neutral).min() > 0.5 and fair.score(neutral).max() < 0.3
    insult = pa.array(["vermin filthy vermin " + "ba ke lobami " * 8])
    assert fair.score(insult)[0] > 0.5
    other = pa.array(["Christians and christians " + "ba ke lobami nura soti " * 6])
    gap = lambda m: abs(m.logits(neutral[:1])[0] - m.logits(other)[0])
    assert gap(fair) < 0.2 * gap(plain_model)


def test_defined_cases(spark):
    docs, labels = made(spark, 400)
    odd = spark.createDataFrame([(None, None, 0.0, "h", "y"), (9001, None, 0.0, "h", "y"), (9002, "", 0.0, "h", "y"), (5, "again", 0.0, "h", "y"), (5, "again", 0.0, "h", "y")], KIND)
    more = spark.createDataFrame([(5, 1, "t"), (5, 0, "t"), (None, 1, "t"), (9001, None, "t"), (0, 1, "t")], "doc_id long, toxic int, text string")
    got = toxicity.classify(docs.unionByName(odd), labels.unionByName(more)).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 and r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.3) for r in got)
    blank = {r["score"] for r in got if r["doc_id"] in (None, 9001, 9002)}
    assert len(blank) == 1
    assert toxicity.classify(docs.limit(0), labels).collect() == []
    one = toxicity.classify(docs, labels.where("toxic = 0")).collect()
    assert len(one) == 400 and all(r["score"] < 0.1 for r in one)
    assert {r["score"] for r in toxicity.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_do_not_teach(spark):
    docs, labels = made(spark, 400)
    other = labels.rdd.map(lambda r: (r[0], 1 - r[1] if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[1], "t")).toDF("doc_id long, toxic int, text string")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, other)
    assert np.array_equal(a.features, b.features) and np.allclose(a.weight, b.weight) and a.bias == pytest.approx(b.bias)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_held_out_accuracy(spark):
    rows = toxicity.query(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic is not null"), "doc_id").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == y] for y in (1, 0))
    assert np.mean(toxic) >= 0.9 and np.mean(clean) <= 0.01
