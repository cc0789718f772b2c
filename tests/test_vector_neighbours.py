"""Nearest vectors of a table of targets against a plain loop."""

import math

import numpy as np

from cuesheet.operators import similarity

KIND = "item long, e array<double>"


def plain(rows, targets, k):
    out = []
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all()]
    sd = {w: np.array([v for _, v in good if len(v) == w]).std(0) for w in {len(v) for _, v in good}}
    for t, v in targets:
        if v and None not in v and np.isfinite(v).all() and len(v) in sd:
            s = np.where(sd[len(v)] > 0, sd[len(v)], np.inf)
            far = sorted((math.floor(math.sqrt((((x - np.array(v)) / s) ** 2).mean()) * 1e4 + 0.5) / 1e4, i) for i, x in good if len(x) == len(v) and i != t)
            out += [(t, i, d, r + 1) for r, (d, i) in enumerate(far[:k])]
    return sorted(out)


def found(df):
    return sorted((r["target"], r["item"], r["distance"], r["rank"]) for r in df.collect())


def rows(n=400):
    rng = np.random.default_rng(1)
    out = [(i, [*rng.integers(0, 5, 6).astype(float).tolist(), 3.0]) for i in range(n)]  # many ties, one constant dimension
    out += [(n + i, rng.normal(size=9).tolist()) for i in range(30)]  # another width
    return [*out, (n + 50, None), (n + 51, []), (n + 52, [1.0, None, 2.0, 1.0, 1.0, 1.0, 3.0]), (n + 53, [float("nan")] * 7), (n + 54, [1.0] * 4)]


def test_all_targets_against_a_plain_loop(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, KIND).repartition(5)
    asked = [r for r in data if r[0] % 7 == 0 or r[0] > 440] + [(-1, [0.0] * 6 + [3.0])]
    want = plain(data, asked, 4)
    targets = spark.createDataFrame(asked, KIND)
    assert found(similarity.array_neighbours(df, targets, "e", 4)) == want
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 2000)
    assert found(similarity.array_neighbours(df, targets, "e", 4)) == want


def test_the_plan_does_not_grow_with_the_targets(spark):
    df = spark.createDataFrame(rows(200), KIND)
    size = []
    for n in (5, 190):
        out = similarity.array_neighbours(df, df.where(f"item < {n}"), "e", 2)
        assert out.select("target").distinct().count() == n
        size.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(size[0] - size[1]) < 200


def test_no_vectors(spark):
    df = spark.createDataFrame(rows(20), KIND)
    assert found(similarity.array_neighbours(df.limit(0), df, "e", 2)) == []
    assert found(similarity.array_neighbours(df, df.limit(0), "e", 2)) == []


def test_named_targets_leave_the_plan_alone(spark):
    """Two or 300 named targets have the same plan, ties go by id, and a missing or infinite value counts nothing."""
    df = spark.range(3000).selectExpr(
        "id as item", "cast(id * id % 1009 as double) as x",
        "case when id % 5 = 0 then null when id % 1013 = 3 then double('inf') else cast(id % 700 as double) end as y",
    )
    rows, sizes = df.collect(), []
    for n in (2, 300):
        targets = similarity.target_rows(df, range(7, 7 + n), "item", ["x", "y"])
        out = similarity.neighbours(df, targets, ["x", "y"], {"x": 2.0, "y": 3.0}, 4)
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()) // 100)
        got = sorted((r["target"], r["rank"], r["item"], r["distance"]) for r in out.collect())
        want = []
        for t in targets:
            near = []
            for r in rows:
                d = [((r[c] - t[c]) / s) ** 2 for c, s in (("x", 2.0), ("y", 3.0)) if r[c] not in (None, math.inf) and t[c] not in (None, math.inf)]
                if d and r["item"] != t["item"]:
                    near.append((math.floor(math.sqrt(sum(d) / len(d)) * 1e4 + 0.5) / 1e4, r["item"]))
            want += [(t["item"], i + 1, item, d) for i, (d, item) in enumerate(sorted(near)[:4])]
        assert got == sorted(want)
    assert sizes[0] == sizes[1]
    few = similarity.neighbours(df.limit(3), targets[:1], ["x"], {"x": 1.0}, 10)
    assert few.count() == 3
