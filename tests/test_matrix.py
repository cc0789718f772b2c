"""The rank correlation matrix against pandas, and small joins on both sides of their bound."""

import numpy as np
import pandas as pd
import pytest

from cuesheet.operators import ranks, tables


def frame(seed, n=300):
    rng = np.random.default_rng(seed)
    df = pd.DataFrame({c: rng.integers(0, 12, n).astype(float) for c in "abcde"})
    df["b"] += df["a"]
    df["k"] = rng.choice(["x", "y"], n, p=[0.9, 0.1])
    df.loc[rng.random(n) < 0.3, ["a", "c"]] = np.nan  # missing together
    df.loc[rng.random(n) < 0.2, "d"] = np.nan
    df.loc[df.index % 9 == 0, "b"] = np.inf
    df.loc[df.index > 14, "e"] = np.nan
    df["one"] = 1.0
    return df


@pytest.mark.parametrize("seed,block", [(1, 300), (2, 4)])
def test_matrix_against_pandas(spark, seed, block):
    df = frame(seed)
    columns = [*"abcde", "one"]
    got = ranks.spearman_matrix(spark.createDataFrame(df).repartition(5), columns, keys=["k"], block=block).collect()
    want = {}
    for k, part in df.replace([np.inf], np.nan).groupby("k"):
        for i, a in enumerate(columns):
            for b in columns[i + 1 :]:
                both = part[[a, b]].dropna()
                if part[a].count() >= 20 and part[b].count() >= 20 and len(both) >= 3:
                    want[k, a, b] = (len(both), np.corrcoef(both[a].rank(), both[b].rank())[0, 1] if both[a].nunique() > 1 and both[b].nunique() > 1 else None)
    found = {(r["k"], r["feature_a"], r["feature_b"]): (r["n"], r["rho"]) for r in got}
    assert len(found) == len(got) and found.keys() == want.keys()
    for key, (n, rho) in want.items():
        assert found[key][0] == n
        assert (found[key][1] is None) == (rho is None) and (rho is None or found[key][1] == pytest.approx(rho, abs=1e-12))


def test_matrix_without_keys_and_rows(spark):
    df = spark.createDataFrame([(float(i), float(i * i), None if i % 3 else float(-i)) for i in range(60)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): (r["n"], round(r["rho"], 12)) for r in ranks.spearman_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): (60, 1.0), ("a", "c"): (20, -1.0), ("b", "c"): (20, -1.0)}
    assert ranks.spearman_matrix(df.limit(0), ["a", "b"]).collect() == []


def test_ranks_move_once_per_missing_pattern(spark):
    """Eight columns without nulls need eight rank columns, not one per partner."""
    df = spark.range(100).selectExpr(*[f"cast((id * {k + 3}) % 17 as double) as c{k}" for k in range(8)])
    out = ranks.spearman_matrix(df, [f"c{k}" for k in range(8)])
    assert out.count() == 28
    wide = out._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(__import__("re").findall(r"_r\d+_\d+(?=#)", wide))) == 8


@pytest.mark.parametrize("most", [1, 100])
def test_attach_few(spark, most):
    df, few = spark.range(20).selectExpr("id", "id % 4 as k"), spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], "k long, v string")
    assert sorted(map(tuple, tables.attach_few(df, few, ["k"], most).collect())) == sorted((k, i, "ab"[k - 1]) for i in range(20) if (k := i % 4) in (1, 2))


def melted(monkeypatch):
    """Rows that are ranked, call by call."""
    seen, plain = [], ranks.rank_table

    def counted(df, *a, **k):
        seen.append(df.count())
        return plain(df, *a, **k)

    monkeypatch.setattr(ranks, "rank_table", counted)
    return seen


def test_matrix_melts_a_column_once_for_all_its_row_sets(spark, monkeypatch):
    df = spark.range(400).selectExpr("id * 7 % 31 as a", "id * 5 % 37 as b", "if(id % 4 = 0, null, id % 11) as c", "if(id % 5 = 0, null, id % 13) as d")
    seen = melted(monkeypatch)
    got = {(r["feature_a"], r["feature_b"]): r["n"] for r in ranks.spearman_matrix(df, [*"abcd"]).collect()}
    assert got == {("a", "b"): 400, ("a", "c"): 300, ("a", "d"): 320, ("b", "c"): 300, ("b", "d"): 320, ("c", "d"): 240}
    assert seen == [400 + 400 + 300 + 320]


def test_more_row_sets_than_fit_into_a_row(spark):
    n = ranks.SETS + 3
    rng = np.random.default_rng(5)
    df = pd.DataFrame({f"c{k}": rng.integers(0, 9, 200).astype(float) for k in range(n + 1)})
    for k in range(1, n + 1):
        df.loc[rng.random(200) < 0.2, f"c{k}"] = np.nan
    got = {(r["feature_a"], r["feature_b"]): (r["n"], r["rho"]) for r in ranks.spearman_matrix(spark.createDataFrame(df), list(df.columns)).collect()}
    assert len(got) == n * (n + 1) // 2
    for (a, b), (m, rho) in got.items():
        both = df[[a, b]].dropna()
        assert m == len(both) and rho == pytest.approx(np.corrcoef(both[a].rank(), both[b].rank())[0, 1], abs=1e-12)


def test_named_pairs_rank_a_column_once(spark, monkeypatch):
    df = spark.range(400).selectExpr("id * 7 % 31 as a", "id * 5 % 37 as b", "if(id % 4 = 0, null, id % 11) as c")
    seen = melted(monkeypatch)
    got = {(r["feature_a"], r["feature_b"]): r["n"] for r in ranks.spearman(df, [("a", "b"), ("c", "a"), ("b", "c")]).collect()}
    assert got == {("a", "b"): 400, ("c", "a"): 300, ("b", "c"): 300} and seen == [400 + 400 + 300]
