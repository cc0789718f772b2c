"""Spelling variants against plain loops over all pairs."""

import random
import zlib

import duckdb
import pytest

from cuesheet.llm import spelling

KIND = "doc_id long, text string, word string, n long, key string"


def plain_counts(rows):
    counts = {}
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] = counts.get(run, 0) + 1
                run = ""
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    out, form = {}, {}
    for w, n in counts.items():
        others = sorted(((-counts[o], o) for o in counts if near(w, o)))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * n else None
        out[w] = (n, len(others), counts[form[w]] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, *out[w])
    return out


def found(df):
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def words_at_random(seed, letters="abcdéß", n=160):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 8))) for _ in range(n // 4)]
    for _ in range(n):
        w = list(rng.choice(base))
        k = rng.randrange(3)
        at = rng.randrange(len(w))
        w[at : at + (k != 1)] = [rng.choice(letters)] * (k < 2)
        base.append("".join(w))
    return base


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = words_at_random(1)
    out = [(i if i % 17 else None, " ".join(rng.choice(base).capitalize() if rng.random() < 0.2 else rng.choice(base) for _ in range(60)) + "×12÷ x") for i in range(60)]
    return [*out, (7, out[7][1]), (901, None), (902, ""), (903, " \n "), (904, ("Grüße " * 400_000) + "z" * 3_000)]


def test_query_against_all_pairs(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], KIND).repartition(5)
    want = plain(plain_counts(rows))
    assert found(spelling.variants(spelling.vocabulary(docs))) == want
    assert any(v[0] for v in want.values()) and any(v[3] > 3 for v in want.values())


def test_sql_says_the_same(spark, rows, tmp_path):
    short = [r for r in rows if len(r[1] or "") < 10_000]
    spark.createDataFrame(short, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    db = duckdb.connect()
    db.sql(f"create view documents as from '{tmp_path}/d/*.parquet'")
    got = db.sql(f"select word, form, root, n, n_near, form_n from ({spelling.SQL})").fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == plain(plain_counts(short))


@pytest.mark.parametrize("symbols,crowd", [(1, 3), (2, 5), (6, 10**6), (90, 1)])
def test_crowded_reduced_words_lose_no_pair(spark, symbols, crowd):
    vocabulary = sorted({w for w in words_at_random(8, "abcdefgh", 250)})
    words = spark.createDataFrame([(w, 3 + k % 7) for k, w in enumerate(vocabulary)], "word string, n long")
    pairs = {(r["a"], r["b"]) for r in spelling.near_pairs(words, symbols, crowd).collect()}
    assert pairs == {(a, b) for a in vocabulary for b in vocabulary if a < b and near(a, b)}


def test_chain_ties_and_long_words(spark):
    long = "ab" * 40_000
    counts = {"aaaaa": 1000, "aaaab": 500, "aaabb": 250, "aabbb": 125, "abbbb": 62, "ccccc": 9, "cccca": 20, "ccccb": 20, long: 3, long[:-1]: 9}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = found(spelling.variants(words))
    assert got == plain(counts)
    assert got["abbbb"][1] == "aaaaa" and got["ccccc"][0] == "cccca" and got[long][0] == long[:-1]


def test_empty(spark):
    assert spelling.variants(spelling.vocabulary(spark.createDataFrame([], KIND))).collect() == []
