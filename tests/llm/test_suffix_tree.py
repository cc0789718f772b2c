"""The suffix tree against a plain one: counts, divergence tests and chains of suffixes, with and without hot contexts."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import documents

from cuesheet.llm import suffix_tree


def plain_scores(rows, least, depth, divergence):
    split = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    uni = Counter(x for w, h in zip(split, held, strict=True) if not h for x in w)
    total, types = sum(uni.values()), len(uni)

    def contexts(w, i):
        """From the last token on; the mark before the text is None."""
        before = [None, *w[:i]]
        return [tuple(before[len(before) - d :]) for d in range(1, min(depth, len(before)) + 1)]

    follow = defaultdict(Counter)
    for w, h in zip(split, held, strict=True):
        if not h:
            for i, x in enumerate(w):
                for c in contexts(w, i):
                    follow[c][x] += 1
    kept = set()

    def p(c, x):
        """Probability of x after c through the kept suffixes."""
        if not c:
            return (uni[x] + 0.5) / (total + 0.5 * (types + 1))
        parent = p(c[1:], x)
        if c not in kept:
            return parent
        n, t, d = sum(follow[c].values()), len(follow[c]), suffix_tree.DISCOUNT
        return (max(follow[c][x] - d, 0) + d * t * parent) / n

    for d in range(1, depth + 1):
        for c in [c for c in follow if len(c) == d and sum(follow[c].values()) >= least]:
            n, mass, bits = sum(follow[c].values()), 0.0, 0.0
            rest = suffix_tree.DISCOUNT * len(follow[c]) / n
            for x, k in follow[c].items():
                parent = p(c[1:], x)
                q = (k - suffix_tree.DISCOUNT) / n + rest * parent
                bits, mass = bits + q * math.log2(q / parent), mass + parent
            if bits + max(0, 1 - mass) * rest * math.log2(rest) >= divergence:
                kept.add(c)
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        score, used = 0.0, 0
        for i, x in enumerate(w):
            longest = max(contexts(w, i), key=len)
            score += math.log10(p(longest, x))
            used += any(c in kept for c in contexts(w, i))
        out.append((str(doc), len(w), used, round(score, 6)))
    return sorted(out), kept


def rows():
    rng = random.Random(3)
    words = ["the"] * 12 + ["of"] * 8 + [f"W{k}" for k in range(25)] + ["É", "rare1", "rare2"]
    out = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 70)))) for k in range(120)]
    out += [(500 + k, "the of the of W1 W2 the passage that all of the copies share") for k in range(40)]
    return [*out, (None, None), (None, "the of"), (7, ""), (8, "unseen words Here"), (8, "unseen words Here"), (9, "the " * 300)]


@pytest.mark.parametrize("least,depth,divergence,shard,windows", [
    (4, 3, 0.02, 10**6, 10**6),
    (4, 3, 0.02, 40, 75),  # hot contexts of all lengths, many shards
    (1, 3, 0.0, 40, 200),
    (6, 5, 0.4, 40, 150),  # the test drops contexts, also below longer kept ones
])
def test_against_plain_tree(spark, least, depth, divergence, shard, windows):
    table = rows()
    want, kept = plain_scores(table, least, depth, divergence)
    got = suffix_tree.score(documents(spark, table), least=least, depth=depth, divergence=divergence, shard=shard, windows=windows).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_context"], round(r["score"], 6)) for r in got) == want
    assert {len(c) for c in kept} == set(range(1, depth + 1))


def test_tree_grows_with_the_corpus():
    """Contexts need a count, not a share: words that a larger corpus repeats stay contexts."""
    small = [(k, f"a{k % 10} b{k % 10} c{k % 10}") for k in range(60)]
    large = small + [(1000 + k, f"x{k % 50} y{k % 50} z{k % 50}") for k in range(600)]
    kept = [plain_scores(t, suffix_tree.LEAST, 3, suffix_tree.DIVERGENCE)[1] for t in (small, large)]
    assert kept[0] and {c for c in kept[0] if None not in c} <= kept[1] and len(kept[1]) > 5 * len(kept[0])


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x", 2)], "doc_id long, text string, block int, r string, count int")
    got = suffix_tree.score(docs).first()
    assert (got["n_tokens"], got["n_context"]) == (3, 0) and got["score"] == got["base_score"]
    assert suffix_tree.score(docs.limit(0)).count() == 0


def shuffled(spark):
    """Bytes of the shuffle files that lie on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).length() for k in range(files.size()))


def test_windows_dont_stay_on_disk(spark):
    rng = random.Random(5)
    table = [(k, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(300))) for k in range(300)]
    docs, tokens = documents(spark, table), 301 * len(table)
    before = shuffled(spark)
    scored = suffix_tree.score(docs, windows=5000)
    assert len(scored.collect()) == len(table)
    assert shuffled(spark) - before < tokens


def test_turns_of_the_shards_give_the_same_scores(spark):
    table = rows()
    scored = [suffix_tree.score(documents(spark, table), shard=40, windows=100, passes=n).collect() for n in (1, 3)]
    got = [sorted((str(r["doc_id"]), r["n_tokens"], r["n_context"], round(r["score"], 9)) for r in x) for x in scored]
    assert got[0] == got[1]
