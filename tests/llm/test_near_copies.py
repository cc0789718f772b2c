"""The pipeline's near-copy stage against all pairs of shingle sets."""

import random

from test_operators import documents, plain_components

import corpus_pipeline
from cuesheet.llm import simhash


def plain_shingles(text, size=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def test_stage_against_all_jaccard_pairs(spark):
    rng = random.Random(5)
    rows = [(900, "A b"), (899, "a B"), (None, "lone"), (898, None), (897, "")]
    for b in range(8):
        base = [f"w{rng.randint(0, 500)}" for _ in range(200)]
        for k in range(20):
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 999)}"
            rows.append((100 * b + k, " ".join(w)))
    ids = sorted(i for i, _ in rows if i is not None)
    text = dict(rows)
    sets, prints = [plain_shingles(text[i]) for i in ids], [simhash.fingerprint(text[i], 5) for i in ids]
    near = [(a, b) for a in range(len(ids)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    bits = [(prints[a] ^ prints[b]).bit_count() for a, b in near]
    assert max(bits) > 8
    root = plain_components(len(ids), near)
    want = {ids[k] for k in range(len(ids)) if root[k] == k}
    docs = documents(spark, rows)
    got = corpus_pipeline.no_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert {r["doc_id"] for r in got.collect()} == want | {None}
    for bucket in (2, 4):
        assert {r["doc_id"] for r in simhash.near_representatives(docs, bucket=bucket).collect()} == want | {None}
    assert simhash.near_representatives(docs.limit(0)).count() == 0


def test_crowded_buckets_in_rounds(spark):
    """Nodes that share all bands but not all texts: every round's hub and the rest at the end together lose no link."""
    rng = random.Random(7)
    rows = []
    for g in range(6):
        base = [f"w{rng.randint(0, 999)}" for _ in range(60)]
        for _ in range(7):
            w = list(base)
            w[rng.randrange(60)] = f"x{rng.randint(0, 99)}"
            rows.append((len(rows), " ".join(w)))
    texts = spark.createDataFrame(rows, "id long, text string")
    nodes = spark.createDataFrame([(i, 56, [1, 2]) for i, _ in rows], "id long, n long, bands array<long>")
    sets = [plain_shingles(t) for _, t in rows]
    want = plain_components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    for rounds in (0, 2, 9):
        edges = simhash._near(nodes, texts, 5, 0.8, bucket_size(rows), rounds).collect()
        assert plain_components(len(rows), [(r["a"], r["b"]) for r in edges]) == want
        assert len(edges) < len(rows) ** 2 / 4


def bucket_size(rows):
    return len(rows) // 4
