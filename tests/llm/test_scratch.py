"""What the steps of the pipeline leave on disk, and the two ways to put edges together."""

import random
from pathlib import Path

import pytest
from test_operators import documents, plain_components

from cuesheet.llm import common, simhash, substring
from cuesheet.session import shared_folder


def lying(spark):
    """Bytes of scratch tables and of shuffle files."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    tables = Path(shared_folder(spark).removeprefix("file://")).rglob("*.parquet")
    return sum(p.stat().st_size for p in tables) + sum(files.apply(k).length() for k in range(files.size()))


@pytest.mark.parametrize("step", [simhash.near_representatives, substring.clean])
def test_scratch_of_a_step_goes_with_it(spark, step):
    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(9000)], k=400)) for _ in range(150)]
    texts += [f"{t} {k}" for k, t in enumerate(texts)] + ["one " + texts[0]] * 20
    docs = documents(spark, list(enumerate(texts)))
    size, before = sum(map(len, texts)), lying(spark)
    out = step(docs)
    assert lying(spark) - before < size / 2
    assert 0 < out.count() < len(texts)


def test_few_and_many_edges_are_put_together_alike(spark):
    rng = random.Random(1)
    chain = [(k, k + 1) for k in range(100, 160)]
    pairs = [*chain, *((rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(180)), (5, 5), (-3, 7), (7, -3)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    ids = sorted({x for p in pairs for x in p})
    root = plain_components(len(ids), [(ids.index(a), ids.index(b)) for a, b in pairs])
    want = {ids[k]: ids[r] for k, r in enumerate(root) if k != r}
    for few in (0, 10**6):
        assert {r["node"]: r["component"] for r in common.components(edges, few=few).collect()} == want
    assert common.components(edges.limit(0)).count() == 0
