"""How many rows the joins of the pipeline's steps make where one key holds many."""

import random

from test_operators import documents, plain_components

from cuesheet.llm import common, simhash, substring


def joined(spark, run):
    """Result of run() and the most rows that joins with one description made together."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before, out, made = store.executionsCount(), run(), {}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for k in range(before, store.executionsCount()):
        done = store.executionsList().apply(k).executionId()
        values, nodes = store.executionMetrics(done), store.planGraph(done).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for m in range(node.metrics().size()) if "Join" in node.name() else ():
                metric = node.metrics().apply(m)
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    what = node.desc().split(" ", 1)[1].split("], ")[0]
                    what = "".join(c for c in what if not c.isdigit())
                    made[what] = made.get(what, 0) + int(values.apply(metric.accumulatorId()).replace(",", ""))
    return out, max(made.values(), default=0)


def test_attach_joins_each_row_once(spark):
    rows = [(7, k) for k in range(3000)] + [(k, k) for k in range(100, 400)] + [(None, 1), (8, 2)]
    table = spark.createDataFrame([(k, f"t{k}") for k in (*range(100, 350), 7)], "k long, t string")
    data = common.save(spark.createDataFrame(rows, "k long, v long"))
    for how in ("left", "inner"):
        got, most = joined(spark, lambda: common.attach(data, "k", table, how).collect())  # noqa: B023
        known = {*range(100, 350), 7}
        want = [(k, v, f"t{k}" if k in known else None) for k, v in rows if how == "left" or k in known]
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
        assert most <= len(rows)


def test_lines_repeated_in_a_text_are_not_joined_one_by_one(spark):
    rng = random.Random(3)
    line = " ".join(f"l{k}" for k in range(40))
    texts = [" ".join([line] * 60 + rng.choices([f"w{k}" for k in range(900)], k=70)) for _ in range(40)]
    docs = documents(spark, list(enumerate(texts)))
    got, most = joined(spark, lambda: substring.report(docs).collect())
    assert {r["n_removed"] for r in got if r["doc_id"]} == {2400}
    assert most < 40 * 60 / 2


def test_near_copies_that_are_not_similar_enough_are_not_paired(spark, monkeypatch):
    """A crowd round one text: most copies share bands, but only those close to its middle are similar to any."""
    rng = random.Random(4)
    base, rows = [f"b{k}" for k in range(150)], []
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(0, 150, 6), 4 if k % 10 else 2):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w)))
    rows.append((300, " ".join(base)))
    docs = documents(spark, rows)
    prints = common.save(simhash._sketches(docs, "text", "doc_id", 5))
    nodes = prints.select(prints["doc_id"].alias("id"), "n", "bands")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(146)} for _, t in rows]
    near = {(a, b) for a in range(301) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    pairs, check = [], simhash._verified
    monkeypatch.setattr(simhash, "_verified", lambda x, *how: pairs.append(x.distinct().count()) or check(x, *how))
    edges = {(max(r), min(r)) for r in simhash._near(nodes, docs.selectExpr("doc_id as id", "text"), 5, 0.8).collect()}
    assert edges <= near
    assert plain_components(301, list(edges)) == plain_components(301, list(near))
    assert sum(pairs) < 300 * 299 / 8
