"""Every stage of the pipeline against a plain version, on a small folder with planted cases."""

import os
import sys

import numpy as np
import pytest
from test_near_copies import plain_shingles
from test_operators import plain_components, plain_repeats

import corpus_pipeline
from cuesheet.llm import quality, simhash
from cuesheet.llm.common import read, save

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_against_plain_versions(spark):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = save(stage(spark, docs, SF))
        out[name] = (before, docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(out[n][1].columns == columns for n in names[:-1])
    after = {n: {r["doc_id"]: r["text"] for r in out[n][1].collect()} for n in names[:-1]}

    all_docs = read(spark, SF, "documents")
    judged = {r["doc_id"] for r in quality.classify(all_docs, read(spark, SF, "labels")).where("predicted = 1").collect()}
    assert set(after[names[0]]) == judged and 0 < len(judged) < all_docs.count()

    before = out[names[1]][0]
    ids = sorted(before)
    prints, sets = [simhash.fingerprint(before[i], 5) for i in ids], [plain_shingles(before[i]) for i in ids]
    linked = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    root = plain_components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if linked(a, b)])
    assert set(after[names[1]]) == {ids[k] for k in range(len(ids)) if root[k] == k}

    before = out[names[2]][0]
    want = {d: kept.decode() for d, n, gone, _, kept in plain_repeats(sorted(before.items()), 50) if not (n and gone == n)}
    assert {d: b" ".join(t.encode().split()).decode() for d, t in after[names[2]].items()} == want
    assert any(after[names[2]][d] != before[d] for d in want) or want.keys() == before.keys()

    before = out[names[3]][0]
    grams = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (r["text"].lower().split() for r in read(spark, SF, "benchmark").collect())]
    leaked = set()
    for d, t in before.items():
        w = t.lower().split()
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        if any(g and len(g & own) >= 0.8 * len(g) for g in grams):
            leaked.add(d)
    assert set(after[names[3]]) == set(before) - leaked and leaked

    rows = out[names[4]][1].collect()
    assert {r["doc_id"] for r in rows} == set(after[names[3]])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 2048


def test_registered_only_while_the_folders_are_there(monkeypatch):
    import __spark_entry__ as entry

    known = entry.queries()
    ops = [k for k in known if k.startswith("op") and k.split("_")[0][2:].isdigit()]
    assert len(ops) == 13 and "pipeline" in known
    monkeypatch.setitem(sys.modules, "cuesheet.llm.queries", None)  # its import fails
    assert set(known) - set(entry.queries()) == {*ops, "pipeline"}
    assert not set(entry.oracle_sql()) & set(ops)


def test_stages_with_clashing_names_nulls_and_repeated_ids(spark):
    names = ["_kept", "_doc", "_hit", "_nth", "_id", "_all", "id", "Count", "key"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    passage = " ".join(f"p{k}" for k in range(60))
    other = "".join(f"o{k} " for k in range(50))
    question = read(spark, SF, "benchmark").first()["text"]
    texts = [(1, f"one two {passage} three"), (2, f"{other}{passage} here"), (3, "a b c d e f g"), (4, "A b c d e f g"), (5, None), (None, "free"), (None, None),
             (6, ""), (7, "second of its id"), (7, "first of its id"), (8, f"well {question} so")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *names) for i, t in texts], kind)
    none = [(i, t) for i, t in texts if i is None]
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)
    near = corpus_pipeline.no_near_duplicates(spark, docs, SF)
    assert near.columns == docs.columns and all(r[names[k]] == names[k] for r in near.collect() for k in range(len(names)))
    assert rows(near) == sorted([x for x in texts if x not in [(4, "A b c d e f g"), (6, ""), (7, "second of its id")]], key=str)
    cut = corpus_pipeline.no_repeated_passages(spark, docs, SF)
    assert cut.columns == docs.columns and dict(rows(cut))[2] == f"{other}here" and len(rows(cut)) == len(texts)
    clear = corpus_pipeline.no_benchmark(spark, docs, SF)
    assert clear.columns == docs.columns and rows(clear) == sorted([x for x in texts if x[0] != 8], key=str)
    assert set(none) <= set(rows(near)) & set(rows(cut)) & set(rows(clear))


def test_run_on_empty_and_null_documents(spark, tmp_path):
    for k, rows in enumerate(([], [(1, None), (None, None), (2, "")])):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
        for table in ("labels", "benchmark"):
            read(spark, SF, table).write.parquet(f"{folder}/{table}.parquet")
        assert corpus_pipeline.run(spark, folder).count() <= len(rows)
