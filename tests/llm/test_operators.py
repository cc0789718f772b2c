"""Operators against plain versions on small tables, with nulls, empty and repeated rows and empty tables."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuesheet.llm import common, decontaminate, html_text, licenses, neighbours, quality, simhash, substring, suffix_tree, warc, words

DOCS = "doc_id long, text string, doc string, count int, fp long"


def documents(spark, rows):
    """With extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(a, b, "x", 1, 2) for a, b in rows], DOCS)


def test_words_split_like_bytes():
    texts = ["", None, " ", "a b", " x y z", "tab\tand\x0bline\nend ", "É é", "x" * 50]
    got = []
    for w in words.words(pa.array(texts), limit=8):
        per = defaultdict(list)
        for d, s, e in zip(w.doc, w.start, w.end, strict=True):
            per[int(d)].append(bytes(w.data[s:e]))
        got += [per[k] for k in range(w.texts)]
    assert got == [(t or "").encode().split() for t in texts]
    a, b = (next(words.words(pa.array([t]))).hashes(lower=True) for t in ("Abc DEF é", "aBC def É"))
    assert a[0] == b[0] and a[1] == b[1] and a[2] != b[2]


def plain_components(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [root(k) for k in range(n)]


def test_components_and_attach(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(25)]
    want = plain_components(200, pairs)
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {x for p in pairs if p[0] != p[1] for x in p}
    assert {k: got.get(k, k) for k in ids} == {k: want[k] for k in ids}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id")).alias("k"))
    table = spark.range(0, 5000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    table = table.unionByName(spark.createDataFrame([(7, 14)], "k long, v long"))
    out = common.attach(rows, "k", table)
    assert out.count() == 5000 and out.where("k = 7 and v = 14").count() == 3000 and out.where("v is null").count() == 1000


def test_simhash_against_all_pairs(spark):
    import xxhash

    def fp(text, size):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        grams = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] or [b" ".join(w)]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(300)) for _ in range(6)]
    rows = [(k, None if k % 17 == 0 else "") for k in range(40) if k % 5 == 0] + [(None, base[0]), (None, "lone"), (900, "A b"), (899, "a B")]
    for k in range(60, 160):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randint(0, 3))
        rows.append((k, " ".join(w)))
    fps = [fp(t, 3) for _, t in rows]
    assert [simhash.fingerprint(t) for _, t in rows] == fps
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    assert any(fps[a] != fps[b] for a, b in pairs)
    root = plain_components(len(rows), pairs)
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root, strict=True)), key=str)
    docs = documents(spark, rows)
    for crowd in (64, 2):
        got = simhash.group(docs, crowd=crowd).collect()
        assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=str) == want
    kept = simhash.representatives(docs.unionByName(docs.where("doc_id = 900")), size=3)
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(set(least.values()))
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 2
    assert simhash.group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("segments", [3, 5, 7, 9])
def test_ring_finds_every_close_pair(segments):
    ring, rng = simhash.Ring(2, segments), random.Random(1)
    for _ in range(300):
        bits = rng.sample(range(64), rng.randint(0, 2))
        differ = sum(1 << b for b in bits)
        starts = [s for s in range(segments) if not differ & ring.chain(s, ring.clean)]
        assert any(all((differ & ring.chain(s, k)).bit_count() <= ring.budget(k) for k in range(1, segments + 1)) for s in starts)


def plain_repeats(rows, window):
    first, out = {}, []
    split = [(t or "").encode().split() for _, t in rows]
    for (d, _), w in zip(rows, split, strict=True):
        for k in range(len(w) - window + 1 if d is not None else 0):
            x = tuple(w[k : k + window])
            first[x] = min(first.get(x, d), d)
    for (d, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[k : k + window])] < d:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept))
    return out


def test_substring_against_all_windows(spark):
    rng = random.Random(3)
    base = [rng.choice("abc") for _ in range(60)]
    rows = []
    for k in range(120):
        w = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        if k % 3 == 0:
            w = w[:5] + base[rng.randint(0, 20) : rng.randint(25, 60)] + w[5:]
        rows.append((rng.randint(0, 100) if k % 10 else None, " ".join(w)))
    rows += [*rows[:5], (3, None), (4, ""), (200, " ".join(base)), (201, " ".join(base)), (202, "a " * 40), (203, "a " * 30)]
    docs = documents(spark, rows)
    want = plain_repeats(rows, 8)
    for crowd, shard in ((5000, 300_000), (2, 50)):
        got = substring.report(docs, window=8, gram=4, crowd=crowd, shard=shard).collect()
        assert sorted(map(tuple, got), key=str) == sorted((x[:4] for x in want), key=str)
    cleaned = substring.clean(docs, window=8, gram=4)
    left = Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in cleaned.collect())
    assert cleaned.columns == docs.columns
    assert left == Counter((d, kept.decode()) for d, n, gone, _, kept in want if not (n and gone == n))
    assert substring.report(docs.limit(0)).count() == 0


def test_suffix_tree_base_and_normalisation(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["A b", "b c", "c a", "d"]) for _ in range(rng.randint(0, 60)))) for k in range(150)]
    rows += [(None, None), (7, ""), (8, "unseen words Here"), (8, "unseen words Here")]
    got = suffix_tree.score(documents(spark, rows), shard=10, windows=300).collect()
    split = [[*(t or "").encode().lower().split(), b"\n"] for _, t in rows]
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1 for d, _ in rows]
    count = Counter(x for w, h in zip(split, held, strict=True) if not h for x in w)
    n, v = sum(count.values()), len(count)
    want = sorted((str(d), h, len(w), sum(x in count for x in w), n, round(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
                  for (d, _), w, h in zip(rows, split, held, strict=True))
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])
    # after "a b" every continuation, an unknown token included, sums to one
    nexts = ["a", "b", "c", "d", "", "never"]
    probe = [(10_000 + 5 * k, f"c a b {w}") for k, w in enumerate(nexts)]
    held_ids = [k for k in range(10_000, 99_999) if zlib.crc32(str(k).encode()) % 5 == 1][: len(nexts) + 1]
    probe = [(i, f"c a b {w}".strip()) for i, w in zip(held_ids, nexts, strict=False)]
    scores = {r["doc_id"]: r["score"] for r in suffix_tree.score(documents(spark, rows + probe)).collect()}
    end = scores[held_ids[4]]
    assert all(scores[i] < 0 for i, _ in probe) and end < 0
    level = suffix_tree.Level(np.array([1], np.uint64), np.array([0], np.uint64), np.array([20.0]), np.array([3.0]), np.array([True]))
    parent = np.array([0.4, 0.3, 0.2, 0.1])
    assert abs(suffix_tree.interpolate(parent, level, np.zeros(4, int), np.array([10, 7, 3, 0])).sum() - 1) < 1e-12
    assert suffix_tree.score(documents(spark, [])).count() == 0


def test_neighbours_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for size in (1, 1, 1, 2, 3, 15, 70):
        for label in (0, 1):
            centre = rng.normal(size=16)
            for _ in range(size * 3):
                rows.append((k, (centre + rng.normal(size=16) * 0.03).tolist(), label))
                k += 1
    rows += [(k + 1, None, 0), (k + 2, [0.0] * 16, 0), (k + 3, [float("nan")] * 16, 0), (k + 4, [1.0, None] * 8, 0), (k + 5, rows[0][1], None),
             (None, rows[0][1], 0), (k + 6, [1e300] * 16, 1), (k + 7, [1e-300] * 16, 1), (k + 8, [1.0, 2.0], 1), (k + 9, [], 1), rows[3]]
    table = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, id int")
    good = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            x = np.array(v) / np.abs(v).max()
            good[i] = (label, x / np.sqrt((x * x).sum()))
    ids = sorted(good)
    pairs = [(a, b) for a in ids for b in ids if b < a and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= 0.98]
    root = plain_components(k + 20, pairs)
    links = Counter(x for p in pairs for x in p)
    for tile in (512, 16):
        got = neighbours.near_duplicates(table, tile=tile).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            assert (r["n_links"], r["component_id"]) == ((links[i], root[i]) if i is not None else (0, None)), r
            assert r["kept"] == (i is None or i == root[i])
    assert neighbours.near_duplicates(table.limit(0)).count() == 0


def test_quality_held_out_and_edges(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(600):
        w = ["".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 150))]
        bad = k % 6 == 0
        text = "!! ".join(x.upper() for x in w) if bad and k % 12 else " ".join([w[0]] * len(w)) if bad else " ".join(w) + "."
        rows.append((k, text))
        labels.append((k, int(not bad)))
    docs = documents(spark, rows + [(900, None), (901, ""), (None, "x"), rows[0]])
    truth = spark.createDataFrame(labels + [(0, 1), (2, None), labels[1]], "doc_id long, quality int")
    got = quality.classify(docs, truth).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    known = dict(labels)
    held = [r["predicted"] == known[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in known]
    assert sum(held) / len(held) > 0.97
    kept = quality.keep(docs, truth)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in got)
    assert {r["score"] for r in quality.classify(docs, truth.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), truth).count() == 0


def test_decontamination(spark):
    question = "A train leaves Paris at 5 km per hour and meets Anna after 30 minutes on the long road home today."
    other = question.replace("Paris", "Berlin").replace("5 km", "7 miles").replace("Anna", "Bob").replace("30", "45")
    mixed = "Take 3 red balls and put 3 green balls next to 4 blue balls before you count the 3 boxes again slowly."
    broken = mixed.replace("3 red", "5 red").replace("3 green", "6 green").replace("3 boxes", "7 boxes")
    bench = spark.createDataFrame([(1, question), (2, "tiny item"), (3, None), (None, "a b c"), (4, "1 2 3 4 5 6 7 8 9 10"), (5, mixed), (5, mixed)], "item_id long, text string")
    rows = [(1, f"foo bar. {other} baz"), (2, "x tiny item y"), (3, None), (4, ""), (5, question.upper().replace("PARIS", "Paris")), (6, "tiny items"),
            (7, " ".join(map(str, range(500)))), (8, broken), (9, mixed.replace("3 ", "8 ")), (None, question), (1, f"foo bar. {other} baz"), (10, question[:40])]
    docs = documents(spark, rows)
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontaminate.matches(docs, bench).collect())
    assert [x for x in got if x[0] != 5] == [(1, 1, "template"), (2, 2, "copy"), (9, 5, "template")]
    left = decontaminate.clean(docs, bench)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {3, 4, 6, 7, 8, 10, None}
    assert decontaminate.matches(docs.limit(0), bench).count() == decontaminate.matches(docs, bench.limit(0)).count() == 0


def test_decontamination_without_filter(spark, monkeypatch):
    docs = documents(spark, [(1, "one two three four five six seven eight nine ten"), (2, "else")])
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "FILTER", 0)
    assert [tuple(r)[:2] for r in decontaminate.matches(docs, bench).collect()] == [(1, 7)]


def test_licenses(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "MIT License"), (5, "mit license mit-license, apache license GENERAL PUBLIC license"), (6, "é License mit é"),
            (None, "x"), (7, "Licensed under the Apache License, Version 2.0."), (8, "apache_license apacheé license"), (8, "mit mit license license " * 300)]
    got = {(r["doc_id"], r["n_words"]): tuple(r)[2:] for r in licenses.scan(documents(spark, rows)).collect()}
    empty = (0, None, None, "", "", 0.0)
    assert got[1, 0] == got[2, 0] == got[3, 0] == got[6, 4] == got[None, 1] == empty
    assert got[4, 2] == (1, 0, 0, "mit", "mit", 1.0)
    assert got[5, 9] == (4, 0, 6, "apache,gpl,mit", "apache,gpl,mit", 1.0)
    assert got[7, 8][3:] == ("apache", "apache,apache-2.0", 1.0)
    assert got[8, 4][:3] == (1, 0, 0) and got[8, 1200][:3] == (300, 1, 1197)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "y" * 1500
    evil = ("<p>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 7\r\n\r\nabcdefg\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n"
            "WARC-Record-ID: <urn:page:77>\r\nContent-Length: 100000000\r\n\r\n" + "é" * 3000)
    rows = [(1, "u", None), (2, None, ""), (3, "u\r\nx", big), (4, "u", big), (5, "u", evil), (6, "u", evil), (6, "u", evil), (None, "u", big), (None, "u", "k"),
            (7, "u", "WARC/1.0\r\n"), (8, "u", "\r\n\r\n"), *((100 + k, "u", str(k) * 700) for k in range(30))]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int").coalesce(2)
    warc.write(pages, str(tmp_path / "w"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = warc.records(spark, str(tmp_path / "w"), payloads=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(rows)
    held = {"3": 4, "5": 6, "None": 4}
    want = Counter((i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode()), held.get(str(i)) if len(h or "") > 999 else None) for i, _, h in rows)
    assert Counter((r["page_id"], r["payload_digest"], r["payload_bytes"], r["refers_to"]) for r in got) == want
    assert Counter(bytes(r["payload"]).decode() for r in got if r["record_type"] == "response") == Counter((h or "") for i, _, h in rows if not (str(i) in held and len(h or "") > 999))
    path = next((tmp_path / "w").glob("part-*"))
    path.write_bytes(path.read_bytes()[:-10])
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        warc.records(spark, str(tmp_path / "w")).count()
    warc.write(pages.limit(0), str(tmp_path / "e"))
    assert warc.records(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text only.", "plain text only."), ("<p>a<p>b", "a\nb"),
    ("<body><div id=menu><a href=x>Home</a></div><div class='content'><h2>Title</h2><p>This is a long paragraph, with commas, and more text. It goes on."
     "</p><ul><li>item one, here<li>item two.</ul><p>Another&nbsp;one &amp; more, text here.</p></div><div class=comments><p>Great post, I liked it, a lot."
     "</p></div><div id=sidebar><p>Some side, text here.</p></div></body>",
     "Title\nThis is a long paragraph, with commas, and more text. It goes on.\nitem one, here\nitem two.\nAnother one & more, text here."),
    ("<main><header><h1>T</h1></header><p>x <b>y</b>z<br>w</p><form><p>Name</p></form><aside>no</aside><table><tr><td>a<td>b</table>"
     "<section class=comments><p>c</p></section></main><footer>f</footer>", "T\nx yz w\na\nb"),
    ("<article><p>a &lt;b&gt; 1 < 2 <!-- x --> c<script>if (a<b) '</p>'</script></p></article>", "a <b> 1 < 2 c"),
    ("<article><p>cut of", "cut of"),
])
def test_html(page, text):
    assert html_text.main_text(page) == text


def test_html_long_and_table(spark):
    long = "<article>" + "<p>word, word. </p>" * 20_000
    pages = spark.createDataFrame([(1, "u", long, 5), (None, None, None, 5), (1, "u", long, 5)], "page_id long, url string, html string, n_chars int")
    got = html_text.extract(pages).collect()
    assert [r["n_chars"] for r in got if r["page_id"] == 1] == [len("word, word.\n") * 20_000 - 1] * 2
    assert [tuple(r) for r in got if r["page_id"] is None] == [(None, None, "", 0)]
    assert html_text.extract(pages.limit(0)).count() == 0
