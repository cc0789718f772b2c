"""Substring deduplication over words: matching statistics from a compressed FM-index per shard.

Content-defined anchors (the minimum k-gram hash of every window) cut each text's windows into segments. Only
segments whose anchor stands in several documents can hold a repeated window, and equal windows have equal anchors,
so each shard of anchors is searched alone: its different segments are put into one FM-index, and backward search
over the wavelet tree finds, for every window of every segment, the rows of the index that share it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import attach, by_id, drop, hot_keys, read, save, unused
from cuesheet.llm.fmindex import FMIndex
from cuesheet.llm.words import mix, words

WINDOW = 50
GRAM = 24
#: Words of the segments of one shard, about.
SHARD = 300_000
#: Anchors with more different segments are cut down to windows that several of those share.
CROWD = 5_000
_K = 0xD6E8FEB86659FD93 // 8 * 8 + 5
EMPTY = hashlib.sha256(b"").hexdigest()


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of size word hashes, from prefix sums modulo 2**64."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = np.full(len(h), _K, np.uint64)
    p[0] = 1
    q = np.full(len(h), pow(_K, -1, 1 << 64), np.uint64)
    q[0] = 1
    p, q = np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * p, dtype=np.uint64)))
    return mix((total[size:] - total[:-size]) * q[:n])


def _minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of size values, by doubling."""
    done, out = 1, x
    while 2 * done <= size:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    n = len(x) - size + 1
    return np.minimum(out[:n], out[size - done : size - done + n])


def anchors(h: np.ndarray, doc: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of every window that lies in one text, place of its anchor, anchor). The leftmost minimum counts."""
    gram = min(gram, window)
    n = len(h) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64)
    g = grams(h, gram)
    bits = int(len(g)).bit_length()
    low = np.uint64((1 << bits) - 1)
    best = _minimum((g & ~low) | np.arange(len(g), dtype=np.uint64), window - gram + 1)[:n]
    place = (best & low).astype(np.int64)
    start = np.flatnonzero(doc[:n] == doc[window - 1 :])
    return start, place[start], g[place[start]]


def _id(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _profile(batches: Iterable[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per text: number of words, SHA-256 of the words joined by a space, its anchors."""
    for b in batches:
        for w in words(b.column(1)):
            h, base = w.hashes(lower=False), w.base()
            start, place, anchor = anchors(h, w.doc, window, gram)
            fresh = np.ones(len(start), bool)
            fresh[1:] = place[1:] != place[:-1]
            place, anchor, doc = place[fresh], anchor[fresh], w.doc[start[fresh]]
            edges = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=w.texts)))).astype(np.int32)
            raw = w.data.tobytes()
            sums = [hashlib.sha256(b" ".join(raw[w.start[i] : w.end[j - 1]].split())).hexdigest() if j > i else EMPTY
                    for i, j in zip(base[:-1], base[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0)[w.first : w.first + w.texts], pa.array(w.count.astype(np.int64)), pa.array(sums),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(anchor.view(np.int64)))],
                ["doc_id", "n_words", "sha", "anchors"],
            )


def _nested(rows: list[list[tuple]], kinds: dict[str, pa.DataType]) -> pa.ListArray:
    flat = [x for r in rows for x in r]
    columns = zip(*flat, strict=True) if flat else [[] for _ in kinds]
    items = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)), items)


def _segments(batches: Iterable[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Per text with shared anchors: where its runs of windows with one shared anchor stand (occurs), and the words they cover.

    A run covers at most 2 * window - gram words. Its words are among the pieces of the first text of a batch that
    holds it and of texts with smaller ids than those before, so that a common passage is not written once per text.
    """
    run = {"segment": pa.binary(), "start": pa.int64(), "n": pa.int64()}
    piece = {"anchor": pa.int64(), "segment": pa.binary(), "content": pa.binary()}
    for b in batches:
        shared = []
        for x in b.column("shared").to_pylist():
            lists: dict[str, list[int]] = {}
            for r in x:
                lists.setdefault(r["sha"], []).extend(r["anchors"])
            shared.append({sha: np.sort(np.array(v, np.int64)) for sha, v in lists.items()})
        ids = b.column("doc_id").to_pylist()
        least: dict[bytes, int] = {}
        for w in words(b.column("text")):
            h, base, raw = w.hashes(lower=False), w.base(), w.data.tobytes()
            start, place, anchor = anchors(h, w.doc, window, gram)
            cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)))) if len(start) else np.zeros(0, np.int64)
            ends = np.append(cuts[1:], len(start)) - 1
            doc = w.doc[start[cuts]] if len(cuts) else cuts
            texts, occurs, pieces = [], [], []
            for d in range(w.texts):
                i, j = base[d], base[d + 1]
                if i == j or len(shared[w.first + d]) == 0:
                    continue
                sha = hashlib.sha256(b" ".join(raw[w.start[i] : w.end[j - 1]].split())).hexdigest()
                mine = shared[w.first + d].get(sha)
                if mine is None:
                    continue
                own, fresh, doc_id = [], [], ids[w.first + d]
                for k in range(*np.searchsorted(doc, [d, d + 1])):
                    a = int(anchor[cuts[k]].view(np.int64))
                    at = np.searchsorted(mine, a)
                    if at == len(mine) or mine[at] != a:
                        continue
                    first, last = int(start[cuts[k]]), int(start[ends[k]]) + window
                    content = b" ".join(raw[w.start[first] : w.end[last - 1]].split())
                    segment = _id(content)
                    own.append((segment, first - int(i), last - first))
                    if doc_id < least.get(segment, doc_id + 1):
                        least[segment] = doc_id
                        fresh.append((a, segment, content))
                if own:
                    texts.append((doc_id, sha))
                    occurs.append(own)
                    pieces.append(fresh)
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in texts], pa.int64()), pa.array([x[1] for x in texts]), _nested(occurs, run), _nested(pieces, piece)],
                    ["doc_id", "sha", "occurs", "pieces"],
                )


def _parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the spans of words that repeat an older text's segments, and the segments that stand in none older (own)."""
    for b in batches:
        spans, firsts = [], []
        for occurs, own in zip(b.column("occurs").to_pylist(), b.column("own").to_pylist(), strict=True):
            mine, later = set(own or ()), []
            firsts.append([(x["segment"], x["start"]) for x in occurs if x["segment"] in mine])
            for begin, end in sorted((x["start"], x["start"] + x["n"]) for x in occurs if x["segment"] not in mine):
                if later and begin <= later[-1][1]:
                    later[-1] = (later[-1][0], max(end, later[-1][1]))
                else:
                    later.append((begin, end))
            spans.append(later)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("sha"), _nested(spans, {"begin": pa.int64(), "end": pa.int64()}),
             _nested(firsts, {"segment": pa.binary(), "at": pa.int64()})],
            ["doc_id", "sha", "spans", "firsts"],
        )


def _windows(batches: Iterable[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for anchor, segment, content in zip(*(b.column(c).to_pylist() for c in ("anchor", "segment", "content")), strict=True):
            w = content.split(b" ")
            ids = [_id(b" ".join(w[k : k + window])) for k in range(len(w) - window + 1)]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([anchor] * n, pa.int64()), pa.array([segment] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(ids, pa.binary())],
                ["anchor", "segment", "at", "window"],
            )


def _search(rows: pa.Table, window: int) -> pa.Table:
    """Repeated windows of one shard: for every segment the spans of words whose windows stand in an older segment."""
    segments, least = rows.column("segment").to_pylist(), np.array(rows.column("least").to_pylist(), np.int64)
    known: dict[bytes, int] = {}
    parts = [np.array([known.setdefault(x, len(known) + 1) for x in c.as_py().split(b" ")] + [0], np.int64) for c in rows.column("content")]
    lengths = np.array([len(p) - 1 for p in parts], np.int64)
    text = np.concatenate(parts)
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    index = FMIndex(text, window)
    oldest = np.minimum.reduceat(np.repeat(least, lengths + 1)[index.sa], np.unique(index.lo))
    group = np.searchsorted(np.unique(index.lo), index.lo)
    covered = np.zeros(len(text) + 1, np.int64)
    for which, place, matched, lo, _ in index.statistics(text, starts, lengths):
        hit = (matched == window) & (oldest[group[np.minimum(lo, len(text) - 1)]] < least[which])
        at = starts[which[hit]] + place[hit]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    inside = np.concatenate(([False], np.cumsum(covered)[:-1] > 0, [False]))
    begin, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    owner = np.searchsorted(starts, begin, "right") - 1
    edges = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(starts))))).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x - starts[owner])) for x in (begin, end)]
    return pa.table([pa.array(segments, pa.binary()), pa.array(least), pa.array(lengths), *spans], ["segment", "least", "length", "begin", "end"])


def _crowded(segments: DataFrame, window: int, crowd: int) -> DataFrame:
    """Segments (anchor, segment, least, content) with, for crowded anchors, shared windows in their place.

    A window that stands in one segment only repeats nothing, so a crowded anchor's segments are cut to runs of
    windows that several of them hold; equal runs fall together. Adds begin: where a run starts in its segment.
    """
    many = segments.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor", F.lit(True).alias("many"))
    marked = segments.join(many, "anchor", "left")
    plain = marked.where("many is null").select("anchor", F.col("segment").alias("part"), F.col("segment"), F.lit(0).cast("long").alias("shift"), "least", "content")
    crowds = save(marked.where("many").select("anchor", "segment", "least", "content"))
    if not crowds.head(1):
        return plain
    each = save(crowds.mapInArrow(lambda it: _windows(it, window), "anchor long, segment binary, at int, window binary"))
    twice = each.groupBy("window").count().where("count > 1").select("window")
    kept = attach(each, "window", twice, "inner").groupBy("segment").agg(F.sort_array(F.collect_set("at")).alias("kept"))

    def runs(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                w, at = r["content"].split(b" "), np.array(r["kept"])
                cuts = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
                for run in cuts:
                    content = b" ".join(w[run[0] : run[-1] + window])
                    rows.append({"anchor": r["anchor"], "part": _id(content), "segment": r["segment"], "shift": int(run[0]), "least": r["least"], "content": content})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("anchor", pa.int64()), ("part", pa.binary()), ("segment", pa.binary()), ("shift", pa.int64()), ("least", pa.int64()), ("content", pa.binary())]))

    return plain.unionByName(crowds.join(kept, "segment").mapInArrow(runs, "anchor long, part binary, segment binary, shift long, least long, content binary"))


class Repeats:
    """What a corpus repeats. profile: a row per row of docs; spans: removed words of texts that lose some."""

    def __init__(self, docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, gram: int = GRAM,
                 shard: int = SHARD, crowd: int = CROWD):
        self.window = window
        one = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        profile = save(one.mapInArrow(lambda it: _profile(it, window, gram), "doc_id long, n_words long, sha string, anchors array<long>")
                       .withColumn("row", F.monotonically_increasing_id()))
        named = profile.where("doc_id is not null")
        # of equal texts all but the one with the smallest id repeat it from end to end
        self.first = save(named.groupBy("sha").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("sha", "x.*"))
        self.profile = save(profile.select("doc_id", "n_words", "sha"))
        # a text goes by the number of its row, 8 bytes for each of its anchors
        texts = save(profile.select("row", F.array_distinct("anchors").alias("anchors")).join(self.first.select("row", "doc_id"), "row"))
        drop(profile)
        mine = texts.select("row", "doc_id", F.explode("anchors").alias("anchor"))
        shared = save(mine.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("count"))
                      .where("a < b").select("anchor", "count"))
        # anchors of common passages, fewer than HOT_SHARE, are picked where the texts stand; the others meet by shuffle
        hot = hot_keys(shared, "anchor")
        cold = texts.select("row", F.explode(F.filter("anchors", lambda x: ~x.isin(hot)) if hot else "anchors").alias("anchor"))
        lists = cold.join(shared.select("anchor"), "anchor").groupBy("row").agg(F.collect_list("anchor").alias("anchors"))
        if hot:
            lists = lists.unionByName(texts.select("row", F.filter("anchors", lambda x: x.isin(hot)).alias("anchors")).where(F.size("anchors") > 0))
        lists = lists.join(self.first, "row")
        lists = lists.groupBy("doc_id").agg(F.collect_list(F.struct("sha", "anchors")).alias("shared"))
        lists = save(lists)
        drop(texts, shared)
        self.texts = save(by_id(one, "doc_id", lists.select("doc_id"), "left_semi").join(lists, "doc_id"))
        drop(lists)
        span = "array<struct<begin:bigint,end:bigint>>"
        found = save(self.texts.mapInArrow(
            lambda it: _segments(it, window, gram),
            "doc_id long, sha string, occurs array<struct<segment:binary,start:bigint,n:bigint>>, pieces array<struct<anchor:bigint,segment:binary,content:binary>>",
        ))
        pieces = found.select("doc_id", F.explode("pieces").alias("p")).select("doc_id", "p.*")
        distinct = save(pieces.groupBy("segment").agg(F.min("anchor").alias("anchor"), F.min("doc_id").alias("least"), F.first("content").alias("content")))
        # what a text holds first goes to the text, so that no occurrence of a common passage is joined
        own = distinct.groupBy(F.col("least").alias("doc_id")).agg(F.collect_list("segment").alias("own"))
        occurs = save(found.select("doc_id", "sha", "occurs").join(own, "doc_id", "left").mapInArrow(
            _parted, f"doc_id long, sha string, spans {span}, firsts array<struct<segment:binary,at:bigint>>"))
        drop(found)
        parts = save(_crowded(distinct, window, crowd))
        drop(distinct)
        unique = parts.groupBy("part").agg(F.min("anchor").alias("anchor"), F.min("least").alias("least"), F.first("content").alias("content"))
        size = parts.agg(F.count("*")).first()[0] * (2 * window - gram)
        unique = unique.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(max(1, size // shard)))).withColumnRenamed("part", "segment")
        answers = save(unique.groupBy("shard").applyInArrow(
            lambda t: _search(t, window), "segment binary, least long, length long, begin array<long>, end array<long>"
        ))
        searched = answers.withColumnRenamed("segment", "part").withColumnRenamed("least", "oldest")
        # an occurrence in a later document than the segment's first repeats all of it; the first one repeats what the
        # search found in older segments, and all of a part that an older segment holds too
        placed = attach(parts.select("part", "segment", "shift"), "part", searched, "inner")
        later = occurs.select("doc_id", "sha", "spans")
        first = occurs.select("doc_id", "sha", F.explode("firsts").alias("f")).select("doc_id", "sha", "f.*").join(placed, "segment").select(
            "doc_id", "sha", (F.col("at") + F.col("shift")).alias("at"),
            F.expr(f"cast(if(doc_id > oldest, array(named_struct('begin', 0L, 'end', length)), arrays_zip(begin, end)) as {span})").alias("spans"),
        )
        first = first.select("doc_id", "sha", F.expr("transform(spans, s -> named_struct('begin', at + s.begin, 'end', at + s.end))").cast(span).alias("spans"))
        spans = later.unionByName(first).where(F.size("spans") > 0)
        self.spans = save(spans.groupBy("doc_id", "sha").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans")))
        drop(parts, answers, occurs)

    def copies(self) -> DataFrame:
        """doc_id, sha of texts that repeat an older equal text and have a window at all."""
        named = self.profile.where((F.col("doc_id").isNotNull()) & (F.col("n_words") >= self.window)).select("doc_id", "sha")
        return named.join(self.first, ["doc_id", "sha"], "left_anti")


def _cover(n: int, spans) -> np.ndarray:
    depth = np.zeros(n + 1, np.int64)
    for s in spans:
        depth[s["begin"]] += 1
        depth[s["end"]] -= 1
    return np.cumsum(depth)[:n] > 0


def report(docs: DataFrame, **how) -> DataFrame:
    """Columns doc_id, n_words, n_removed, kept_sha256, one row per row of docs.

    A word goes if a window of `window` words that covers it also starts in a document with a smaller id. Windows are
    those of the input. Null texts have no words; rows with a null id lose nothing and make others lose nothing;
    rows that share an id don't repeat each other. No documents, no rows.
    """
    found = Repeats(docs, **how)

    def hashed(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                w = r["text"].encode().split()
                sha = hashlib.sha256(b" ".join(w)).hexdigest()
                for x in r["all"]:
                    if x["sha"] == sha:
                        gone = _cover(len(w), x["spans"])
                        kept = b" ".join([y for y, g in zip(w, gone.tolist(), strict=True) if not g])
                        rows.append({"doc_id": r["doc_id"], "sha": sha, "n": int(gone.sum()), "new": hashlib.sha256(kept).hexdigest()})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("sha", pa.string()), ("n", pa.int64()), ("new", pa.string())]))

    lists = found.spans.groupBy("doc_id").agg(F.collect_list(F.struct("sha", "spans")).alias("all"))
    part = found.texts.select("doc_id", "text").join(lists, "doc_id").mapInArrow(hashed, "doc_id long, sha string, n long, new string").distinct()
    copies = found.copies().distinct().select("doc_id", "sha", F.lit(None).cast("long").alias("n"), F.lit(EMPTY).alias("new"))
    changed = save(part.unionByName(copies))
    lean = found.profile.select("doc_id", "n_words", "sha")
    out = lean.join(changed, ["doc_id", "sha"], "left")
    gone = F.when(F.col("new").isNull(), 0).otherwise(F.coalesce("n", "n_words"))
    return out.select("doc_id", "n_words", gone.cast("long").alias("n_removed"), F.coalesce("new", "sha").alias("kept_sha256"))


def clean(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """docs without their repeated words, all columns; a text that loses every word goes.

    Of a removed run of words the white space after it goes too; texts that lose nothing stay as they are. A column
    n_chars follows the text.
    """
    found = Repeats(docs, text, key, **how)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.lit(-1).cast("long").alias("end")))
    lists = found.spans.unionByName(found.copies().distinct().withColumn("spans", whole))
    doc, every = unused(docs, "_doc"), unused(docs, "_all")
    lists = save(lists.groupBy("doc_id").agg(F.collect_list(F.struct("sha", "spans")).alias(every)).withColumnRenamed("doc_id", doc))
    drop(found.texts)
    # texts that lose nothing stay where they are; only the others meet their spans
    touched, names = by_id(docs, key, lists.select(doc), "left_semi"), docs.columns
    joined = touched.join(lists, F.col(key).cast("long") == F.col(doc)).select(*names, every)
    place, counted = names.index(text), names.index("n_chars") if "n_chars" in names else None

    def cut(value: str, many) -> str | None:
        w = value.encode().split()
        sha = hashlib.sha256(b" ".join(w)).hexdigest()
        spans = next((x["spans"] for x in many if x["sha"] == sha), None)
        if spans is None:
            return value
        gone = _cover(len(w), [{"begin": s["begin"], "end": len(w) if s["end"] < 0 else s["end"]} for s in spans])
        if gone.all():
            return None
        x = next(iter(words(pa.array([value]), limit=1 << 62)))
        begin = np.append(x.start, len(x.data))
        raw = x.data.tobytes()
        return b"".join([raw[: begin[0]], *(raw[begin[k] : begin[k + 1]] for k in np.flatnonzero(~gone))]).decode()

    def run(batches):
        for b in batches:
            values, many = b.column(place).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            if not any(many):
                yield b.select(names)
                continue
            new = [cut(v, m) if m and v else v for v, m in zip(values, many, strict=True)]
            keep = pa.array([not (m and v and n is None) for v, m, n in zip(values, many, new, strict=True)], pa.bool_())
            columns = [b.column(k) for k in range(len(names))]
            columns[place] = pa.array(new, b.schema.field(place).type)
            if counted is not None:
                old = columns[counted].to_pylist()
                columns[counted] = pa.array([o if v == n or n is None else len(n) for o, v, n in zip(old, values, new, strict=True)], b.schema.field(counted).type)
            yield pa.RecordBatch.from_arrays(columns, names).filter(keep)

    return by_id(docs, key, lists.select(doc), "left_anti").unionByName(joined.mapInArrow(run, docs.schema))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM d),
s AS (SELECT doc_id, pos, word, md5(string_agg(word, ' ') OVER ahead) AS h, count(*) OVER ahead AS n FROM t
      WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
f AS (SELECT h, min(doc_id) AS least FROM s WHERE n = 50 GROUP BY h),
g AS (SELECT s.doc_id, s.pos, s.word, s.n = 50 AND f.least < s.doc_id AS again FROM s LEFT JOIN f USING (h)),
k AS (SELECT doc_id, pos, word, bool_or(coalesce(again, false)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (doc_id)"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read(spark, sf_dir, "documents"))
