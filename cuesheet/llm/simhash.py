"""SimHash near-duplicates: 64-bit fingerprints of word shingles, paired by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cuesheet.llm.common import attach, by_id, components, drop, hot_keys, save, unused
from cuesheet.llm.words import mix, words

SEED = 42
BLOCK = 1 << 16
#: A bucket with more fingerprints than this is linked through one-bit neighbours instead of pair by pair.
CROWD = 64
#: Jaccard similarity of shingle sets from which texts are near copies.
JACCARD = 0.8
#: Min-hashes of a band and bands: at JACCARD a pair shares no band with odds of (1 - 0.8**4)**20, 3 in 100,000.
ROWS, BANDS = 4, 20
_RNG = np.random.default_rng(SEED)
_MUL, _ADD = (_RNG.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def fingerprint(text: str | None, size: int = 3, lower: bool = True) -> int:
    """A bit is set if over half of the shingles' XXH64 have it; no word: 0; fewer words than size: one shingle."""
    import xxhash

    raw = (text or "").encode()
    w = (raw.lower() if lower else raw).split()
    if not w:
        return 0
    x = xxhash.xxh64_intdigest
    n, ones = max(1, len(w) - size + 1), np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = w[at : min(at + BLOCK, n) + size - 1]
        grams = zip(*(part[k:] for k in range(size)), strict=False) if len(w) >= size else [part]
        h = np.array([x(b" ".join(g), SEED) for g in grams], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """Columns doc_id and fp (the 64 bits as a signed long), one row per row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Ring:
    """64 bits cut into `segments` segments on a ring, for at most `distance` differing bits.

    If two words differ in at most distance bits, some segment starts a chain in which the first k segments
    together differ in at most k * distance / segments bits, for every k. The first `clean` steps of that budget
    round down to zero, so those segments are equal and make the join key; the later steps prune what the key
    brings together before the whole distance is counted.
    """

    def __init__(self, distance: int = 2, segments: int = 7):
        if not 0 < distance < segments:
            raise ValueError("the number of segments must exceed the distance")
        self.distance, self.segments = distance, segments
        cuts = [64 * k // segments for k in range(segments + 1)]
        self.masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
        self.clean = (segments - 1) // distance

    def chain(self, start: int, length: int) -> int:
        out = 0
        for k in range(length):
            out |= self.masks[(start + k) % self.segments]
        return out

    def budget(self, length: int) -> int:
        return length * self.distance // self.segments

    def keys(self, fp: Column) -> Column:
        return F.array(*(
            F.struct(F.lit(s).alias("s"), fp.bitwiseAND(F.lit(_signed(self.chain(s, self.clean)))).alias("key"))
            for s in range(self.segments)
        ))

    def passes(self, start: Column, differ: Column) -> Column:
        """The chain test: every prefix from the key on stays within its budget; the whole ring is the last."""
        test = F.lit(False)
        for s in range(self.segments):
            steps = F.lit(True)
            for k in range(self.clean + 1, self.segments + 1):
                if k == self.segments or self.budget(k) < self.budget(k + 1):
                    steps = steps & (F.bit_count(differ.bitwiseAND(F.lit(_signed(self.chain(s, k))))) <= self.budget(k))
            test = test | ((start == s) & steps)
        return test

    def free(self, start: int) -> list[int]:
        """Bits outside the key."""
        rest = ~self.chain(start, self.clean) & ((1 << 64) - 1)
        return [1 << k for k in range(64) if rest >> k & 1]


def _keyed(prints: DataFrame, ring: Ring) -> DataFrame:
    return prints.select("fp", F.explode(ring.keys(F.col("fp"))).alias("k")).select("fp", "k.s", "k.key")


def links(keyed: DataFrame, ring: Ring, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that are connected by differences within the distance.

    keyed: distinct fp with their keys. Buckets of up to crowd fingerprints are joined with themselves. In a larger one every
    fingerprint names itself and its one-bit neighbours outside the key; those that name the same word differ in
    at most two bits and are tied to the smallest of them, so a bucket of n needs some 40 n rows, not n * n.
    """
    sizes = keyed.groupBy("s", "key").count().where("count > 1")
    few, many = sizes.where(F.col("count") <= crowd), sizes.where(F.col("count") > crowd)
    small = keyed.join(few.select("s", "key"), ["s", "key"])
    a, b = small.select("s", "key", F.col("fp").alias("a")), small.select("s", "key", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    pairs = a.join(b, ["s", "key"]).where("a < b").where(ring.passes(F.col("s"), differ)).select("a", "b")
    if ring.distance != 2:
        crowded = keyed.join(many.select("s", "key"), ["s", "key"])
        c, d = crowded.select("s", "key", F.col("fp").alias("a")), crowded.select("s", "key", F.col("fp").alias("b"))
        return pairs.unionByName(c.join(d, ["s", "key"]).where("a < b").where(ring.passes(F.col("s"), differ)).select("a", "b"))
    flips = F.lit(None)
    for s in range(ring.segments):
        flips = F.when(F.col("s") == s, F.array(F.lit(0).cast("long"), *(F.lit(_signed(x)) for x in ring.free(s)))).otherwise(flips)
    named = (
        keyed.join(many.select("s", "key"), ["s", "key"])
        .select("s", "key", "fp", F.explode(flips).alias("flip")).select("s", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    )
    # grouped by the word, which no more than 65 fingerprints can name
    tied = named.groupBy("s", "key", "word").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return pairs.unionByName(tied.select("a", F.explode("all").alias("b")).where("a != b"))


def _grouped(prints: DataFrame, distance: int, segments: int, crowd: int) -> DataFrame:
    """Columns fp, n_same, component_id, one row per fingerprint."""
    distinct = save(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")))
    keyed = save(_keyed(distinct.select("fp"), Ring(distance, segments)))
    found = components(links(keyed, Ring(distance, segments), crowd))
    drop(keyed)
    found = found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct()
    members = distinct.join(found, distinct["fp"] == found["node"])
    least = members.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = found.join(least, "component").select(F.col("node").alias("fp"), "smallest")
    return distinct.join(linked, "fp", "left").select("fp", "n_same", F.coalesce("smallest", "least").alias("component_id"))


def group(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, distance: int = 2, segments: int = 7,
          crowd: int = CROWD) -> DataFrame:
    """Columns doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_same (rows with
    this fingerprint).

    One row per row; rows with a null id belong to their group and never name it, and a group of only such rows
    has a null component. Texts without words all have fingerprint zero and so form one group.
    """
    prints = save(fingerprints(docs, text, key, size))
    table = save(_grouped(prints, distance, segments, crowd))
    out = attach(prints, "fp", table)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same")


def shingles(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text its different shingles' 64-bit hashes, ascending; fewer words than size: one shingle; no word: none."""
    for w in words(column):
        h, base = w.hashes(lower=True), w.base()
        for i, j in zip(base[:-1], base[1:], strict=True):
            n = min(size, j - i)
            out = np.zeros(max(j - i - n + 1, 0) if n else 0, np.uint64)
            for k in range(n):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[i + k : i + k + len(out)]
            yield np.unique(mix(out))


def _sketches(docs: DataFrame, text: str, key: str, size: int) -> DataFrame:
    """Columns doc_id, fp, same (hash of the shingle set), n (its size), bands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.arange(BANDS, dtype=np.uint64)
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), size) for t in b.column(1)], np.uint64).view(np.int64)
            same, n, bands = [], [], []
            for x in shingles(b.column(1), size):
                least = np.array([(x * m + a).min() if len(x) else 0 for m, a in zip(_MUL, _ADD, strict=True)], np.uint64)
                band = order
                for k in range(ROWS):
                    band = mix(band + least[k::ROWS])
                same.append(mix(x).sum(dtype=np.uint64) + np.uint64(len(x)))
                n.append(len(x))
                bands.append(band.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(fp), pa.array(np.array(same, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "fp", "same", "n", "bands"])

    one = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return one.mapInArrow(run, "doc_id long, fp long, same long, n long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, jaccard: float) -> DataFrame:
    """The pairs (a, b) of which the shingle sets have at least this Jaccard similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(shingles(b.column("x"), size), shingles(b.column("y"), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and both >= jaccard * (len(x) + len(y) - both))
            yield b.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    pairs = save(pairs.distinct())
    named = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    held = save(by_id(texts, "id", named, "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    one = save(attach(pairs, "a", held.select(F.col("id").alias("a"), F.col("text").alias("x")), "inner"))
    both = attach(one, "b", held.select(F.col("id").alias("b"), F.col("text").alias("y")), "inner")
    good = save(both.mapInArrow(run, "a long, b long"))
    drop(pairs, held, one)
    return good


def _joined(table: DataFrame, edges: DataFrame) -> DataFrame:
    """table (id, root) after edges (a, b) between ids were added: only the roots they touch are put together."""
    of = lambda c: table.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
    ends = edges.join(of("a"), "a").join(of("b"), "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    found = components(ends)
    out = save(attach(table, "root", found.select(F.col("node").alias("root"), "component")).select("id", F.coalesce("component", "root").alias("root")))
    drop(table)
    return out


def _rarest(ids: DataFrame, texts: DataFrame, size: int, jaccard: float) -> DataFrame:
    """Columns id, n, at, key: of each text's n different shingles those that stand at place `at` among its rarest and in other texts too.

    Texts with a similarity of j share j * n shingles at least, so one of the first n - ceil(j * n) + 1 of them in any
    order that is the same for all. In the order of frequency these are mostly shingles that no other text here has:
    they take their places, but only those of several texts become keys. Hot ones come last, in the order of their hashes.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingles(b.column("text"), size))
            ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", "n", "all"])

    held = by_id(texts, "id", ids, "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    sets = save(held.mapInArrow(run, "id long, n long, all array<long>"))
    counts = save(sets.select(F.explode("all").alias("key")).groupBy("key").count().where("count > 1"))
    hot = hot_keys(counts, "key")
    rare = F.filter("all", lambda x: ~x.isin(hot)) if hot else F.col("all")
    often = F.filter("all", lambda x: x.isin(hot)) if hot else F.array().cast("array<long>")
    shared = sets.select("id", F.explode(rare).alias("key")).join(counts, "key")
    shared = shared.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("count", "key"))), lambda x: x.key).alias("rare"))
    lists = sets.select("id", "n", often.alias("often")).join(shared, "id", "left")
    lists = lists.select("id", "n", F.concat(F.coalesce("rare", F.array().cast("array<long>")), "often").alias("keys"))
    alone = F.col("n") - F.size("keys")
    each = lists.select("id", "n", alone.alias("alone"), F.slice("keys", 1, F.greatest(F.lit(0), (F.col("n") - _least(jaccard * F.col("n")) + 1 - alone).cast("int"))).alias("keys"))
    out = save(each.select("id", "n", "alone", F.posexplode("keys").alias("place", "key")).select("id", "n", (F.col("alone") + F.col("place")).alias("at"), "key"))
    drop(sets, counts)
    return out


def _least(share: Column) -> Column:
    """The least whole number from share on, which a rounding error above a whole number doesn't raise."""
    return F.ceil(share - 1e-6)


def _near(nodes: DataFrame, texts: DataFrame, size: int, jaccard: float, crowd: int = 8, rounds: int = 6) -> DataFrame:
    """Edges (a, b) that connect all nodes (id, n, bands) that share a band and reach the Jaccard similarity."""
    keyed = save(nodes.where("n > 0").select("id", "n", F.lit(0).cast("long").alias("at"), F.explode("bands").alias("key")))
    return _linked(keyed, save(nodes.select("id", F.col("id").alias("root"))), texts, size, jaccard, crowd, rounds)


def _linked(keyed: DataFrame, table: DataFrame, texts: DataFrame, size: int, jaccard: float, crowd: int, rounds: int, rarest: bool = False) -> DataFrame:
    """Edges (a, b) that connect all ids that share a key and reach the Jaccard similarity.

    keyed: id, n, at, key; table: id, root so far. A bucket of more than crowd nodes is compared with one of its nodes, the hub,
    at a time: first the node whose buckets are the largest, as the middle of a crowd is in most of them, then the next
    such node that is still apart from the first hub's component, and so on. A pair of nodes in one component needs no
    comparison, so a crowd of near copies needs a few rounds of as many pairs as it has members; a bucket without nodes
    apart is done. Nodes that rounds leave apart share keys with many, but are mostly similar to none: such buckets are
    made anew from their texts' rarest shingles, which similar texts share as well. Only there, when few are left apart or
    after the last round, are all compared with all others of their bucket that are not in their component, so no pair
    that could connect anything is left out.

    Of n and m shingles, in one order at the places at and am, texts have `need` in common at least; so it takes that many from there on.
    The text with fewer has such a key even among the first n - need(n, n) + 1, else it is not short there.
    """
    both = jaccard / (1 + jaccard)
    need = _least(both * (F.col("n") + F.col("m")))
    alike = (F.col("at") + need <= F.col("n")) & (F.col("am") + need <= F.col("m"))
    short = F.col("at") + _least(2 * both * F.col("n")) <= F.col("n")
    other = lambda x: x.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("at").alias("am"), *[c for c in x.columns if c == "root"])
    sizes = save(keyed.groupBy("key").agg(F.count("*").alias("count"), F.count_if(short).alias("shorts")).where("count > 1 and shorts > 0"))
    small = keyed.join(sizes.where(F.col("count") <= crowd).select("key"), "key")
    pairs = small.withColumnRenamed("id", "a").join(other(small), "key").where("a < b").where(alike).select("a", "b")
    large = save(attach(keyed, "key", sizes.where(F.col("count") > crowd), "inner", sizes))
    middle = large.groupBy("id").agg((-F.sum("count")).alias("far"))
    many = save(large.join(middle, "id").select("key", "id", "n", "at", F.when(short, F.col("count")).otherwise(F.col("shorts")).alias("pairs"), F.struct("far", "id").alias("rank")))
    hub = save(many.groupBy("key").agg(F.min(F.struct("rank", "n", "at")).alias("h")))
    hubs = attach(many.select("key", "id", "n", "at"), "key", hub.select("key", F.col("h.rank.id").alias("a"), F.col("h.n").alias("m"), F.col("h.at").alias("am")), "inner")
    tried = pairs.unionByName(hubs.where("a != id").where(alike).select("a", F.col("id").alias("b")))
    if rarest:
        root = lambda c: table.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        tried = tried.distinct().join(root("a"), "a").join(root("b"), "b").where("ra != rb").select("a", "b")
    edges = _verified(tried, texts, size, jaccard)
    total = many.count()
    drop(keyed, sizes, large)
    if not total:
        drop(many, hub, table)
        return edges
    table = _joined(table, edges)
    last, before = save(hub.select("key", F.col("h.rank.id").alias("first"), F.col("h.rank").alias("last"))), None
    drop(hub)
    for turn in range(rounds + 1):
        tops = last.join(table.select(F.col("id").alias("first"), F.col("root").alias("top")), "first")
        rooted = save(many.join(table, "id"))
        placed = save(attach(rooted, "key", tops.select("key", "last", "top"), "inner"))
        drop(rooted)
        apart = placed.where("root != top and rank > last")
        left = apart.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
        # a round costs the same however little it settles
        if not left or left <= 4 * total or turn == rounds or before is not None and 2 * left > before:
            break
        before = left
        new = save(apart.groupBy("key").agg(F.min(F.struct("rank", "n", "at", "root")).alias("h")))
        met = attach(placed.select("key", "id", "n", "at", "root"), "key", new.withColumns({"m": F.col("h.n"), "am": F.col("h.at")}), "inner")
        met = met.where("root != h.root").where(alike).select(F.col("h.rank.id").alias("a"), F.col("id").alias("b"))
        more = _verified(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, size, jaccard)
        edges = edges.unionByName(more)
        later = save(last.select("key", "first").join(new.select("key", F.col("h.rank").alias("last")), "key"))
        fewer = save(attach(many, "key", new.select("key"), "inner"))
        drop(placed, new, last, many)
        last, many, table = later, fewer, _joined(table, more)
    if left and rarest:
        open_ = placed.join(apart.select("key").distinct(), "key", "left_semi")
        first = lambda x: x.select("key", F.col("id").alias("a"), "n", "at", F.col("root").alias("r"))
        one, rest = F.expr("root != top and rank > last"), other(open_.select("key", "id", "n", "at", "root"))
        met = first(open_.where(one & short)).join(rest, "key").where("r != root").where(alike).select("a", "b")
        others = other(open_.where(one).select("key", "id", "n", "at", "root"))
        met = met.unionByName(first(open_.where(~one & short)).join(others, "key").where("r != root").where(alike).select("a", "b"))
        edges = edges.unionByName(_verified(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), texts, size, jaccard))
    elif left:
        keys = _rarest(placed.join(apart.select("key").distinct(), "key", "left_semi").select("id").distinct(), texts, size, jaccard)
        start = save(table.join(keys.select("id").distinct(), "id", "left_semi"))
        edges = edges.unionByName(_linked(keys, start, texts, size, jaccard, crowd, rounds, True))
    drop(many, last, placed, table)
    return edges


def near_representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, jaccard: float = JACCARD,
                         distance: int = 2, segments: int = 7, crowd: int = CROWD, bucket: int = 8) -> DataFrame:
    """Like representatives, where also texts whose different shingles have this Jaccard similarity are linked.

    At a Jaccard similarity of 0.8 fingerprints differ in some 10 of 64 bits, and up to 17: no chain of clean segments
    is left to join by. So the pairs beyond `distance` come from bands of min-hashes, and each is checked on its texts.
    """
    prints = save(_sketches(docs, text, key, size))
    table = save(_grouped(prints.select("doc_id", "fp"), distance, segments, crowd))
    distinct = prints.where("doc_id is not null").groupBy("fp", "same").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    distinct = save(distinct)
    drop(prints)
    sets = save(distinct.groupBy("same").agg(F.min(F.struct("id", "n", "bands")).alias("x")).select("same", "x.*"))
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    near = _near(sets.select("id", "n", "bands"), texts, size, jaccard, bucket)
    edges = distinct.join(table, "fp").select(F.col("id").alias("a"), F.col("component_id").alias("b"))
    edges = edges.unionByName(distinct.select("same", F.col("id").alias("a")).join(sets.select("same", F.col("id").alias("b")), "same").select("a", "b"))
    found = components(edges.unionByName(near))
    kept = save(distinct.select("id").distinct().join(found, F.col("id") == F.col("node"), "left_anti").select("id"))
    drop(table, distinct, sets, found)
    return _first(docs, text, key, kept)


def representatives(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One document of each group, that with the smallest id, with all columns; rows with a null id all stay.

    Rows that repeat an id are one document: the first of them in the order of the text stays.
    """
    kept = group(docs, text, key, **how).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    return _first(docs, text, key, kept)


def _first(docs: DataFrame, text: str, key: str, kept: DataFrame) -> DataFrame:
    """Rows whose key is in kept (one column, id), one per key, and all rows without a key.

    Only ids that stand in several rows are dealt out by id to find the first of their texts; all other rows stay in place.
    """
    named, long = docs.where(F.col(key).isNotNull()), F.col(key).cast("long")
    several = save(named.groupBy(long.alias("id")).count().where("count > 1").select("id"))
    gone = named.select(long.alias("id")).distinct().join(kept, "id", "left_anti")
    out = by_id(by_id(named, key, gone, "left_anti"), key, several, "left_anti").unionByName(docs.where(F.col(key).isNull()))
    if several.isEmpty():
        return out
    repeated = by_id(named, key, kept.join(several, "id", "left_semi"), "left_semi")
    nth = unused(docs, "_nth")
    number = F.row_number().over(W.partitionBy(long).orderBy(F.col(text).asc_nulls_last()))
    return out.unionByName(repeated.withColumn(nth, number).where(F.col(nth) == 1).drop(nth))
