"""Scales, distances, neighbours, percentiles and the reading of one item against a corpus."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions.numbers import finite, rnd
from cuesheet.operators.ordered import attach_by_value, median_of, nth, rank_table
from cuesheet.operators.ranks import melt
from cuesheet.session import materialise

#: Targets of one pass over the corpus.
BATCH = 1000


def robust_scale(long: DataFrame, min_n: int = 3) -> DataFrame:
    """Median and robust scale per feature of a long table.

    scale = max(1.4826·MAD, IQR/1.349, range/20, 1e-9) with nearest-rank quartiles of the sorted
    values. The deviations are counted from the counts of the values, not from the rows.
    """
    # read for the quartiles and again for the deviations
    table = materialise(rank_table(long, ["feature"], "value"))
    n = F.col("n_total")
    base = table.groupBy("feature").agg(
        F.max("n_total").alias("n"),
        median_of("value").alias("median"),
        nth("value", F.floor(n / 4)).alias("_q1"),
        nth("value", F.floor(n * 3 / 4)).alias("_q3"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
    ).where(F.col("n") >= min_n)
    # one row per feature, that is per column of the wide table
    dev = table.join(F.broadcast(base.select("feature", "median")), "feature").select(
        "feature", F.abs(F.col("value") - F.col("median")).alias("value"), F.col("n").alias("w")
    )
    mad = rank_table(dev, ["feature"], "value", {"n": F.col("w")}).groupBy("feature").agg(
        median_of("value").alias("mad")
    )
    iqr = F.when(F.col("_q3") > F.col("_q1"), (F.col("_q3") - F.col("_q1")) / 1.349).otherwise(0.0)
    scale = F.greatest(F.col("mad") * 1.4826, iqr, (F.col("_max") - F.col("_min")) / 20.0, F.lit(1e-9))
    return base.join(mad, "feature").select("feature", "n", "median", "mad", scale.alias("scale"))


def moments(df: DataFrame, features: Sequence[str], min_n: int = 20) -> dict[str, dict]:
    """Mean, population deviation and n per column; columns under ``min_n`` or constant are dropped.

    NaN and infinities are missing.
    """
    df = df.select(*[finite(f).alias(f) for f in features])
    row = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features],
        *[F.stddev_pop(f).alias(f"s_{f}") for f in features],
        *[F.count(f).alias(f"n_{f}") for f in features],
    ).first()
    return {
        f: {"mean": row[f"m_{f}"], "std": row[f"s_{f}"], "n": row[f"n_{f}"]}
        for f in features
        if row[f"n_{f}"] >= min_n and row[f"s_{f}"] and row[f"s_{f}"] > 0
    }


def target_rows(df: DataFrame, ids: Sequence, item: str, features: Sequence[str]) -> list:
    """The items that the caller named; ``neighbours`` takes them batch by batch."""
    return df.where(F.col(item).isin(list(ids))).select(item, *features).orderBy(item).collect()


def distance_to(target, features: Sequence[str], scales: dict[str, float], required: int = 1) -> Column:
    """Root mean square of the scaled differences over the jointly present features."""
    total, n = F.lit(0.0), F.lit(0)
    for f in features:
        if target[f] is None or f not in scales:
            continue
        d = (F.col(f) - F.lit(float(target[f]))) / F.lit(float(scales[f]))
        total = total + F.coalesce(d * d, F.lit(0.0))
        n = n + F.col(f).isNotNull().cast("int")
    return F.when(n >= max(required, 1), F.sqrt(total / n))


def neighbours(
    corpus: DataFrame,
    targets: Sequence,
    features: Sequence[str],
    scales: dict[str, float],
    k: int,
    *,
    item: str = "item",
    required: int = 1,
    digits: int = 4,
) -> DataFrame:
    """k nearest corpus items per target, ties by id.

    One scan of the corpus per BATCH targets: tasks measure whole Arrow batches and pass on the rows that are no farther
    than the k-th nearest they have seen; NaN and infinities are missing.
    """
    if len(targets) > BATCH:
        how = {"item": item, "required": required, "digits": digits}
        parts = [neighbours(corpus, targets[i : i + BATCH], features, scales, k, **how) for i in range(0, len(targets), BATCH)]
        return reduce(DataFrame.unionByName, parts)
    used = [f for f in features if f in scales]
    names = [t[item] for t in targets]
    points = np.array([[np.nan if t[f] is None or not math.isfinite(t[f]) else float(t[f]) for f in used] for t in targets], float).reshape(len(names), len(used))
    kind = corpus.schema[item].dataType.simpleString()
    rows = corpus.select(item, *[finite(f).alias(f"_v{i}") for i, f in enumerate(used)]).mapInArrow(
        _within(names, points, [float(scales[f]) for f in used], k, max(required, 1), 10.0**digits), f"item {kind}, target {kind}, distance double"
    )
    rows = rows.where(F.col("item") != F.col("target")).select(F.col("item").alias(item), "target", "distance")
    w = Window.partitionBy("target").orderBy("distance", item)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn(
        "rank", F.col("rank").cast("bigint")
    )


def _within(names: list, points: np.ndarray, scales: list[float], k: int, required: int, step: float):
    """Per task: rows and targets whose rounded distance is not above the k-th smallest so far, the target's own row apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(names), k + 1), np.inf)  # one more, as a target may meet itself
        for b in batches:
            values = [c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns[1:]]
            own = pa.array(names, b.column(0).type)
            for lo in range(0, len(names), 64):
                asked = points[lo : lo + 64]
                total, n = np.zeros((len(asked), len(b))), np.zeros((len(asked), len(b)))
                for i, x in enumerate(values):
                    d = (x[None, :] - asked[:, i, None]) / scales[i]
                    there = ~np.isnan(d)
                    total += np.where(there, d * d, 0.0)
                    n += there
                far = np.floor(np.sqrt(total / np.maximum(n, 1)) * step + 0.5) / step
                far[n < required] = np.nan
                seen = np.hstack([best[lo : lo + 64], np.where(np.isnan(far), np.inf, far)])
                best[lo : lo + 64] = np.partition(seen, k, axis=1)[:, : k + 1]
                t, r = np.nonzero(far <= best[lo : lo + 64].max(1)[:, None])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), own.take(pa.array(t + lo)), pa.array(far[t, r])], ["item", "target", "distance"])

    return run


#: Bytes of target vectors that are sent to the tasks at once; more targets are served in further passes.
BLOCK_BYTES = 32 << 20
_PACKED = "item long, width int, v binary"


def _packed(vectors: DataFrame, vector: str, item: str) -> DataFrame:
    """(item, width, packed doubles) of the vectors without a missing or non-finite component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array(v, float)
                if len(x) and np.isfinite(x).all():
                    out.append((i, len(x), x.tobytes()))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["item", "width", "v"])

    rows = vectors.select(F.col(item).cast("long").alias("item"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    return rows.where(F.col("item").isNotNull() & F.col("v").isNotNull()).mapInArrow(run, _PACKED)


def _deviations(packed: DataFrame) -> dict[int, np.ndarray]:
    """Population deviation of every dimension per width, from sums that tasks hand over: one row per width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            width = b.column("width").to_numpy()
            for w in np.unique(width):
                x = np.frombuffer(b"".join(v for v, k in zip(b.column("v").to_pylist(), width, strict=True) if k == w)).reshape(-1, w)
                mean = x.mean(0)
                yield pa.RecordBatch.from_arrays([pa.array([int(w)], pa.int32()), pa.array([len(x)]), pa.array([mean.tolist()]), pa.array([((x - mean) ** 2).sum(0).tolist()])], ["width", "n", "mean", "m2"])

    parts = packed.mapInArrow(run, "width int, n long, mean array<double>, m2 array<double>")
    long = parts.select("width", "n", F.posexplode(F.arrays_zip("mean", "m2"))).select("width", "n", "pos", "col.mean", "col.m2")
    long = materialise(long)
    centre = long.groupBy("width", "pos").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("c"), F.sum("n").alias("total"))
    spread = long.join(centre, ["width", "pos"]).groupBy("width", "pos").agg(F.sum(F.col("m2") + F.col("n") * (F.col("mean") - F.col("c")) ** 2).alias("m2"), F.first("total").alias("total"))
    rows = spread.select("width", F.struct("pos", F.sqrt(F.col("m2") / F.col("total")).alias("sd")).alias("x")).groupBy("width").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return {r["width"]: np.array([x["sd"] for x in r["x"]]) for r in rows.collect()}


def array_neighbours(corpus: DataFrame, targets: DataFrame, vector: str, k: int, item: str = "item", digits: int = 4) -> DataFrame:
    """k nearest vectors per target by RMS of the differences in units of each dimension's deviation, ties by id.

    targets may be any table. Vectors are compared with those of their own width, whose deviations are taken over the
    corpus; a constant dimension counts nothing, and a vector with a missing or non-finite component is compared with none.
    Targets go to the tasks in blocks of BLOCK_BYTES at most; each task keeps its k nearest of every target of the block, so
    what is shuffled is k rows per target and task, and the plan of a block doesn't grow with the targets.
    """
    everything = materialise(_packed(corpus, vector, item))
    sd = _deviations(everything)
    asked = materialise(_packed(targets, vector, item).distinct())
    size = asked.agg(F.coalesce(F.sum(F.octet_length("v") + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item", "v"), F.lit(blocks)))
    sc, step, out = corpus.sparkSession.sparkContext, 10.0**digits, None
    for n in range(blocks):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        groups: dict[int, list] = {}
        for r in asked.where(F.col("block") == n).collect():
            groups.setdefault(r["width"], []).append((r["item"], np.frombuffer(r["v"])))
        for w, rows in groups.items():
            if w in sd:
                inverse = np.divide(1.0, sd[w], out=np.zeros(w), where=sd[w] > 0)
                held[w] = (np.array([i for i, _ in rows]), np.array([v for _, v in rows]) * inverse, inverse)
        near = everything.mapInArrow(_nearest(sc.broadcast(held), k, step), "target long, item long, distance double")
        best = near.groupBy("target").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "item"))), 1, k).alias("b"))
        best = best.select("target", F.posexplode("b").alias("rank", "b")).select("target", F.col("b.item").alias(item), "b.distance", (F.col("rank") + 1).cast("bigint").alias("rank"))
        out = best if out is None else out.unionByName(best)
    return out


def _nearest(held, k: int, step: float):
    """Per task: the k nearest (by rounded distance, then id) of every held target among the task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {w: (np.full((len(t), k), np.inf), np.full((len(t), k), np.iinfo(np.int64).max)) for w, (t, _, _) in held.value.items()}
        for b in batches:
            width, ids, values = b.column("width").to_numpy(), b.column("item").to_numpy(), b.column("v")
            for w in np.unique(width):
                if w not in best:
                    continue
                names, z, inverse = held.value[w]
                at = np.flatnonzero(width == w)
                x = np.frombuffer(b"".join(values.take(pa.array(at)).to_pylist())).reshape(-1, w) * inverse
                for lo in range(0, len(names), 256):
                    t = z[lo : lo + 256]
                    square = (x * x).sum(1)[None, :] + (t * t).sum(1)[:, None] - 2 * t @ x.T
                    far = np.floor(np.sqrt(np.maximum(square, 0.0) / w) * step + 0.5) / step
                    far[names[lo : lo + 256, None] == ids[at][None, :]] = np.inf
                    distance = np.hstack([best[w][0][lo : lo + 256], far])
                    who = np.hstack([best[w][1][lo : lo + 256], np.broadcast_to(ids[at], far.shape)])
                    order = np.lexsort((who, distance), axis=1)[:, :k]
                    best[w][0][lo : lo + 256] = np.take_along_axis(distance, order, 1)
                    best[w][1][lo : lo + 256] = np.take_along_axis(who, order, 1)
        for w, (distance, who) in best.items():
            i, j = np.nonzero(np.isfinite(distance))
            yield pa.RecordBatch.from_arrays([pa.array(held.value[w][0][i]), pa.array(who[i, j]), pa.array(distance[i, j])], ["target", "item", "distance"])

    return run


def outliers(df: DataFrame, features: Sequence[str], scale: DataFrame, k: int, item: str = "item") -> DataFrame:
    """Items farthest from the medians: RMS of (x − median)/scale, top k."""
    s = {r["feature"]: r for r in scale.collect()}  # one row per column
    centre = {f: s[f]["median"] for f in features if f in s}
    score = distance_to({f: centre.get(f) for f in features}, features, {f: s[f]["scale"] for f in centre})
    return df.select(item, rnd(score, 4).alias("score")).where(F.col("score").isNotNull()).orderBy(
        F.col("score").desc(), item
    ).limit(k)


def percentile_table(long: DataFrame) -> DataFrame:
    """Midrank and at-or-below percentile of every distinct value per feature."""
    n, below, total = F.col("n"), F.col("n_below"), F.col("n_total")
    return rank_table(long, ["feature"], "value").select(
        "feature", "value", "n", "n_total",
        rnd(100.0 * (below + 0.5 * n) / total, 1).alias("midrank_pct"),
        rnd(100.0 * (below + n) / total, 1).alias("at_or_below_pct"),
    )


def with_percentiles(rows: DataFrame, long: DataFrame) -> DataFrame:
    """Attach both percentiles to rows(feature, value) taken from the corpus ``long``."""
    return attach_by_value(rows, percentile_table(long), ["feature", "value"], "n").drop("n", "n_total")


def evidence(
    df: DataFrame, targets: DataFrame, features: Sequence[str], item: str = "item", min_n: int = 20
) -> DataFrame:
    """Per target and feature: value, z, midrank percentile, corpus mean, deviation, median and n.

    ``targets`` is a subset of the corpus of any size; statistics are one row per feature.
    """
    long = melt(df, [item], features)
    # read for the percentiles and again for the medians
    table = materialise(rank_table(long, ["feature"], "value"))
    pct = table.select(
        "feature", "value", "n", "n_total",
        rnd(100.0 * (F.col("n_below") + 0.5 * F.col("n")) / F.col("n_total"), 1).alias("percentile"),
    )
    medians = table.groupBy("feature").agg(median_of("value").alias("reference_median"))
    mom = moments(df, features, min_n)
    if not mom:
        raise ValueError("no feature with enough finite, varying reference values")
    stats = F.array(
        *[
            F.struct(
                F.lit(f).alias("feature"), F.lit(m["mean"]).alias("reference_mean"),
                F.lit(m["std"]).alias("reference_std"), F.lit(m["n"]).cast("bigint").alias("reference_n"),
            )
            for f, m in mom.items()
        ]
    )
    stats = medians.withColumn("_s", F.element_at(F.filter(stats, lambda s: s["feature"] == F.col("feature")), 1))
    stats = stats.where(F.col("_s").isNotNull()).select("feature", "reference_median", "_s.reference_mean", "_s.reference_std", "_s.reference_n")
    asked = melt(targets, [item], list(mom))
    rows = attach_by_value(asked, pct, ["feature", "value"], "n").drop("n", "n_total")
    out = rows.join(F.broadcast(stats), "feature")
    return out.withColumn("z", (F.col("value") - F.col("reference_mean")) / F.col("reference_std"))


def centroid_distances(
    df: DataFrame,
    targets: Sequence,
    features: Sequence[str],
    mom: dict[str, dict],
    group: str,
    *,
    item: str = "item",
    coverage: float = 0.6,
) -> DataFrame:
    """Distance of each target to the centroid of each group; NULL under the coverage rule."""
    usable = [f for f in features if f in mom]
    required = math.ceil(len(features) * coverage)
    cent = df.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.avg(f).alias(f) for f in usable])
    scales = {f: mom[f]["std"] for f in usable}
    options = F.array(
        *[
            F.struct(F.lit(t[item]).alias("target"), distance_to(t, usable, scales, required).alias("distance"))
            for t in targets
        ]
    )
    return cent.select(group, F.explode(options).alias("d")).select(group, "d.*")


def closer_group(distances: DataFrame, group: str, first: str = "top", second: str = "bottom") -> DataFrame:
    """The nearer of two groups unless the distances agree within 1e-4."""
    d = distances.groupBy("target").agg(
        F.max(F.when(F.col(group) == first, F.col("distance"))).alias(f"{first}_distance"),
        F.max(F.when(F.col(group) == second, F.col("distance"))).alias(f"{second}_distance"),
    )
    a, b = F.col(f"{first}_distance"), F.col(f"{second}_distance")
    return d.withColumn(
        "closer_group",
        F.when(F.abs(a - b) > 1e-4, F.when(a < b, first).otherwise(second)),
    )


def clamp_z(z: Column, limit: float = 3.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), z))


def axis_positions(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Each feature clipped between its P2 and P98 and mapped to [−1, 1]."""
    from cuesheet.operators.ordered import quantiles

    q = quantiles(melt(df, keep, features), ["feature"], "value", {"lo": 0.02, "hi": 0.98})
    bounds = {r["feature"]: r for r in q.collect()}  # one row per column

    def position(f):
        if f not in bounds:
            return F.lit(None).cast("double")
        lo, hi = bounds[f]["lo"], bounds[f]["hi"]
        share = (F.col(f) - F.lit(lo)) / F.lit(hi - lo + 1e-9)
        inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
        return F.when(F.col(f).isNotNull(), rnd(inside * 2.0 - 1.0, 3))

    return df.select(*keep, *[position(f).alias(f) for f in features])


def diagnose(
    df: DataFrame, directions: dict[str, int], *, group: str = "group", item: str = "item"
) -> DataFrame:
    """Per item and feature: nearer to the top or the bottom median, percentile inside the top group."""
    long = melt(df, [item, group], list(directions))
    top, bottom = F.col(group) == "top", F.col(group) == "bottom"
    table = rank_table(
        long, ["feature"], "value",
        {"n": F.lit(1), "a": F.coalesce(top.cast("int"), F.lit(0)), "b": F.coalesce(bottom.cast("int"), F.lit(0))},
    )
    med = table.groupBy("feature").agg(
        median_of("value", "a").alias("med_top"), median_of("value", "b").alias("med_bottom")
    )
    pct = rnd(100.0 * (F.col("a_below") + 0.5 * F.col("a")) / F.col("a_total"), 1)
    ranked = attach_by_value(
        long, table.select("feature", "value", "n", "n_total", pct.alias("pct_in_top")), ["feature", "value"], "n"
    )
    sign = F.create_map(*[F.lit(x) for kv in directions.items() for x in kv])
    mid = (F.col("med_top") + F.col("med_bottom")) / 2.0
    up = F.element_at(sign, F.col("feature")) > 0
    like = F.when(up, F.col("value") >= mid).otherwise(F.col("value") <= mid)
    # one row per feature
    return ranked.join(F.broadcast(med), "feature").select(
        item, "feature", "value", "pct_in_top", F.when(like, "top-like").otherwise("bottom-like").alias("verdict")
    )


def diagnosis_summary(rows: DataFrame, item: str = "item") -> DataFrame:
    return rows.groupBy(item).agg(
        F.count("*").alias("judged"), F.count_if(F.col("verdict") == "top-like").alias("n_top_like")
    )
