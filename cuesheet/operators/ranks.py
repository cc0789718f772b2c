"""Rank statistics from counts of distinct values.

Every test works on a rank table (see ``ordered.rank_table``): counts per (feature, value), never
the rows of a feature in one task. Only one summary row per test reaches the p-value functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuesheet.functions import pvalues
from cuesheet.functions.numbers import finite
from cuesheet.operators.ordered import attach_by_value, median_of, rank_table
from cuesheet.session import materialise


def melt(
    df: DataFrame, keep: Sequence[str], features: Sequence[str], dtype: str = "double"
) -> DataFrame:
    """Wide to long: (keep…, feature, value) without the missing values; NaN and infinities are missing."""
    cast = finite if dtype == "double" else lambda c: F.col(c).cast(dtype)
    wide = df.select(*keep, *[cast(c).alias(c) for c in features])
    return wide.unpivot(list(keep), list(features), "feature", "value").where(
        F.col("value").isNotNull()
    )


def magnitude(delta: Column) -> Column:
    a = F.abs(delta)
    # fixed values: class limits of the effect size
    return (
        F.when(a < 0.147, "negligible").when(a < 0.33, "small").when(a < 0.474, "medium")
        .otherwise("large")
    )


def bh(df: DataFrame, family: Sequence[str], p: str = "p", tie: str = "feature", out: str = "q") -> DataFrame:
    """Benjamini–Hochberg over the tested rows of a family (one row per feature)."""
    fam = Window.partitionBy(*family)
    rank = F.row_number().over(fam.orderBy(p, tie))
    df = df.withColumn("_rank", rank).withColumn("_m", F.count("*").over(fam))
    from_end = fam.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(from_end))
    return df.withColumn(out, q).drop("_rank", "_m")


def _cube(t: Column) -> Column:
    t = t.cast("double")
    return t * t * t - t


def compare_groups(
    long: DataFrame,
    *,
    first: str = "top",
    second: str = "bottom",
    group: str = "group",
    keys: Sequence[str] = (),
    min_n: int = 10,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """U, Cliff's delta, medians, p and BH q of two groups per (keys, feature)."""
    cols = [*keys, "feature"]
    two = long.where(F.col(group).isin(first, second))
    table = rank_table(
        two, cols, "value",
        {"a": (F.col(group) == first).cast("int"), "b": (F.col(group) == second).cast("int")},
        cuts=cuts,
    )
    d = lambda c: F.col(c).cast("double")
    s = table.groupBy(*cols).agg(
        F.max("a_total").alias("n_top"),
        F.max("b_total").alias("n_bot"),
        median_of("value", "a").alias("med_top"),
        median_of("value", "b").alias("med_bot"),
        F.sum(d("a") * (d("b_below") + d("b") / 2.0)).alias("u"),
        F.sum(_cube(F.col("a") + F.col("b"))).alias("tie_term"),
    )
    s = s.where((F.col("n_top") >= min_n) & (F.col("n_bot") >= min_n))
    s = s.withColumn("delta", 2.0 * F.col("u") / (d("n_top") * d("n_bot")) - 1.0)
    s = s.withColumn("p", pvalues.mann_whitney_p("u", "n_top", "n_bot", "tie_term"))
    return bh(s, keys).withColumn("magnitude", magnitude(F.col("delta")))


def trend(
    long: DataFrame,
    order: Sequence[str],
    *,
    group: str = "group",
    keys: Sequence[str] = (),
    min_n: int = 3,
) -> DataFrame:
    """Monotone trend over ordered groups: Kendall tau-b of group rank and value."""
    cols = [*keys, "feature"]
    w = [f"g{i}" for i in range(len(order))]
    table = rank_table(
        long.where(F.col(group).isin(*order)), cols, "value",
        {c: (F.col(group) == g).cast("int") for c, g in zip(w, order)},
    )
    d = lambda c: F.col(c).cast("double")
    tie = sum((d(c) for c in w[1:]), d(w[0]))
    wins = sum(
        (
            d(w[j]) * (2.0 * d(f"{w[i]}_below") + d(w[i]))
            for i in range(len(w)) for j in range(i + 1, len(w))
        ),
        F.lit(0.0),
    )
    s = table.groupBy(*cols).agg(
        *[F.max(f"{c}_total").alias(f"n_{g}") for c, g in zip(w, order)],
        *[median_of("value", c).alias(f"med_{g}") for c, g in zip(w, order)],
        F.sum(wins).alias("_wins"),
        F.sum(tie * (tie - 1.0) / 2.0).alias("_ny"),
        F.sum(tie * (tie - 1.0) * (2.0 * tie + 5.0)).alias("_vy"),
        F.sum(tie * (tie - 1.0) * (tie - 2.0)).alias("_y3"),
    )
    ns = [d(f"n_{g}") for g in order]
    for g in order:
        s = s.where(F.col(f"n_{g}") >= min_n)
    cross = sum((ns[i] * ns[j] for i in range(len(ns)) for j in range(i + 1, len(ns))), F.lit(0.0))
    total = sum(ns[1:], ns[0])
    nx = sum((g * (g - 1.0) / 2.0 for g in ns), F.lit(0.0))
    s = s.withColumns({
        "_s": F.col("_wins") - cross,
        "_n": total,
        "_nx": nx,
        "_vx": sum((g * (g - 1.0) * (2.0 * g + 5.0) for g in ns), F.lit(0.0)),
        "_x3": sum((g * (g - 1.0) * (g - 2.0) for g in ns), F.lit(0.0)),
    })
    n0 = F.col("_n") * (F.col("_n") - 1.0) / 2.0
    spread = (n0 - F.col("_nx")) * (n0 - F.col("_ny"))
    s = s.withColumn("stat", F.when(spread > 0, F.col("_s") / F.sqrt(spread)))
    s = s.withColumn(
        "p", pvalues.kendall_p("_s", "_n", "_nx", "_ny", "_vx", "_vy", "_x3", "_y3")
    )
    meds = [F.col(f"med_{g}") for g in order]
    up = F.lit(True)
    down = F.lit(True)
    for a, b in zip(meds, meds[1:]):
        up, down = up & (a <= b), down & (a >= b)
    s = bh(s, keys).withColumn(
        "median_order", F.when(up, "increasing").when(down, "decreasing").otherwise("non-monotone")
    )
    ordered = F.col("median_order") != "non-monotone"
    s = s.withColumn(
        "verdict",
        F.when(ordered & (F.col("q") < 0.05), "holds").when(ordered, "direction only")
        .otherwise("does not hold"),
    )
    return s.drop(*[c for c in s.columns if c.startswith("_")])


def two_by_two(
    df: DataFrame,
    features: Sequence[str],
    *,
    group: str = "group",
    keys: Sequence[str] = (),
    min_n: int = 10,
) -> DataFrame:
    """Yes and non-null counts of boolean columns per group with the exact p."""
    long = melt(df, [*keys, group], features, "boolean")
    yes, top, bot = F.col("value"), F.col(group) == "top", F.col(group) == "bottom"
    s = long.groupBy(*keys, "feature").agg(
        F.count_if(top & yes).alias("top"),
        F.count_if(top).alias("n_top"),
        F.count_if(bot & yes).alias("bottom"),
        F.count_if(bot).alias("n_bottom"),
    )
    s = s.where((F.col("n_top") >= min_n) & (F.col("n_bottom") >= min_n))
    return s.withColumn(
        "p",
        pvalues.fisher_p(
            F.col("top"), F.col("n_top") - F.col("top"),
            F.col("bottom"), F.col("n_bottom") - F.col("bottom"),
        ),
    )


def top_categories(
    df: DataFrame,
    features: Sequence[str],
    k: int,
    *,
    group: str = "group",
    keys: Sequence[str] = (),
    drop_empty: bool = False,
) -> DataFrame:
    """The k most frequent values per categorical column with their group counts."""
    long = melt(df, [*keys, group], features, "string").where(F.col(group).isin("top", "bottom"))
    if drop_empty:
        long = long.where(F.col("value") != "")
    counts = long.groupBy(*keys, "feature", "value").agg(
        F.count_if(F.col(group) == "top").alias("top"),
        F.count_if(F.col(group) == "bottom").alias("bottom"),
        F.count("*").alias("_all"),
    )
    w = Window.partitionBy(*keys, "feature").orderBy(F.col("_all").desc(), "value")
    return (
        counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint")).drop("_all")
    )


def spearman(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    *,
    keys: Sequence[str] = (),
    min_n: int = 3,
    with_p: bool = False,
) -> DataFrame:
    """Rank correlation of column pairs, complete cases per pair; NaN and infinities are missing."""
    s = _rank_corr(df, list(dict.fromkeys(pairs)), keys, 0, min_n, 300)
    return s.withColumn("p", pvalues.spearman_p("rho", "n")) if with_p else s


def spearman_matrix(
    df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = (), min_finite: int = 20, min_n: int = 3, block: int = 300,
) -> DataFrame:
    """Rank correlation of every pair of columns, complete cases per pair; columns with fewer than min_finite finite
    values of a key are left out there. Columns: keys, feature_a, feature_b, n, rho (null if a side is constant)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        raise ValueError("two columns at least")
    return _rank_corr(df, pairs, keys, min_finite, min_n, block)


#: Row sets that one row of a column is counted for at once.
SETS = 8
#: Values with more than this share of all rows are broadcast with their ranks: fewer than 65,536, whatever the input.
HOT_VALUES = 1 << 16


def _rank_corr(
    df: DataFrame, pairs: Sequence[tuple[str, str]], keys: Sequence[str], min_finite: int, min_n: int, block: int
) -> DataFrame:
    """Correlation of centred midranks (2·rank − n − 1, integers) of column pairs.

    A pair ranks each side among the rows where both are finite. Such a row set is shared by all partners that are
    missing in the same rows; the sets are told apart by their size and the xor of their rows' hashes, one aggregate row.
    A column is melted once, its values are counted for each of its sets, and the ranks in all sets go back to the rows
    together; values that many rows share by broadcast. Ranks then meet per row, and sums of their products give all pairs.
    """
    keys = list(keys)
    columns = list(dict.fromkeys(c for p in pairs for c in p))
    at = [(columns.index(a), columns.index(b)) for a, b in pairs]
    values = [finite(c).alias(f"_v{i}") for i, c in enumerate(columns)]
    rows = materialise(df.select(*keys, *values).withColumn("_id", F.monotonically_increasing_id()))
    have = [F.col(f"_v{i}").isNotNull() for i in range(len(columns))]
    marked, marks = rows.withColumn("_h", F.xxhash64("_id")), {}
    for k in range(0, len(at), block):
        part = at[k : k + block]
        row = marked.agg(*[
            c for i, j in part
            for c in (F.count_if(have[i] & have[j]).alias(f"n{i}_{j}"), F.bit_xor(F.when(have[i] & have[j], F.col("_h"))).alias(f"h{i}_{j}"))
        ]).first()
        marks |= {(i, j): (row[f"n{i}_{j}"], row[f"h{i}_{j}"]) for i, j in part}
    sets: dict[tuple, int] = {}  # (column, mark of a row set) -> a partner that stands for the set
    of: dict[tuple[int, int], int] = {}  # (column, partner) -> the partner that stands for it
    for i, j in at:
        for a, b in ((i, j), (j, i)):
            of[a, b] = sets.setdefault((a, marks[i, j]), b)
    asked = sorted({(a, b) for (a, _), b in of.items()})
    partners = {a: [b for c, b in asked if c == a] for a, _ in asked}
    groups = [(a, bs[k : k + SETS]) for a, bs in partners.items() for k in range(0, len(bs), SETS)]
    width = range(max(len(bs) for _, bs in groups))
    long = rows.select(*keys, "_id", F.explode(F.array(*[
        F.struct(F.lit(g).alias("_g"), F.col(f"_v{a}").alias("_x"), *[(have[bs[v]] if v < len(bs) else F.lit(False)).alias(f"_in{v}") for v in width])
        for g, (a, bs) in enumerate(groups)
    ])).alias("_c")).select(*keys, "_id", "_c.*").where(F.col("_x").isNotNull())
    on = [*keys, "_g", "_x"]
    counted = {"_n": F.lit(1), **{f"_w{v}": F.col(f"_in{v}").cast("int") for v in width}}
    centred = [(2 * F.col(f"_w{v}_below") + F.col(f"_w{v}") - F.col(f"_w{v}_total")).cast("double").alias(f"_r{v}") for v in width]
    table = rank_table(long, [*keys, "_g"], "_x", counted).select(*on, *centred, "_n")
    ranked = attach_by_value(long, table, on, "_n", HOT_VALUES)
    wide = materialise(ranked.groupBy(*keys, "_id").agg(*[
        F.max(F.when((F.col("_g") == g) & F.col(f"_in{v}"), F.col(f"_r{v}"))).alias(f"_r{a}_{b}")
        for g, (a, bs) in enumerate(groups) for v, b in enumerate(bs)
    ]))
    out = None
    for k in range(0, len(at), block):
        part = at[k : k + block]
        # a rank is there exactly for the rows of its set, so both sides of a pair have theirs in the same rows
        sides = sorted({(a, of[a, b]) for i, j in part for a, b in ((i, j), (j, i))})
        r = {s: F.col("_r{}_{}".format(*s)) for s in sides}
        sums = [c for (a, b), x in r.items() for c in (F.count(x).alias(f"_n{a}_{b}"), F.sum(x * x).alias(f"_q{a}_{b}"))]
        sums += [F.sum(r[i, of[i, j]] * r[j, of[j, i]]).alias(f"_p{i}_{j}") for i, j in part]
        each = [
            F.struct(F.lit(columns[i]).alias("feature_a"), F.lit(columns[j]).alias("feature_b"), F.lit(i).alias("_i"), F.lit(j).alias("_j"),
                     F.col(f"_n{i}_{of[i, j]}").alias("n"), F.col(f"_p{i}_{j}").alias("_xy"),
                     F.col(f"_q{i}_{of[i, j]}").alias("_xx"), F.col(f"_q{j}_{of[j, i]}").alias("_yy"))
            for i, j in part
        ]
        some = wide.groupBy(*keys).agg(*sums).select(*keys, F.explode(F.array(*each)).alias("_s")).select(*keys, "_s.*")
        out = some if out is None else out.unionByName(some)
    if min_finite > min_n:
        enough = rows.groupBy(*keys).agg(F.array(*[F.count(f"_v{i}") for i in range(len(columns))]).alias("_counts"))
        # without keys both sides are one row
        out = out.join(enough, keys) if keys else out.join(F.broadcast(enough), F.lit(True))
        out = out.where((F.col("_counts")[F.col("_i")] >= min_finite) & (F.col("_counts")[F.col("_j")] >= min_finite))
    spread = F.col("_xx") * F.col("_yy")
    return out.where(F.col("n") >= min_n).select(
        *keys, "feature_a", "feature_b", "n", F.when(spread > 0, F.col("_xy") / F.sqrt(spread)).alias("rho")
    )


def signed_rank(df: DataFrame, diff: str, keys: Sequence[str] = (), min_n: int = 10, method: str = "auto") -> DataFrame:
    """Wilcoxon signed-rank of pair differences; zeros are dropped, ties averaged, NaN and infinities missing.

    method: normal, exact (no ties and no zeros, else null) or auto (exact up to 50 differences without ties and
    zeros). A key with zeros only has n_used 0 and w_plus 0, and p 1: nothing speaks against symmetry.
    """
    if method not in ("auto", "normal", "exact"):
        raise ValueError(f"unknown method {method}")
    rows = df.withColumn(diff, finite(diff))
    d = F.col(diff)
    rows = rows.where(d.isNotNull()).withColumn("_abs", F.abs(d))
    zeros = rows.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.count_if(d == 0).alias("zeros")
    )
    table = rank_table(
        rows.where(d != 0), keys, "_abs", {"n": F.lit(1), "pos": (d > 0).cast("int")}
    )
    t = F.col("n").cast("double")
    rank = F.col("n_below").cast("double") + (t + 1.0) / 2.0
    s = table.groupBy(*keys).agg(
        F.max("n_total").alias("n_used"),
        F.sum(F.col("pos") * rank).alias("w_plus"),
        F.sum(_cube(F.col("n"))).alias("tie_term"),
    )
    # without keys both sides are one row
    out = zeros.join(s, list(keys), "left") if keys else zeros.join(F.broadcast(s), F.lit(True), "left")
    out = out.where(F.col("n_pairs") >= min_n).na.fill(0, ["n_used", "w_plus", "tie_term"])
    p = pvalues.wilcoxon_p[method]("w_plus", "n_used", "tie_term", "zeros")
    return out.withColumn("p", F.when(F.col("n_used") == 0, 1.0).otherwise(p))
