"""Merges, counts, growth, exports and small column rules over item tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import policy
from cuesheet.operators.ordered import nth, rank_table


def fill_absent(df: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """Left join one column, only when the table does not have it yet."""
    if column in df.columns:
        return df
    return df.join(other.select(key, column), key, "left")


def merge_sources(base: DataFrame, extras: Sequence[DataFrame], key: str) -> DataFrame:
    """Attach columns of several sources: a later source wins over an earlier one, the base over all."""
    merged = None
    for e in extras:
        if merged is None:
            merged = e
            continue
        both = [c for c in e.columns if c in merged.columns and c != key]
        new = e.select(key, *[F.col(c).alias(f"_n_{c}") for c in e.columns if c != key])
        j = merged.join(new, key, "full_outer")
        merged = j.select(
            key,
            *[F.coalesce(f"_n_{c}", c).alias(c) if c in both else F.col(c) for c in merged.columns if c != key],
            *[F.col(f"_n_{c}").alias(c) for c in e.columns if c != key and c not in both],
        )
    if merged is None:
        return base
    add = merged.select(key, *[F.col(c).alias(f"_x_{c}") for c in merged.columns if c != key])
    j = base.join(add, key, "left")
    names = [c for c in merged.columns if c != key]
    return j.select(
        *[F.coalesce(c, f"_x_{c}").alias(c) if c in names else F.col(c) for c in base.columns],
        *[F.col(f"_x_{c}").alias(c) for c in names if c not in base.columns],
    )


def attach_counts(df: DataFrame, keys: Sequence[str], out: str, parts: int = 256) -> DataFrame:
    """Number of rows of its key on every row, without a window over the key.

    Keys holding more than 1/parts of the rows are at most ``parts`` many: these are broadcast, the
    others are joined by shuffle, where none of them is large.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count("*").alias(out))
    total = n.agg(F.coalesce(F.sum(out), F.lit(0)).alias("_t")).first()["_t"]
    hot = F.col(out) * parts > total
    by_hot = df.join(F.broadcast(n.where(hot)), keys)
    rest = df.join(F.broadcast(n.where(hot).select(*keys)), keys, "left_anti").join(n.where(~hot), keys)
    return by_hot.unionByName(rest)


def attach_few(df: DataFrame, few: DataFrame, keys: Sequence[str], most: int = 10_000) -> DataFrame:
    """Inner join with a table that is expected to be small: broadcast after its rows were counted, else shuffled."""
    n = few.limit(most + 1).count()
    return df.join(F.broadcast(few) if n <= most else few, list(keys))


def first_found(df: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(value, seq).alias(value), F.min(seq).alias(seq))


def corpus_metadata(df: DataFrame, collected: str) -> DataFrame:
    day = F.substring(F.col(collected).cast("string"), 1, 10)
    return df.agg(F.count("*").alias("n"), F.min(day).alias("collection_start"), F.max(day).alias("collection_end"))


def growth(first: DataFrame, last: DataFrame, item: str, value: str, group: str) -> DataFrame:
    """Increase and percentage between two snapshots; both counts must be known."""
    a = first.select(item, F.col(value).alias("_a")).where(F.col("_a").isNotNull())
    b = last.select(item, group, F.col(value).alias("_b")).where(F.col("_b").isNotNull())
    d = F.col("_b") - F.col("_a")
    return b.join(a, item).select(
        item, group, d.alias("increase"), F.when(F.col("_a") != 0, d / F.col("_a") * 100.0).otherwise(0.0).alias("pct")
    )


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Element n // 2 of the sorted values per group."""
    table = rank_table(rows, [group], value)
    return table.groupBy(group).agg(
        nth(value, F.floor(F.col("n_total") / 2)).alias("upper_median"), F.max("n_total").alias("n")
    )


def public_export(
    domains: dict[str, DataFrame], extras: dict[str, Sequence[DataFrame]], key: str, drop: Sequence[str]
) -> DataFrame:
    """Union of domains with a domain column, derived columns joined on, raw-text columns removed."""
    out = None
    for name, df in domains.items():
        part = df.withColumn("domain", F.lit(name))
        for e in extras.get(name, ()):
            part = part.join(e, key, "left")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.drop(*drop)


def feature_map(features: Sequence[str]) -> Column:
    """map<string, string> of the non-null features of a row."""
    names = sorted(features)
    pairs = F.map_from_arrays(
        F.array(*[F.lit(c) for c in names]), F.array(*[F.col(c).cast("string") for c in names])
    )
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def numeric_value(df: DataFrame, key: str, features: str = "features") -> Column:
    """The direct column, else the entry of the feature map; not-a-number is missing."""
    direct = F.col(key).cast("double") if key in df.columns else F.lit(None).cast("double")
    v = F.coalesce(direct, F.element_at(F.col(features), F.lit(key)).cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def feature_metadata(df: DataFrame) -> DataFrame:
    """(feature, kind, status) of the known columns a table has."""
    rows = [
        (c, policy.kind_of(c) or "numeric", "experimental" if c.startswith(policy.EXPERIMENTAL_PREFIXES) else "formal")
        for c in df.columns
        if policy.kind_of(c) or c.startswith(policy.EXPERIMENTAL_PREFIXES)
    ]
    return df.sparkSession.createDataFrame(rows, "feature string, kind string, status string")


def explorer(df: DataFrame, domain: str = "all", group: str = "all", needle: str = "") -> DataFrame:
    """Filter by domain, group and a case-insensitive part of title or channel."""
    if domain != "all":
        df = df.where(F.col("domain") == domain)
    if group != "all":
        df = df.where(F.col("group") == group)
    needle = needle.strip().lower()
    if needle:
        df = df.where(F.contains(F.lower(F.concat_ws(" ", "title", "channel")), F.lit(needle)))
    return df


# ------------------------------------------------------------- caption tracks

NON_TEXT_TRACKS = ("live_chat",)


def base_language(code: Column) -> Column:
    return F.lower(F.element_at(F.split(F.coalesce(code, F.lit("")), "-"), 1))


def track_summary(df: DataFrame, manual: str, automatic: str, lang: str) -> DataFrame:
    """Track lists without live chat and whether one is in the original language."""
    def codes(c):
        return F.array_sort(F.array_except(F.coalesce(F.map_keys(F.col(c)), F.array().cast("array<string>")), F.array(*[F.lit(x) for x in NON_TEXT_TRACKS])))

    want = base_language(F.col(lang))

    def original(c):
        return F.coalesce(F.col(lang) != "", F.lit(False)) & F.exists(codes(c), lambda x: base_language(x) == want)

    return df.withColumns({
        "manual_langs": codes(manual),
        "n_manual": F.size(codes(manual)).cast("bigint"),
        "has_original_lang_track": original(manual),
        "has_auto": F.size(codes(automatic)) > 0,
        "auto_has_original_lang": original(automatic),
    })


def scan_summary(df: DataFrame, source: str = "lyrics_source", error: str = "error") -> DataFrame:
    """Counts per source; failed scans are left out."""
    ok = df.where(F.col(error).isNull() | (F.col(error) == ""))
    orig = F.col("has_original_lang_track")
    return ok.groupBy(F.coalesce(source, F.lit("None")).alias(source)).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("n_manual") > 0).alias("with_manual_track"),
        F.count_if(orig).alias("with_original_track"),
    )


def recoverable(df: DataFrame, source: str = "lyrics_source", error: str = "error") -> DataFrame:
    """Items without text that have an original track, and items that could be upgraded, as rows."""
    ok = df.where((F.col(error).isNull() | (F.col(error) == "")) & F.col("has_original_lang_track"))
    kind = F.when(F.coalesce(source, F.lit("")) == "", "recoverable").when(F.col(source) == "asr", "upgradable")
    return ok.withColumn("kind", kind).where(F.col("kind").isNotNull())


def choose_source(first_lines: Column, second_lines: Column, min_first: int = 8) -> Column:
    """First source with enough lines, else the second when it has any, else none."""
    return F.when(first_lines >= min_first, "ocr").when(second_lines > 0, "asr")


def hardsub(text_frames: Column, total_frames: Column, min_ratio: float = 0.1) -> Column:
    return F.when(total_frames > 0, text_frames / total_frames >= min_ratio)


def in_vocabulary(values: Column, vocabulary: Sequence[str], most: int) -> Column:
    return F.slice(F.array_intersect(values, F.array(*[F.lit(v) for v in vocabulary])), 1, most)


def rederive(df: DataFrame, protected: Column, before: Column, after: Column, min_lines: int = 8) -> DataFrame:
    """Replace the lines of unprotected rows and refresh the columns that depend on them."""
    new = F.when(protected, before).otherwise(after)
    n0, n1 = F.size(before), F.size(new)
    return df.withColumns({
        "n_before": n0.cast("bigint"),
        "n_lines": n1.cast("bigint"),
        "first_line_s": F.when(n1 > 0, new[0]["t_s"]),
        "rederived": ~protected,
        "passed_before": n0 >= min_lines,
        "passes_now": n1 >= min_lines,
    })
