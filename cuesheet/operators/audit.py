"""Quality checks as tables of findings, and order-neutral content digests."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuesheet.functions import policy
from cuesheet.operators.tables import attach_few

FINDING = "level string, check string, subject string, n bigint"


def table_audit(
    df: DataFrame,
    numeric: Sequence[str],
    others: Sequence[str] = (),
    *,
    group: str = "group",
    groups: Sequence[str] = ("top", "bottom"),
    min_n: int = 10,
) -> DataFrame:
    """Findings (level, check, subject, n) on a formal feature table.

    One aggregate over the wide table: counts per column and group are columns of its single row,
    so nothing is unpivoted and nothing but the row is shuffled.
    """
    present = [c for c in numeric if c in df.columns]
    val = {c: F.col(c).cast("double") for c in present}
    bad = {c: F.isnan(v) | (F.abs(v) == float("inf")) for c, v in val.items()}
    ok = {c: v.isNotNull() & ~F.coalesce(bad[c], F.lit(False)) for c, v in val.items()}
    is_group = {g: F.coalesce(F.col(group) == g, F.lit(False)) for g in groups}
    aggs = [F.count("*").alias("rows"), *[F.count_if(is_group[g]).alias(f"g_{g}") for g in groups]]
    for c in present:
        aggs += [
            F.count_if(F.coalesce(bad[c], F.lit(False))).alias(f"b_{c}"),
            F.min(F.when(ok[c], val[c])).alias(f"lo_{c}"),
            F.max(F.when(ok[c], val[c])).alias(f"hi_{c}"),
            *[F.count_if(ok[c] & is_group[g]).alias(f"n_{g}_{c}") for g in groups],
        ]
    one = df.agg(*aggs)

    def finding(cond: Column, level: str, check: str, subject: str, n: Column) -> Column:
        return F.when(
            cond,
            F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), F.lit(subject).alias("subject"), n.cast("bigint").alias("n")),
        )

    zero = F.lit(0)
    found = [finding(F.col("rows") == 0, "error", "empty table", "table", zero)]
    found += [finding(F.col(f"g_{g}") < min_n, "error", "group size", g, F.col(f"g_{g}")) for g in groups]
    missing = sorted((set(numeric) | set(others)) - set(df.columns))
    found += [finding(F.lit(True), "warning", "missing column", c, zero) for c in missing]
    experimental = sorted(c for c in df.columns if c.startswith(policy.EXPERIMENTAL_PREFIXES))
    found += [finding(F.lit(True), "info", "experimental column", c, zero) for c in experimental]
    for c in present:
        clean = F.col(f"b_{c}") == 0
        found.append(finding(~clean, "error", "non-finite", c, F.col(f"b_{c}")))
        found.append(finding(clean & (F.col(f"lo_{c}") == F.col(f"hi_{c}")), "warning", "constant", c, F.lit(1)))
        found += [
            finding(clean & (F.col(f"n_{g}_{c}") < min_n), "warning", "low coverage", f"{c}:{g}", F.col(f"n_{g}_{c}"))
            for g in groups
        ]
    return one.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")


def dataset_invariants(
    df: DataFrame,
    item: str,
    *,
    rows: int | None = None,
    columns: Sequence[int] | None = None,
    counts: dict[str, dict[str, int]] | None = None,
) -> DataFrame:
    """Checks (check, expected, actual, ok) of a table against its specification.

    Distinct ids are counted in two steps (per id, then in total), so copies of one id collapse early.
    """
    per = df.groupBy(item).agg(F.count("*").alias("_c"))
    empty = F.col(item).isNull() | (F.col(item).cast("string") == "")
    ids = per.agg(
        F.sum("_c").alias("rows"), F.count("*").alias("ids"), F.coalesce(F.sum(F.when(empty, F.col("_c"))), F.lit(0)).alias("empty")
    )
    checks = [
        F.struct(F.lit("unique ids").alias("check"), F.col("rows").alias("expected"), F.col("ids").alias("actual")),
        F.struct(F.lit("empty ids").alias("check"), F.lit(0).cast("bigint").alias("expected"), F.col("empty").alias("actual")),
    ]
    if rows is not None:
        checks.append(F.struct(F.lit("rows").alias("check"), F.lit(rows).cast("bigint").alias("expected"), F.col("rows").alias("actual")))
    if columns is not None:
        n = len(df.columns)
        want = n if n in columns else columns[0]
        checks.append(F.struct(F.lit("columns").alias("check"), F.lit(want).cast("bigint").alias("expected"), F.lit(n).cast("bigint").alias("actual")))
    out = ids.select(F.explode(F.array(*checks)).alias("c")).select("c.*")
    if counts:
        exprs, wanted = [], []
        for col, spec in counts.items():
            for value, n in spec.items():
                name = f"{col}={value}"
                exprs.append(F.count_if(F.col(col) == value).alias(name))
                wanted.append((name, n))
        one = df.agg(*exprs)
        rows_ = [F.struct(F.lit(k).alias("check"), F.lit(n).cast("bigint").alias("expected"), F.col(f"`{k}`").alias("actual")) for k, n in wanted]
        out = out.unionByName(one.select(F.explode(F.array(*rows_)).alias("c")).select("c.*"))
    return out.withColumn("ok", F.col("expected") == F.col("actual"))


def consistency(items: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Findings (item, level, finding) from one row of counts and durations per item.

    Columns: summary_scenes, scene_rows, tag_rows, feature_duration, scene_duration,
    audio_duration, line_source, line_rows.
    """
    spans = ("feature_duration", "scene_duration", "audio_duration")
    known = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in spans])
    spread = F.greatest(*spans) - F.least(*spans)
    has_lines = F.coalesce(F.col("line_rows") > 0, F.lit(False))

    def row(cond, level, text):
        return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(text).alias("finding")))

    checks = F.array(
        row(F.col("summary_scenes") != F.coalesce("scene_rows", F.lit(0)), "error", "scene count mismatch"),
        row((F.col("scene_rows") > 0) & (F.col("tag_rows") != F.col("scene_rows")), "error", "scene/tag count mismatch"),
        row((known >= 2) & (spread > tolerance), "error", "duration mismatch"),
        row(F.col("line_source").isNull() & has_lines, "warning", "lines without a source"),
        row(F.col("line_source").isNotNull() & ~has_lines, "warning", "source without lines"),
    )
    return items.select("item", F.explode(F.array_compact(checks)).alias("f")).select("item", "f.*")


def completeness(presence: DataFrame, artifacts: Sequence[str] = policy.CORE_ARTIFACTS) -> DataFrame:
    """presence(item, artifact) → per item the missing artifacts; complete when there are none.

    Only names of the list are looked at, one flag each; other artifacts of an item don't count.
    """
    have = presence.groupBy("item").agg(*[F.max(F.col("artifact") == a).alias(f"_{k}") for k, a in enumerate(artifacts)])
    lacking = [F.when(F.coalesce(F.col(f"_{k}"), F.lit(False)), None).otherwise(F.lit(a)) for k, a in enumerate(artifacts)]
    missing = F.array_sort(F.array_compact(F.array(*lacking)))
    return have.select("item", missing.alias("missing"), (F.size(missing) == 0).alias("complete"))


def schema_variants(raw: DataFrame, item: str, text: str) -> DataFrame:
    """Number of documents per key set of a JSON text column."""
    keys = F.array_sort(F.json_object_keys(F.col(text)))
    sig = F.substring(F.sha2(F.array_join(keys, "\n"), 256), 1, 12)
    return raw.groupBy(sig.alias("signature")).agg(
        F.count("*").alias("n"), F.max(F.size(keys)).cast("bigint").alias("n_keys"), F.min(item).alias("sample_item")
    )


# ------------------------------------------------------------- digests


def row_digest(df: DataFrame, exclude: Sequence[str] = ()) -> Column:
    """sha-256 of sorted key=value pairs; nulls are left out, line endings are neutral."""
    parts = []
    for c in sorted(set(df.columns) - set(exclude)):
        v = F.regexp_replace(F.col(c).cast("string"), r"\r\n?", "\n")
        parts.append(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), v)))
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def table_digest(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Digest of a table as a set of rows: independent of order, partitioning and column order.

    The row digests are added up in four 60-bit lanes, which combines on the map side; no list of
    digests is ever gathered.
    """
    d = df.select(row_digest(df, exclude).alias("d"))
    lanes = [
        F.sum(F.conv(F.substring("d", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"l{i}") for i in range(4)
    ]
    one = d.agg(F.count("*").alias("n"), *lanes)
    text = F.concat_ws(":", "n", *[F.coalesce(F.col(f"l{i}"), F.lit(0)).cast("decimal(38,0)").cast("string") for i in range(4)])
    return one.select("n", F.sha2(text, 256).alias("digest"))


def snapshot_manifest(tables: dict[str, DataFrame]) -> tuple[DataFrame, str]:
    """Per-table digests and the snapshot id over the sorted ``name:digest`` lines."""
    parts = None
    for name, df in sorted(tables.items()):
        row = table_digest(df).select(F.lit(name).alias("name"), "n", "digest")
        parts = row if parts is None else parts.unionByName(row)
    return parts, "sha2(array_join(array_sort(collect_list(concat(name, ':', digest))), '\\n'), 256)"


def stale_artifacts(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Artifacts whose stored fingerprint differs from the current one; none stored is never stale."""
    cur = current.select("artifact", F.col("fingerprint").alias("current"))
    both = attach_few(manifest.where(F.col("fingerprint").isNotNull()), cur, ["artifact"])
    return both.where(F.col("fingerprint") != F.col("current"))
