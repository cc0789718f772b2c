"""Sinks: samples, derived tables, snapshots, guarded replacement, search views."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.sources import snapshots

# Fixed value: columns of a sample file.
SAMPLE_COLUMNS = [
    "group", "video_id", "title", "channel", "view_per_sub", "view_count", "subscriber_count", "upload_date",
]
KIND_FILE = "_kind.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _kind(spark: SparkSession, path: str) -> str | None:
    if not _exists(spark, f"{path}/{KIND_FILE}"):
        return None
    fs, p = _fs(spark, f"{path}/{KIND_FILE}")
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).get("kind")
    finally:
        stream.close()


def guard(spark: SparkSession, path: str, kind: str, inputs: list[str]) -> None:
    """Refuse to write over an input, or over a table of another kind."""
    same = path.rstrip("/")
    if any(same == i.rstrip("/") or i.rstrip("/").startswith(same + "/") for i in inputs):
        raise ValueError(f"output {path} is an input")
    if _exists(spark, path):
        found = _kind(spark, path)
        if found != kind:
            raise ValueError(f"{path} holds {found or 'unknown data'}, not {kind}")


def write_table(df: DataFrame, path: str, kind: str, inputs: list[str] = (), fmt: str = "parquet", **options) -> None:
    """Guarded replacement: written beside the target with its kind, then moved into its place.

    The old table is moved aside first and deleted last, so a crash at any point leaves a whole table, at its
    place or under ``<path>.old-…``. Where a rename is a copy (an object store) readers should expect a gap.
    """
    spark = df.sparkSession
    guard(spark, path, kind, list(inputs))
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    writer = df.write.format(fmt)
    for k, v in options.items():
        writer = writer.option(k, v)
    writer.save(staging)
    fs, mark = _fs(spark, f"{staging}/{KIND_FILE}")
    out = fs.create(mark, True)
    out.write(bytearray(json.dumps({"kind": kind}).encode()))
    out.close()
    _, target = _fs(spark, path)
    aside = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(target)
    if had and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(_fs(spark, staging)[1], target):
        if had:
            fs.rename(aside, target)
        raise OSError(f"could not move {staging} to {path}")
    if had:
        fs.delete(aside, True)


def write_sample(df: DataFrame, path: str, inputs: list[str] = ()) -> None:
    """Sample as CSV with its fixed columns."""
    write_table(df.select(*SAMPLE_COLUMNS), path, "sample", inputs, "csv", header=True)


def write_jsonl(df: DataFrame, path: str, kind: str = "derived", inputs: list[str] = ()) -> None:
    write_table(df, path, kind, inputs, "json")


def write_snapshot(tables: dict[str, DataFrame], path: str) -> str:
    """Every table and a manifest with digests, committed as one; returns the snapshot id. Read with snapshots.read."""
    return snapshots.write(tables, path)


SEARCH_SCHEMAS = {
    "features": "item string, title string, channel string",
    "lines": "item string, t_s double, pos bigint, line string",
    "scenes": "item string, t_s double, pos bigint, blob string",
}


def search_views(spark: SparkSession, **tables: DataFrame | None) -> None:
    """Temporary views of the search tables; an absent one is empty with its schema."""
    for name, schema in SEARCH_SCHEMAS.items():
        df = tables.get(name)
        (df if df is not None else spark.createDataFrame([], schema)).createOrReplaceTempView(f"search_{name}")


def fresh_or_rebuild(spark: SparkSession, root: str, stored: str | None, build, attempts: int = 2) -> tuple[str, bool]:
    """Rebuild only when the sources changed; again, at most twice, when they moved meanwhile."""
    from cuesheet.sources.readers import fingerprint

    now = fingerprint(spark, root)
    if now == stored:
        return now, False
    for _ in range(attempts):
        build()
        after = fingerprint(spark, root)
        if after == now:
            return now, True
        now = after
    raise RuntimeError("sources keep changing during the build")
