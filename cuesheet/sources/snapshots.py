"""Snapshots of several tables that readers see whole or not at all.

A snapshot's tables are written into a folder of their own under `versions/`, then one small file under `commits/`
names the folder. Commit files are numbered and created without overwriting, so two writers can't take one number, and
nothing that readers use is ever moved or replaced: there is no rename, and an object store does as well as a file system.
A reader takes the commit of the highest number that is complete. A writer that dies at any point leaves a folder that no
commit names, and the snapshot before stays readable.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.operators.audit import snapshot_manifest

ATTEMPTS = 20


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _at(spark, f"{path}/commits")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _commit(spark: SparkSession, path: str, number: int) -> dict | None:
    """A commit, or nothing if its writer died before its last byte."""
    fs, p = _at(spark, f"{path}/commits/{number:012d}.json")
    stream = fs.open(p)
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()
    return found if isinstance(found, dict) and {"version", "tables", "id"} <= found.keys() else None


def _create(spark: SparkSession, path: str, number: int, commit: dict) -> bool:
    """Create a commit file; False if another writer has the number."""
    fs, p = _at(spark, f"{path}/commits/{number:012d}.json")
    try:
        out = fs.create(p, False)
    except Exception as e:  # the driver's JVM reports it as a Java error
        if "FileAlreadyExists" in str(e) or "already exists" in str(e):
            return False
        raise
    out.write(bytearray(json.dumps(commit, sort_keys=True).encode()))
    out.close()
    return True


def current(spark: SparkSession, path: str) -> dict | None:
    """The newest complete commit: number, version, tables (name → schema) and id; nothing if there is none."""
    for n in reversed(_numbers(spark, path)):
        found = _commit(spark, path, n)
        if found:
            return {"number": n, **found}
    return None


def write(tables: dict[str, DataFrame], path: str, step: Callable[[str], None] = lambda name: None) -> str:
    """Write all tables and their manifest, then commit; returns the snapshot id, a digest of the contents.

    step is called with the name of what has just been written, for reports of progress.
    """
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    version = uuid.uuid4().hex
    for name, df in sorted(tables.items()):
        df.write.parquet(f"{path}/versions/{version}/{name}")
        step(name)
    # digests are of what was written, not of a plan that may run again on other data
    written = {name: spark.read.schema(df.schema).parquet(f"{path}/versions/{version}/{name}") for name, df in tables.items()}
    manifest, snapshot_id = snapshot_manifest(written)
    manifest.write.parquet(f"{path}/versions/{version}/_manifest")
    step("_manifest")
    stored = spark.read.schema(manifest.schema).parquet(f"{path}/versions/{version}/_manifest")
    commit = {
        "version": version, "id": stored.agg(F.expr(snapshot_id).alias("id")).first()["id"],
        "tables": {name: df.schema.json() for name, df in tables.items()},
    }
    for _ in range(ATTEMPTS):
        if _create(spark, path, max(_numbers(spark, path), default=0) + 1, commit):
            return commit["id"]
    raise RuntimeError(f"{ATTEMPTS} other snapshots were committed to {path} meanwhile")


def read(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """Tables of the newest snapshot, all from one version; all of them if none is named."""
    from pyspark.sql.types import StructType

    path = path.rstrip("/")
    found = current(spark, path)
    if not found:
        raise FileNotFoundError(f"{path} holds no complete snapshot")
    missing = set(names) - found["tables"].keys()
    if missing:
        raise KeyError(f"the snapshot has no table {', '.join(sorted(missing))}")
    kind = {n: StructType.fromJson(json.loads(found["tables"][n])) for n in names or found["tables"]}
    return {n: spark.read.schema(k).parquet(f"{path}/versions/{found['version']}/{n}") for n, k in kind.items()}


def verify(spark: SparkSession, path: str) -> bool:
    """Whether the newest snapshot's tables still have the contents that its id was made of."""
    tables = read(spark, path)
    manifest, snapshot_id = snapshot_manifest(tables)
    return manifest.agg(F.expr(snapshot_id).alias("id")).first()["id"] == current(spark, path)["id"]


def prune(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete the versions of all but the newest `keep` complete commits; returns how many went.

    Folders that no commit names may belong to a writer at work and stay.
    """
    path = path.rstrip("/")
    complete = [c for n in _numbers(spark, path) if (c := _commit(spark, path, n))]
    kept = {c["version"] for c in complete[-keep:]} if keep else set()
    gone = 0
    for c in complete:
        fs, p = _at(spark, f"{path}/versions/{c['version']}")
        if c["version"] not in kept and fs.exists(p):
            gone += bool(fs.delete(p, True))
    return gone
