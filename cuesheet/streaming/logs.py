"""Append-only inputs: resumable logs, dated snapshots and time bins.

Every job runs with ``availableNow``: it takes what is there, records its progress in the
checkpoint and stops. Without a watermark only closed inputs may be deduplicated, so the
unbounded forms bound their state with one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType


#: Parts of a log that rows are dealt to by the hash of their key.
BUCKETS = 256


def _run_name(spark: SparkSession, checkpoint: str) -> str:
    """Name of the run that a checkpoint folder belongs to: made once, in the folder, and lost with it.

    The file is created without overwriting and read back, so two starts at one time agree on the name. If its writer
    died before it wrote a name, the time of the file is the name.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/run-name")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        try:
            out = fs.create(path, False)
            out.write(bytearray(f"r{uuid.uuid4().hex}".encode()))
            out.close()
        except Exception:
            if not fs.exists(path):  # not another start's file, so a real error
                raise
    stream = fs.open(path)
    try:
        name = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return name or f"r{fs.getFileStatus(path).getModificationTime()}"


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.concat(F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("string"), F.lit(f"-of-{buckets}"))


def _logged(spark: SparkSession, output: str, touched: Sequence[str], buckets: int) -> DataFrame | None:
    """The rows of the touched parts of a log; other parts are neither listed nor read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(output)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = {s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()}
    other = sorted(n for n in names if not n.startswith("_") and not (n.startswith("bucket=") and n.endswith(f"-of-{buckets}")))
    if other:
        raise ValueError(f"{output} is no log of {buckets} parts: it holds {other[0]}")
    paths = [f"{output.rstrip('/')}/bucket={b}" for b in touched if f"bucket={b}" in names]
    return spark.read.option("basePath", output).parquet(*paths) if paths else None


def append_new(
    stream: DataFrame,
    keys: Sequence[str],
    output: str,
    checkpoint: str,
    work: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append rows whose key is not yet in the log; work done for them may record failures as rows.

    The log itself decides what is done, so a restart with a lost checkpoint repeats nothing. It is dealt out by the
    hash of the key to a fixed number of parts, and a batch looks only into the parts that its own keys fall
    in, so what a batch reads follows the batch and not the history. A retried batch replaces its own partitions of
    the log instead of appending twice: partitions are (bucket, run, epoch), and the name of the run lies in the
    checkpoint, so a new checkpoint, whose epochs start again at 0, never touches what an earlier run has logged.
    Rows with a null in their key are keys like any other.
    """
    keys = list(keys)
    run = _run_name(stream.sparkSession, checkpoint)

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates(keys)
        touched = sorted(r[0] for r in df.select(_bucket(keys, buckets).alias("b")).distinct().collect())  # `buckets` at most
        log = _logged(spark, output, touched, buckets)
        if log is not None:
            done = log.where((F.col("run") != run) | (F.col("epoch") != epoch)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
            same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
            new = new.join(done, same, "left_anti")
        rows = work(new) if work else new
        rows = rows.withColumns({"bucket": _bucket(keys, buckets), "run": F.lit(run), "epoch": F.lit(epoch)})
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "run", "epoch").parquet(output)

    return (
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def dedup(stream: DataFrame, keys: Sequence[str], event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row per key; with a watermark the state is dropped after ``delay``."""
    if event_time and delay:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def bins(stream: DataFrame, event_time: str, keys: Sequence[str], value: Column, width: str = "10 seconds", delay: str = "1 minute") -> DataFrame:
    """Sum and count per key and tumbling window; late rows count until the watermark passes."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width).alias("w"), *keys)
        .agg(F.sum(value).alias("value"), F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), *keys, "value", "n")
    )


def trailing(stream: DataFrame, event_time: str, keys: Sequence[str], width: str = "30 seconds", step: str = "1 second", delay: str = "1 minute") -> DataFrame:
    """Count per key over sliding windows."""
    return (
        stream.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, width, step).alias("w"), *keys)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.end").alias("at"), *keys, "n")
    )


def growth_state(snapshots: DataFrame, item: str, date: str, value: str) -> DataFrame:
    """First and last known count per item: one small state row per item, works on streams too."""
    known = F.when(F.col(value).isNotNull(), F.col(date))
    s = snapshots.groupBy(item).agg(
        F.min_by(value, known).alias("first"), F.max_by(value, known).alias("last"),
        F.min(known).alias("first_date"), F.max(known).alias("last_date"),
    )
    return s.withColumn("increase", F.col("last") - F.col("first"))


def run_to_latest(df: DataFrame, keys: Sequence[str], output: str, checkpoint: str) -> DataFrame:
    """Drive an aggregated stream over everything available; the last known row of every key, open windows too.

    Every batch writes the keys that it changed under its own number, so a retried batch replaces itself.
    """
    def batch(rows: DataFrame, epoch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{output}/epoch={epoch}")

    df.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*df.schema.fields, StructField("epoch", LongType())])
    values = [c for c in df.columns if c not in keys]
    last = df.sparkSession.read.schema(schema).parquet(output).groupBy(*keys).agg(F.max_by(F.struct(*values), "epoch").alias("_v"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over everything available into an in-memory table (tests, small results)."""
    q = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.table(name)
