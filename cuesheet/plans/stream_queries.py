"""Streams over the events table: the same plans as for batch, driven to the end of the input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cuesheet.plans.registry import query
from cuesheet.plans.roles import table
from cuesheet.session import shared_folder
from cuesheet.streaming import logs


def _events(spark, sf):
    batch = table(spark, sf, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _place(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/cuesheet/stream-{uuid.uuid4().hex}"


@query(
    "stream_dedup_append",
    "SELECT user_id, k_, event_type FROM (SELECT user_id, event_type, event_id % 50 AS k_ FROM events) GROUP BY ALL",
    "I1 I2 I3",
)
def stream_dedup_append(spark, sf):
    """Log keyed by item and parameters; only the key columns are kept, so any copy may be the first."""
    out = _place(spark)
    rows = _events(spark, sf).select("user_id", (F.col("event_id") % 50).alias("k_"), "event_type")
    logs.append_new(rows, ["user_id", "k_", "event_type"], f"{out}/log", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/log").select("user_id", "k_", "event_type")


def _naive(df, col):
    """Event times are wall-clock times without a zone, as in the table."""
    return df.withColumn(col, F.col(col).cast("timestamp_ntz"))


def _ts(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_bins",
    """SELECT date_trunc('hour', ts) AS start, event_type, CAST(sum(floor(value * 100 + 0.5)) AS BIGINT) AS value, count(*) AS n
       FROM events WHERE ts IS NOT NULL GROUP BY ALL""",
    "I5",
)
def stream_bins(spark, sf):
    """Hourly sums per kind; windows that the watermark has not passed show what is known of them."""
    ev = _ts(_events(spark, sf)).select("ts", "event_type", F.floor(F.col("value") * 100 + 0.5).alias("amount"))
    binned = logs.bins(ev, "ts", ["event_type"], F.col("amount"), "1 hour", "1 hour")
    out = _place(spark)
    return _naive(logs.run_to_latest(binned, ["start", "event_type"], f"{out}/data", f"{out}/checkpoint"), "start")


@query(
    "stream_trailing",
    """SELECT date_trunc('hour', ts) + CAST(h AS INTEGER) * INTERVAL 1 HOUR AS at, event_type, count(*) AS n
       FROM events, range(1, 7) r(h) WHERE event_type = 'click' AND ts IS NOT NULL GROUP BY ALL""",
    "I6",
)
def stream_trailing(spark, sf):
    ev = _ts(_events(spark, sf)).where(F.col("event_type") == "click").select("ts", "event_type")
    counted = logs.trailing(ev, "ts", ["event_type"], "6 hours", "1 hour", "1 hour")
    out = _place(spark)
    return _naive(logs.run_to_latest(counted, ["at", "event_type"], f"{out}/data", f"{out}/checkpoint"), "at")


@query(
    "snapshot_stream",
    """WITH d AS (SELECT user_id AS item, strftime(ts, '%Y%m%d') AS date, count(*) AS n FROM events GROUP BY ALL)
       SELECT item, min(date) AS first_date, max(date) AS last_date, arg_max(n, date) - arg_min(n, date) AS increase FROM d GROUP BY item""",
    "I4 J14",
)
def snapshot_stream(spark, sf):
    """Daily counts appended as a stream, then growth between the first and the last day of each item."""
    daily = table(spark, sf, "events").groupBy(F.col("user_id").alias("item"), F.date_format("ts", "yyyyMMdd").alias("date")).agg(F.count("*").alias("n"))
    out = _place(spark)
    daily.write.parquet(f"{out}/in")
    stream = spark.readStream.schema(daily.schema).parquet(f"{out}/in")
    logs.append_new(stream, ["item", "date"], f"{out}/log", f"{out}/checkpoint").awaitTermination()
    snaps = spark.read.parquet(f"{out}/log")
    return logs.growth_state(snaps, "item", "date", "n").select("item", "first_date", "last_date", "increase")
