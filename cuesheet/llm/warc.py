"""WARC archives: written by Spark's text writer, read back by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from cuesheet.llm.common import attach, read, save, scratch_path

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
#: Smaller payloads are never revisits.
LEAST = 1000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_FOUND = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("rel", pa.int64()), ("size", pa.int64()), ("next", pa.int64()), ("out", pa.int64()),
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared", pa.int64()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()),
])
FOUND = (
    "file string, block long, rel long, size long, next long, out long, page_id long, url string, record_type string, refers_to long, "
    "declared long, payload_bytes long, payload_digest string, payload binary"
)


def write(pages: DataFrame, path: str, key: str = "page_id", least: int = LEAST) -> None:
    """Write one record per row; the text writer's line separator ends each record, so a part file is an archive.

    Of rows with equal payloads of `least` bytes or more the one with the largest id is a response and the others
    revisit it; a null id is smaller than any, and rows that share the largest id are all responses. A null html
    is an empty payload, a null url has no header, line breaks in a url are percent-encoded.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    one = pages.select(F.col(key).cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    one = one.select("*", F.octet_length("html").cast("long").alias("n"), F.sha2(F.col("html"), 256).alias("sum"))
    groups = one.where(F.col("n") >= least).groupBy("sum").agg(F.max("page_id").alias("largest"), F.count("*").alias("copies")).where("copies > 1")
    groups = save(groups.select("sum", "largest"))
    # only ids and sums are joined: the pages themselves stay where they are unless they are copies
    copied = attach(save(one.select("page_id", "n", "sum")), "sum", groups, "inner").where("largest is not null and (page_id is null or page_id < largest)")
    revisits = save(copied.select("page_id", F.col("sum").alias("of"), "largest").distinct())
    one = one.join(revisits, one["page_id"].eqNullSafe(revisits["page_id"]) & (one["sum"] == revisits["of"]), "left").drop(revisits["page_id"])
    again = F.col("largest").isNotNull()
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name, F.lit(f">\r\nWARC-Date: {DATE}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n")), F.lit("")),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), F.col("largest").cast("string"), F.lit(">\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), F.sha1("html"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length(http) + F.when(again, 0).otherwise(F.col("n"))).cast("string"), F.lit(END), http,
        F.when(again, "").otherwise(F.col("html")),
    )
    one.select(record.alias("value")).write.option("lineSep", END).text(path)


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n"))}


def _number(value: bytes | None, pattern: bytes = rb"(\d+)") -> int | None:
    m = re.fullmatch(pattern, value or b"")
    return int(m[1]) if m else None


def parse(chunk: bytes) -> dict | None:
    """What stands behind a magic, if it reads as a record. next: where its successor would start, from the chunk."""
    head, end, body = chunk.partition(b"\r\n\r\n")
    fields = _fields(head)
    n = _number(fields.get(b"content-length"))
    if not end or n is None or n >= 1 << 62 or b"warc-type" not in fields:
        return None
    out = {"next": len(head) + 8 + n, "declared": n, "record_type": fields[b"warc-type"].decode("utf-8", "replace")}
    out["page_id"] = _number(fields.get(b"warc-record-id"), rb"<urn:page:(-?\d+)>")
    out["refers_to"] = _number(fields.get(b"warc-refers-to"), rb"<urn:page:(-?\d+)>")
    out["url"] = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
    out["claim"] = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("utf-8", "replace")
    out["whole"] = len(body) >= n
    if out["whole"]:
        out |= content(body[:n], out["record_type"], out["claim"])
    return out


def content(block: bytes, kind: str, claim: str) -> dict:
    """Size and digest of the payload: of a revisit as its headers give them, else as measured."""
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        return {"payload_bytes": _number(_fields(http).get(b"content-length")), "payload_digest": claim, "payload": None}
    return {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, int, bytes]]:
    """(file, block, place in the block, chunk), chunks in the order of the file; the magics count as read."""
    now, rel = None, 0
    for b in batches:
        for value, file, block in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (file, block) != now:
                now, rel = (file, block), 0
            chunk = value.as_py()
            yield file, block, rel, chunk
            rel += len(chunk) + len(MAGIC)


def _scan(batches: Iterable[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """A row for every chunk; of candidates also the successor (next) and where the chain leaves the block (out)."""
    rows: list[dict] = []

    def close() -> None:
        leaves = {r["rel"] - len(MAGIC): r for r in rows if r["next"] is not None}
        for r in reversed(rows):
            if r["next"] is not None:
                after = leaves.get(r["next"])
                r["out"] = after["out"] if after and r["next"] > r["rel"] else r["next"]

    def batch(done: list[dict]) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(done), 2000):
            yield pa.RecordBatch.from_pylist(done[at : at + 2000], _FOUND)

    now = None
    for file, block, rel, chunk in _chunks(batches):
        if now != (file, block):
            close()
            yield from batch(rows)
            rows, now = [], (file, block)
        found = parse(chunk) or {"next": None}
        r = {f.name: found.get(f.name) for f in _FOUND} | {"file": file, "block": block, "rel": rel, "size": len(chunk) + len(MAGIC), "out": None}
        if found["next"] is not None:
            r["next"] += rel
            if not found["whole"]:
                r["payload_digest"] = found["claim"]
        if not payloads:
            r["payload"] = None
        rows.append(r)
    close()
    yield from batch(rows)


def _archive(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _follow(key, rows):
    """Records of one block that the chain through its entry reaches; a block is a bounded range of a file."""
    import pandas as pd

    entry = rows["entry"].dropna()
    at = {s: k for k, s in enumerate(rows["start"]) if not pd.isna(rows["after"].iloc[k])}
    keep, here = [], entry.iloc[0] if len(entry) else None
    while here in at:
        keep.append(at[here])
        here = rows["after"].iloc[at[here]]
    return rows.iloc[keep][["file", "block", "rel", "start", "after"]]


def records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives in a folder, also of files that several tasks read in parts.

    Every magic is a candidate with a successor offset from its headers. Chains are followed inside a block by the
    task that read it; between blocks pointers are doubled from the start of each file until nothing new is
    reached. A magic inside a payload is not reached and so is content; a record that holds one is put together
    from its chunks. A file whose chain does not end at its end raises ValueError.

    Columns: page_id, url, record_type, refers_to, payload_bytes, payload_digest, file, start, and payload if asked.
    """
    found = save(_archive(spark, path).mapInArrow(lambda it: _scan(it, payloads), FOUND))
    blocks = found.groupBy("file", "block").agg(F.sum("size").alias("size"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "size", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    m = len(MAGIC)
    placed = save(
        found.select("file", "block", "rel", "next", "out", "size").join(blocks.select("file", "block", "base"), ["file", "block"])
        .select("file", "block", "rel", (F.col("base") + F.col("rel") - m).alias("start"), (F.col("base") + F.col("rel") + F.col("size") - m).alias("stop"),
                (F.col("base") + F.col("next")).alias("after"), (F.col("base") + F.col("out")).alias("leave"))
    )
    starts = placed.where("after is not null").select("file", "start", "leave")
    entries = starts.select("file", F.col("leave").alias("start")).distinct().join(starts, ["file", "start"])
    jumps = save(entries.unionByName(starts.where("start = 0")).distinct())
    reached, before = save(jumps.where("start = 0")), -1
    while (n := reached.count()) > before:
        before = n
        ahead = jumps.select("file", F.col("start").alias("leave"), F.col("leave").alias("then"))
        hop = reached.select("file", F.col("leave").alias("start")).join(jumps, ["file", "start"])
        reached = save(reached.select("file", "start").unionByName(hop.select("file", "start")).distinct().join(jumps.join(ahead, ["file", "leave"], "left").select("file", "start", F.coalesce("then", "leave").alias("leave")), ["file", "start"]))
        jumps = save(jumps.join(ahead, ["file", "leave"], "left").select("file", "start", F.coalesce("then", "leave").alias("leave")))
    total = placed.groupBy("file").agg(F.max("stop").alias("end"))
    lost = total.join(reached.groupBy("file").agg(F.max("leave").alias("leave")), "file", "left").where("end > 0 and (leave is null or leave != end)")
    if broken := lost.count():
        raise ValueError(f"{broken} archives have no chain of records from start to end")
    marked = placed.join(reached.select("file", "start", F.col("start").alias("entry")), ["file", "start"], "left")
    chain = save(marked.groupBy("file", "block").applyInPandas(
        lambda key, rows: _follow(key, rows), "file string, block long, rel long, start long, after long"
    ))
    out = found.join(chain, ["file", "block", "rel"])
    columns = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "start", *(["payload"] if payloads else [])]
    whole = out.where("payload_bytes is not null").select(*columns)
    torn = save(out.where("payload_bytes is null").select("file", "start", "after", "page_id", "url", "record_type", "refers_to", "declared", "payload_digest"))
    if not torn.head(1):
        return whole
    # chunks of torn records: each belongs to the last reached record at or before it
    last = F.max("own").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, 0))
    own = placed.join(chain.select("file", "start", F.col("start").alias("own")), ["file", "start"], "left").select("file", "block", "rel", "start", last.alias("own"))
    parts = own.join(torn.select("file", F.col("start").alias("own")), ["file", "own"]).select("file", "block", "rel", "own", F.col("start").alias("place"))

    def texts(batches):
        for file, block, rel, chunk in _chunks(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "block": block, "rel": rel, "chunk": chunk}])

    chunks = _archive(spark, path).mapInArrow(texts, "file string, block long, rel long, chunk binary")
    joined = chunks.join(parts, ["file", "block", "rel"]).groupBy("file", "own").agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("parts"))
    joined = joined.join(torn.withColumnRenamed("start", "own"), ["file", "own"])

    def mend(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                text = MAGIC.encode().join(p["chunk"] for p in r["parts"])
                block = text.partition(b"\r\n\r\n")[2][: r["declared"]]
                r |= content(block, r["record_type"], r["payload_digest"])
                rows.append({c: r["own"] if c == "start" else r[c] for c in columns})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([f for c in columns for f in ([pa.field("start", pa.int64())] if c == "start" else [_FOUND.field(c)])])
    return whole.unionByName(joined.mapInArrow(mend, whole.schema))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS d, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < top THEN top END AS refers_to
FROM q"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark)
    write(read(spark, sf_dir, "pages"), path)
    return records(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
