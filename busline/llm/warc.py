"""WARC archives: a writer with revisit records, and a reader that splits files.

Each record is a gzip member of its own. The reader's tasks get byte ranges.
A task looks for the gzip magic number in its range, accepts a candidate when
the bytes there decode to a WARC header, and from then on goes from member to
member. A record belongs to the task in whose range it starts, so it is read
once, wherever the cuts fall.

Defined cases: a null payload is empty; a null page_id gives a record without
the page header, read back as null; rows that repeat page_id and payload are
equal records, so each is a response or each a revisit; an empty table gives no
file; damaged members are passed over, up to the next one that decodes.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.llm.common import landed, open_fs, scratch_dir

REVISIT_BYTES = 1000
SPLIT_BYTES = 8 << 20
BLOCK = 1 << 20  # bytes of a read
FEED = 16 << 10  # bytes given to the decoder at once
MAGIC = re.compile(b"\x1f\x8b\x08")

# Fixed values of the WARC 1.1 format.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, *, key: str = "page_id", payload: str = "html") -> DataFrame:
    """Add payload bytes, digest, and for later copies the key of the record they repeat.

    The largest key of each payload is found on (digest, key) rows with partial
    aggregation; the pages then meet one row per repeated payload.
    """
    d = pages.select(F.col(key).alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"))
    d = d.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    kept = d.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    kept = kept.filter(F.col("copies") > 1).select("payload_digest", "refers_to")
    j = d.join(kept, "payload_digest", "left")
    repeats = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return j.select(
        "page_id", "url", F.when(~repeats, F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", F.when(repeats, F.col("refers_to")).alias("refers_to")
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with a response or revisit record."""
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + b"\r\n" + payload if refers_to is None else http + b"\r\n"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]+', ' ', url or '')}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{refers_to}/{digest}')}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame, folder: str | None = None) -> DataFrame:
    """Write one archive per task; returns (path, bytes, records) of those that count.

    Files carry the name of their attempt. Only files in the returned table are
    part of the result, so a repeated task does no harm.
    """
    folder = folder or scratch_dir(records.sparkSession, "warc")

    def write(batches):
        ctx = TaskContext.get()
        fs, root = open_fs(folder)
        path, out, n, size = f"{root}/{ctx.partitionId():07d}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.gz", None, 0, 0
        for batch in batches:
            for row in (r for part in slices_of_payload(batch) for r in part.to_pylist()):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                raw = record_bytes(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["payload_digest"], row["refers_to"])
                out.write(raw)
                n, size = n + 1, size + len(raw)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [os.path.basename(path)], "bytes": [size], "records": [n]})

    files = landed(records.mapInArrow(write, "path string, bytes long, records long"), "warc-files")
    return files.withColumn("folder", F.lit(folder))


def slices_of_payload(batch: pa.RecordBatch, rows: int = 256):
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


def parse_head(raw: bytes) -> tuple[dict[str, str], bytes] | None:
    if not raw.startswith(b"WARC/1."):
        return None
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest


def scan_range(src, start: int, end: int, size: int):
    """Decoded records that start in [start, end) of an open file of ``size`` bytes."""
    base, buffer, at = start, b"", start  # buffer: bytes of the file from ``base`` on; at: next byte to look at

    def more() -> bool:
        nonlocal base, buffer
        new = src.read_at(min(BLOCK, size - base - len(buffer)), base + len(buffer)) if base + len(buffer) < size else b""
        buffer, base = buffer[at - base :] + new, at
        return bool(new)

    def member() -> tuple[bytes, int] | None:
        """Record of the member at ``at`` and the bytes it takes."""
        z, parts, used, known = zlib.decompressobj(31), [], 0, False
        while not z.eof:
            if at - base + used >= len(buffer) and not more():
                return None
            chunk = buffer[at - base + used : at - base + used + FEED]
            try:
                parts.append(z.decompress(chunk))
            except zlib.error:
                return None
            used += len(chunk) - len(z.unused_data)
            if not known and sum(map(len, parts)) >= 7:
                if not b"".join(parts).startswith(b"WARC/1."):
                    return None
                known = True
        raw = b"".join(parts)
        return (raw, used) if parse_head(raw) else None

    while at < end:
        found = MAGIC.search(buffer, at - base)
        if not found:
            at = max(at, base + len(buffer) - 2)
            if not more():
                return
            continue
        at = base + found.start()
        if at >= end:
            return
        if got := member():
            at += got[1]
            yield got[0]
        else:
            at += 1


def record_row(raw: bytes) -> dict | None:
    """Fields of a response or revisit record; other records are passed over."""
    head, block = parse_head(raw)
    kind = head.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    number = lambda k: int(head[k]) if k in head else None
    digest, size = head.get("warc-payload-digest", "").removeprefix("sha1:"), number("x-payload-length")
    if kind == "response":
        payload = block[: int(head["content-length"])].partition(b"\r\n\r\n")[2]
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    return {"page_id": number("x-page-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page"), "url": head.get("warc-target-uri")}


def read_archives(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Read archives listed as (folder, path, bytes) by byte ranges."""
    cuts = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))))
    cuts = cuts.select("folder", "path", "bytes", "start", F.least(F.col("start") + split_bytes, F.col("bytes")).alias("end"))
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    cuts = cuts.repartition(int(n), "path", "start")  # the list is short, the work behind it is not
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])

    def read(batches):
        for batch in batches:
            for cut in batch.to_pylist():
                fs, root = open_fs(cut["folder"])
                rows = []
                with fs.open_input_file(f"{root}/{cut['path']}") as src:
                    for raw in scan_range(src, cut["start"], cut["end"], cut["bytes"]):
                        if (row := record_row(raw)) is not None:
                            rows.append(row)
                        if len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return cuts.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
