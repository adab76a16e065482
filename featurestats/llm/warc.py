"""Operator 5: WARC archives with revisit records.

Headers alone (id, payload size and SHA-256) are shuffled by payload digest: of the records with an equal payload of at
least ``MIN_BYTES`` the one with the smallest page_id is the response, and the others join it as revisits.  Payloads of
revisits are not written.  Tasks write one gzip member for each record, with fresh headers, through pyarrow's file
systems to the shared folder, and return an index row (file, offset, length) for each record.  Only index rows of successful
tasks are committed, so a file left by a lost task is never read.  Reading back parses the indexed files and joins
revisits to the responses they refer to, by record id.

Results: a null page html is an empty payload.  Rows that repeat the smallest page_id are responses too.  A null page_id
counts as larger than any other.  Line breaks in a url are written as %0D and %0A.  An empty table writes no
file and gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scan, shared_folder

MIN_BYTES = 100
FILE_BYTES = 128 << 20
READ_BYTES = 1 << 20
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BREAK = "\r\n"

INDEX = "page_id bigint, record_id string, record_type string, file string, offset bigint, length bigint"
PARSED = "page_id bigint, record_id string, record_type string, refers_id string, refers_to bigint, payload_bytes bigint, payload_digest string"


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to, refers_url) of the pages that repeat an earlier payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    heads = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url",
        F.sha2(payload.cast("binary"), 256).alias("payload_digest"), F.octet_length(payload).alias("size"),
    ).where(F.col("size") >= min_bytes)
    firsts = heads.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"))
    again = heads.join(firsts, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    return again.select("page_id", "payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url")).distinct()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}:{digest}'.encode()).digest()[:16], version=4)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> bytes:
    """One record: WARC headers, then the HTTP headers, then the payload unless it is a revisit."""
    def uri(u: str | None) -> str:
        return (u or "").replace("\r", "%0D").replace("\n", "%0A")

    http = BREAK.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Target-URI: {uri(refers_url)}"]
        head += [f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else []
    return BREAK.join([*head, "", ""]).encode("utf-8", "surrogatepass") + block + (2 * BREAK).encode()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, date: str | None = None) -> DataFrame:
    """Write the archives of ``pages`` under ``folder`` (a URI all machines reach); returns the index, materialised."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    again = resolve(pages, min_bytes).select(*(F.col(c).alias(f"again_{c}") for c in ("page_id", "payload_digest", "refers_to", "refers_url")))
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("html"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    joined = rows.join(again, rows["page_id"].eqNullSafe(again["again_page_id"]) & (rows["digest"] == again["again_payload_digest"]), "left").select(
        "page_id", "url", "html", "digest", F.col("again_refers_to").alias("refers_to"), F.col("again_refers_url").alias("refers_url"),
        F.col("again_payload_digest").isNotNull().alias("revisit"))

    def make():
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        stem, number = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}", itertools.count()

        def step(batch: pa.RecordBatch):
            out, name, sink, offset = [], "", None, 0
            for page_id, url, html, digest, refers_to, refers_url, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if sink is None or offset >= FILE_BYTES:
                    if sink:
                        sink.close()
                    name, offset = f"{stem}-{next(number)}.warc.gz", 0
                    sink = store.open_output_stream(name, compression=None)
                body = record(page_id, url, html.encode("utf-8", "surrogatepass"), digest, date, refers_to, refers_url, revisit)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(body) + packer.flush()
                sink.write(member)
                out.append((page_id, record_id(page_id, digest), "revisit" if revisit else "response", name.rsplit("/", 1)[1], offset, len(member)))
                offset += len(member)
            if sink:
                sink.close()
            return [[r[k] for r in out] for k in range(6)]

        return step

    return materialize(scan(joined, make, INDEX), "warc-index")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, unpacked, one at a time."""
    rest = b""
    while True:
        parts, unpack = [], zlib.decompressobj(31)
        while not unpack.eof:
            data = rest or stream.read(READ_BYTES)
            if not data:
                if parts:
                    raise ValueError("a WARC file ends within a record")
                return
            parts.append(unpack.decompress(data))
            rest = unpack.unused_data
        yield b"".join(parts)


def parse(body: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC headers, block) of a record."""
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split(BREAK)[1:] if ": " in line)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"record {fields.get('WARC-Record-ID')}: {len(rest) - 4} bytes, not {size}")
    return fields, rest[:size]


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Per record of the indexed files: its payload's size and digest (a revisit's from the response it refers to)."""

    def make():
        store, root = fs.FileSystem.from_uri(folder)

        def rows(name: str):
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for body in members(stream):
                    fields, block = parse(body)
                    kind, page, refers = fields["WARC-Type"], fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                    payload = block.partition(b"\r\n\r\n")[2]
                    yield (int(page) if page else None, fields["WARC-Record-ID"], kind, fields.get("WARC-Refers-To"), int(refers) if refers else None,
                           *((len(payload), hashlib.sha256(payload).hexdigest()) if kind == "response" else (None, fields["WARC-Payload-Digest"].removeprefix("sha256:"))))

        def step(batch: pa.RecordBatch):
            out = [r for name in batch.column(0).to_pylist() for r in rows(name)]
            return [[r[k] for r in out] for k in range(7)]

        return step

    files = materialize(index.select("file").distinct(), "warc-files")
    parsed = materialize(scan(files.repartition(max(1, files.count())), make, PARSED), "warc-parsed")
    responses = parsed.where("record_type = 'response'")
    originals = responses.groupBy(F.col("record_id").alias("original_id")).agg(F.first("payload_bytes").alias("original_bytes"), F.first("payload_digest").alias("original_digest"))
    revisits = parsed.where("record_type = 'revisit'").join(originals, F.col("refers_id") == F.col("original_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(
        "page_id", F.col("original_bytes").alias("payload_bytes"), F.col("original_digest").alias("payload_digest"), "record_type", "refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(spark, folder, write_archives(pages, folder))


SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
