"""WARC archives: write, index, read back.

Writing: each task writes its records, one gzip member each, to a file of its own in the shared
folder, and returns the index rows; files of attempts that fail are in no index.  The index
(file, offset, length, url, digest, page) comes first; reading selects from it, sorts by place,
coalesces neighbouring byte ranges into large reads and parses the records found there.
Null html: empty payload.  Null url: a urn of the page.  Null page_id: ranks below all others.
Repeated rows: one response, the others revisit it.  Empty table: no file, empty result."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, released, scratch, small_batches, store

REVISIT_BYTES = 1000  # smaller payloads are always stored
FILE_BYTES = 256 << 20  # an archive file is closed beyond this
BLOCK = 16 << 20  # ranges of one block of a file are read by one task
GAP = 64 << 10  # unselected bytes that a coalesced read may skip over
READ = 4 << 20  # a coalesced read is no longer than this, or one record
INDEX = "file string, offset long, length long, url string, digest string, page_id long"


def open_store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id, url: str | None, payload: bytes, kind: str, refers_to, digest: bytes) -> bytes:
    name = f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{name}>",
        f"WARC-Target-URI: {(url or name).translate({10: ' ', 13: ' '})}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decisions(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers, copies): of equal payloads of REVISIT_BYTES or more the largest
    page_id responds.  Narrow rows only; equal payloads meet as sums, never as a group."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    d = store(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes")), "warc-digests")
    top = d.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    copies = d.join(top, "digest").groupBy("page_id", "digest").agg(F.first("refers").alias("refers"), F.count(F.lit(1)).alias("copies"))
    return store(copies, "warc-decisions")


def write(pages: DataFrame) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the stored index."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = f"{scratch(spark)}/warc"
    choice = decisions(pages).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "refers", F.lit(True).alias("shared"))
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    rows = rows.join(choice, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    # repeated rows share their page_id and so their partition; sorted, the first of them responds
    rows = rows.select("page_id", "url", "html", "digest", "refers", F.coalesce("shared", F.lit(False)).alias("shared")).repartition("page_id").sortWithinPartitions("page_id", "digest", "url")

    def run(batches):
        import uuid

        store_at, root = open_store(folder)
        store_at.create_dir(root, recursive=True)
        out = name = last = None
        size = 0
        try:
            for batch in batches:
                index = []
                for page, url, html, digest, refers, shared in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None:
                        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
                        out, size = store_at.open_output_stream(name, compression=None), 0
                    mine = shared and page == refers and (page, digest) != last
                    last = (page, digest)
                    kind = "revisit" if shared and not mine else "response"
                    raw = record(page, url, html.encode(), kind, refers, bytes.fromhex(digest))
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = gz.compress(raw) + gz.flush()
                    out.write(raw)
                    index.append((name, size, len(raw), url, digest, page))
                    size += len(raw)
                    if size > FILE_BYTES:
                        out.close()
                        out = None
                if index:
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index, strict=True), kinds, strict=True)], names=[f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return store(rows.mapInArrow(released(run), INDEX), "warc-index")


def parse(raw: bytes) -> dict:
    """Headers (lower-case names) and ``payload`` of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(h["content-length"])]
    h["payload"] = block.partition(b"\r\n\r\n")[2]
    return h


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Read the records that ``index`` selects: page_id, url, record_type, refers_to,
    payload_bytes, payload_digest (of the payload found, or as a revisit states it), payload."""
    spark = index.sparkSession
    folder = f"{scratch(spark)}/warc"
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / BLOCK).alias("block"))
    rows = rows.repartition(partitions(spark), "file", "block").sortWithinPartitions("file", "offset")
    names = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"

    def ranges(batches):
        """Runs (file, from, to, [(offset, length)]) of neighbours."""
        run = None
        for batch in batches:
            for f, o, n in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if run and run[0] == f and o - run[2] <= GAP and o + n - run[1] <= READ:
                    run[2] = max(run[2], o + n)
                    run[3].append((o, n))
                else:
                    if run:
                        yield run
                    run = [f, o, o + n, [(o, n)]]
        if run:
            yield run

    def number(x: str | None):
        x = (x or "").strip("<>").rpartition(":")[2]
        return int(x) if x not in ("", "None") else None

    def run(batches):
        store_at, _ = open_store(folder)
        opened = (None, None)
        for f, a, b, places in ranges(batches):
            if opened[0] != f:
                opened = (f, store_at.open_input_file(f))
            data = opened[1].read_at(b - a, a)
            out = []
            for o, n in places:
                h = parse(zlib.decompress(data[o - a : o - a + n], 31))
                p, kind = h["payload"], h["warc-type"]
                if kind == "response":
                    size, digest, refers = len(p), hashlib.sha1(p).hexdigest(), None
                else:
                    size, digest, refers = int(h["x-payload-length"]), base64.b32decode(h["warc-payload-digest"][5:]).hex(), number(h["warc-refers-to"])
                out.append((number(h["warc-record-id"]), h["warc-target-uri"], kind, refers, size, digest, p if with_payload else None))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in names.split(", ")])

    return rows.mapInArrow(released(run), names)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return read(write(pages), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH d AS (SELECT page_id, strlen(COALESCE(html, '')) AS n, sha1(COALESCE(html, '')) AS g FROM pages),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY g) AS top FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM m
"""
