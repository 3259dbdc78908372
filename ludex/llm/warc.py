"""WARC archives: written by tasks, read back by byte ranges.

Writing: one gzip member per record, one file per task under a folder of the
store; a file carries the attempt's own name, and only files named in the
returned manifest (a written table, committed by Spark) belong to the archive,
so failed or repeated attempts leave nothing that is read.  Of records with
equal payloads (of at least ``min_bytes``) the one with the largest id is a
``response``, the others are ``revisit`` records that refer to it.  Only
payload digests are grouped; digests held once never leave the join's small side.

Reading: every file is split into byte ranges.  A task scans its range for the
gzip magic, accepts a candidate if it decodes to a WARC header block, and then
owns the records that START in the range (it reads past the end to finish the
last one and follows member ends, searching again only where none begins).

Null html is an empty payload; null urls become an empty target; null ids are
archived as such (a row with a null id revisits a larger id, never the other
way round; if all ids are null all are responses); rows that repeat the largest
id are all responses.  Empty tables make empty archives.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.llm.common import col, stage
from ludex.session import scratch_path

MIN_BYTES = 0
SPLIT_BYTES = 32 << 20
READ_TASKS = 20_000        # at most; each then reads several ranges
BLOCK = 1 << 20
MAGIC = b"\x1f\x8b\x08"
HEADER_LIMIT = 1 << 16
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"   # fixed value: WARC 1.1 profile


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file that all tasks share (file, hdfs, s3, ...)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}')}>"


def record_bytes(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One record; a revisit (``refers_to`` set) keeps the HTTP header but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {urllib.parse.quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                  min_bytes: int = MIN_BYTES, level: int = 6) -> DataFrame:
    """Write the archive to the shared folder; returns its manifest ``path, length, records``."""
    spark = pages.sparkSession
    rows = pages.select(col(page_id).alias("id"), col(url).cast("string").alias("url"),
                        F.coalesce(col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    same = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha")
            .agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"))
    later = rows.join(same, "sha", "left").select(
        F.col("id").cast("string").alias("id"), "url", "payload", "sha",
        F.when((F.octet_length("payload") >= min_bytes) & F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last")),
               F.col("last")).cast("string").alias("refers_to"))
    folder = scratch_path(spark, "warc")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_store(folder)
        path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
        out, size, n = None, 0, 0
        for pdf in batches:
            for page, target, payload, sha, ref in pdf.itertuples(index=False, name=None):
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                raw = record_bytes(page, target, bytes(payload), base64.b32encode(bytes.fromhex(sha)).decode(), ref)
                member = gzip.compress(raw, level, mtime=0)
                out.write(member)
                size, n = size + len(member), n + 1
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [f"{folder}/{path.rsplit('/', 1)[1]}"], "length": [size], "records": [n]})

    return stage(later.mapInPandas(write, "path string, length long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file from an offset on, fetched as far as asked for."""

    def __init__(self, f, size: int, at: int) -> None:
        self.f, self.size, self.base, self.data = f, size, at, bytearray()

    def upto(self, end: int) -> bytearray:
        """Data known at least up to file offset ``end`` (or the end of the file)."""
        end = min(end, self.size)
        have = self.base + len(self.data)
        if have < end:
            self.data += self.f.read_at(max(end - have, min(BLOCK, self.size - have)), have)
        return self.data

    def drop(self, at: int) -> None:
        """Forget what lies before offset ``at``."""
        del self.data[:at - self.base]
        self.base = at


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """Decoded member at offset ``at`` and the offset after it; None if no WARC record starts there."""
    d, out, pos, checked = zlib.decompressobj(31), [], at, False
    while not d.eof:
        piece = w.upto(pos + (1 << 16))[pos - w.base:pos - w.base + (1 << 16)]
        if not piece:
            if checked:
                raise ValueError(f"truncated record at byte {at}")
            return None
        try:
            out.append(d.decompress(piece))
        except zlib.error:
            if checked:
                raise
            return None
        pos += len(piece)
        if not checked:
            head = b"".join(out)
            if not b"WARC/1.".startswith(head[:7]) and not head.startswith(b"WARC/1."):
                return None
            checked = head.startswith(b"WARC/1.") and b"\r\n\r\n" in head
            if not checked and (d.eof or len(head) > HEADER_LIMIT):
                return None
    return b"".join(out), pos - len(d.unused_data)


def scan_range(f, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, decoded record)`` of the records that start in ``[start, end)``."""
    w, at = _Window(f, size, start), start
    while at < end:
        w.drop(at)
        data = w.upto(at + BLOCK)
        found = data.find(MAGIC)
        if found < 0:
            step = max(1, len(data) - len(MAGIC) + 1)      # a magic may straddle two blocks
            at += step
            if w.base + len(data) >= size:
                return
            continue
        at += found
        if at >= end:
            return
        got = _member(w, at)
        if got is None:
            at += 1
            continue
        yield at, got[0]
        at = got[1]


def parse_record(raw: bytes) -> dict:
    head, rest = raw.split(b"\r\n\r\n", 1)
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:]))
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError(f"short block in {fields.get('warc-record-id')}")
    http, _, body = block.partition(b"\r\n\r\n")
    sizes = [int(x.split(":", 1)[1]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:")]
    return fields | {"payload": body, "http_length": sizes[0] if sizes else len(body)}


def read_archive(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the files of a manifest (``path, length``), one task per byte range or more.

    ``path, offset, record_type, page_id, target_uri, payload`` (null for revisits),
    ``payload_bytes, payload_digest, refers_to``; a response's digest is recomputed and checked."""
    ranges = manifest.select("path", F.col("length").cast("long").alias("length"),
                             F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1, F.lit(split_bytes).cast("long"))).alias("begin"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, length, begin in pdf[["path", "length", "begin"]].itertuples(index=False, name=None):
                fs, local = open_store(path)
                rows: list[tuple] = []
                with fs.open_input_file(local) as f:
                    for offset, raw in scan_range(f, length, begin, min(length, begin + split_bytes)):
                        r = parse_record(raw)
                        digest = r["warc-payload-digest"].partition(":")[2]
                        reply = r["warc-type"] == "response"
                        if reply and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                            raise ValueError(f"payload digest differs: {path} at {offset}")
                        rows.append((path, offset, r["warc-type"], r.get("x-page-id"), urllib.parse.unquote(r.get("warc-target-uri", "")),
                                     r["payload"] if reply else None, len(r["payload"]) if reply else r["http_length"], digest, r.get("x-refers-to-page-id")))
                        if len(rows) >= 500:
                            yield _frame(rows)
                            rows = []
                yield _frame(rows)

    schema = ("path string, offset long, record_type string, page_id string, target_uri string, payload binary, "
              "payload_bytes long, payload_digest string, refers_to string")
    n = ranges.count()                                     # a number, else the tiny rows are coalesced into one task
    spread = ranges.repartition(max(1, min(n, READ_TASKS)))
    return spread.mapInPandas(read, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["path", "offset", "record_type", "page_id", "target_uri", "payload",
                                       "payload_bytes", "payload_digest", "refers_to"])


def list_archive(spark: SparkSession, folder: str, glob: str = "*.warc.gz") -> DataFrame:
    """A manifest of archives that lie in a folder (names and sizes only are read)."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            .select("path", "length").where("length > 0"))
