import base64
import gzip
import hashlib
import io
from collections import Counter

import numpy as np
import pytest
from ludex.llm import warc
from pyspark.sql import functions as F

ROWS = [(k, f"https://e.x/{k}?a=b c\r\nX: y", "<p>" + "text %d " % (k % 7) * (k * 37 % 900) + "é</p>") for k in range(80)]
ROWS += [(100, None, None), (101, "u", ""), (102, "u", None), (None, "u", "null id"), (None, "u", "null id"), (None, None, "<p>é</p>"),
         (103, "u", "x"), (103, "u", "x"), (104, "ü", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 50), (105, "u", "R" * 300_000), (50, "other", "another text")]
SCHEMA = "page_id long, url string, html string, sha string, last long"


def expected(rows, min_bytes=0):
    last, n = {}, Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        n[b] += 1
        if p is not None:
            last[b] = max(p, last.get(b, p))
    out = Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        ref = last.get(b) if len(b) >= min_bytes else None
        ref = None if ref == p else ref
        out[(p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref)] += 1
    return out


def result(df):
    return Counter((None if r.page_id is None else int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type,
                    None if r.refers_to is None else int(r.refers_to)) for r in df.collect())


@pytest.fixture(scope="module")
def pages(spark):
    from ludex.session import ship_package
    ship_package(spark)
    return spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(3)


@pytest.mark.parametrize("split,min_bytes", [(warc.SPLIT_BYTES, 0), (97, 0), (5000, 4)])
def test_round_trip(pages, split, min_bytes):
    manifest = warc.write_archive(pages, min_bytes=min_bytes)
    got = warc.read_archive(manifest, split).cache()
    assert result(got) == expected(ROWS, min_bytes)
    kept = {(r.page_id, bytes(r.payload)) for r in got.where("record_type = 'response' and page_id is not null").collect()}
    assert kept <= {(str(p), (h or "").encode()) for p, _, h in ROWS if p is not None}


def test_files_are_plain_gzip_members(pages):
    for r in warc.write_archive(pages).collect():
        fs, path = warc.open_store(r.path)
        with fs.open_input_file(path) as f:
            raw = f.read()
        text = gzip.decompress(raw)
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"\r\nWARC-Record-ID: ") == r.records and len(raw) == r.length
        assert b"\r\nX: y" not in text.split(b"HTTP/1.1")[0]


def test_uncommitted_files_are_not_read(pages, spark):
    manifest = warc.write_archive(pages)
    fs, path = warc.open_store(manifest.first().path)
    with fs.open_output_stream(path.rsplit("/", 1)[0] + "/part-dead.warc.gz", compression=None) as f:
        f.write(b"half a record of a lost attempt")
    assert result(warc.read_archive(manifest)) == expected(ROWS)
    folder = manifest.first().path.rsplit("/", 1)[0]
    assert warc.list_archive(spark, folder).count() == manifest.count() + 1


def test_ranges_own_the_records_that_start_inside():
    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    members = [gzip.compress(warc.record_bytes(str(k), "u", b"x" * k * 50, "D", None), mtime=0) for k in range(30)]
    data, at = b"".join(members), [sum(map(len, members[:k])) for k in range(30)]
    for step in (1, 13, 400, len(data)):
        seen = [o for s in range(0, len(data), step) for o, _ in warc.scan_range(File(data), len(data), s, min(len(data), s + step))]
        assert seen == at
    with pytest.raises(ValueError):
        list(warc.scan_range(File(data[:-4]), len(data) - 4, 0, len(data)))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read_archive(warc.write_archive(none)).count() == 0
    only_null = spark.createDataFrame([(None, None, None, None, None)], SCHEMA).withColumn("page_id", F.col("page_id"))
    assert result(warc.read_archive(warc.write_archive(only_null))) == expected([(None, None, None)])


def test_ranges_are_read_by_many_tasks(spark):
    """AQE does not put the few rows of the ranges into one task."""
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(k, "u", rng.bytes(3000).hex()) for k in range(60)], "page_id long, url string, html string").repartition(6)
    got = warc.read_archive(warc.write_archive(pages), split_bytes=8192).select("page_id", F.spark_partition_id().alias("p"))
    assert got.select("p").distinct().count() >= 6 and got.count() == 60
