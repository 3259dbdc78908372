"""JSON arrays read by byte ranges equal the whole read; the cap is exact."""

import json
import random

import pytest

from ludex.sources import io

SCHEMA = "id long, name string, tags array<string>, sub struct<a:long,b:string>"


def records(n, seed=0):
    rng = random.Random(seed)
    bits = ['"', "\\", "}", "{", "[", "]", ",", "é", "\n", "x", '\\"}', "日本"]
    word = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
    return [{"id": k, "name": word(), "tags": [word() for _ in range(rng.randrange(3))], "sub": {"a": rng.randrange(9), "b": word()}} for k in range(n)]


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_equal_the_whole_file(spark, tmpdir_path, small_splits, indent):
    want = []
    for f in range(3):
        rows = records(60, f)
        want += rows
        with open(f"{tmpdir_path}/part-{f}.json", "w") as out:
            json.dump(rows, out, ensure_ascii=bool(f % 2), indent=indent)
    open(f"{tmpdir_path}/part-9.json", "w").write("[]")
    assert spark.read.option("lineSep", "}").text(tmpdir_path).rdd.getNumPartitions() > 5
    schema = spark.createDataFrame([], SCHEMA).schema
    plain = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    key = lambda r: json.dumps(r, sort_keys=True)
    assert sorted(map(key, plain(io.read_json_array(spark, tmpdir_path, schema)))) == sorted(map(key, want))
    for cap in (0, 1, 59, 60, 61, 130, 180, 999):
        assert sorted(map(key, plain(io.read_json_array(spark, tmpdir_path, schema, max_records=cap)))) == sorted(map(key, want[:cap]))
