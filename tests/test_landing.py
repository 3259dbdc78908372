"""Versioned buckets and the key ledger: changed bucket counts, crashes, replays, what a batch reads."""

import pytest
from pyspark.sql import functions as F

from ludex.session import list_names, path_exists, scratch_path, ship_package
from ludex.streaming import landing as L


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), "k long, o long")


def state(spark, snap):
    got = [(r.k, r.o) for r in L.read_snapshot(spark, snap).collect()]
    assert len(got) == len({k for k, _ in got})
    return dict(got)


def test_another_bucket_count_keeps_keys_unique(spark):
    snap = scratch_path(spark, "snap")
    L.upsert_latest(rows(spark, ((k, k) for k in range(200))), snap, "k", ["o"], buckets=8)
    L.upsert_latest(rows(spark, ((k, 1000 + k) for k in range(0, 200, 40))), snap, "k", ["o"], buckets=16)
    got = state(spark, snap)
    assert len(got) == 200 and got[40] == 1040 and got[41] == 41
    assert L.BucketedTable(spark, snap, "k", 16).buckets == 8


@pytest.mark.parametrize("at", ["data", "manifest"])
def test_a_crash_loses_nothing(spark, monkeypatch, at):
    """Killed while the new buckets are written, or before the manifest: the old version stays, the replay succeeds."""
    snap = scratch_path(spark, "snap")
    L.upsert_latest(rows(spark, ((k, k) for k in range(100))), snap, "k", ["o"], buckets=4)
    L.upsert_latest(rows(spark, [(5, 500)]), snap, "k", ["o"])
    before = state(spark, snap)

    def crash(*_, **__):
        raise RuntimeError("killed")
    batch = rows(spark, [(1, 999), (7, 777), (1000, 1)])
    with monkeypatch.context() as m:
        if at == "manifest":
            m.setattr(L, "list_names", lambda s, p: crash() if "/data/" in p else list_names(s, p))
        else:
            half = L.BucketedTable(spark, snap, "k")
            half.bucketed(batch.limit(1)).write.partitionBy("_bucket").parquet(f"{snap}/data/v={half.version + 1}")
            m.setattr(L.BucketedTable, "commit", crash)
        with pytest.raises(RuntimeError, match="killed"):
            L.upsert_latest(batch, snap, "k", ["o"])
    assert state(spark, snap) == before
    for _ in range(2):                                       # the replay, and a replay of that
        L.upsert_latest(batch, snap, "k", ["o"])
        assert state(spark, snap) == before | {1: 999, 7: 777, 1000: 1}


def test_old_versions_are_deleted(spark):
    snap = scratch_path(spark, "snap")
    for k in range(6):
        L.upsert_latest(rows(spark, [(1, k), (2, k)]), snap, "k", ["o"], buckets=2)
    assert state(spark, snap) == {1: 5, 2: 5}
    assert len(list_names(spark, f"{snap}/manifest")) <= 3
    folders = [f for fs in L.BucketedTable(spark, snap, "k").folders.values() for f in fs]
    assert folders and all(path_exists(spark, f) for f in folders)
    assert not path_exists(spark, f"{snap}/data/v=1/_bucket={folders[0].rpartition('=')[2]}")


def test_ledger_reads_only_buckets_of_keys_that_may_be_known(spark, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(L.KeyLedger, "BITS", 1 << 14)
    path, asked = scratch_path(spark, "ledger"), []
    keys = lambda r: spark.createDataFrame([(k, "x") for k in r], "k long, v string")
    first = L.KeyLedger(spark, path, "k", 16)
    assert first.unknown(keys(range(300)), "a", 0).count() == 300
    first.add(keys(range(300)), "a", 0)
    read = L.BucketedTable.read

    def spy(self, buckets=None):
        if self.key == "k" and buckets is not None:
            asked.append(buckets)
        return read(self, buckets)
    monkeypatch.setattr(L.BucketedTable, "read", spy)
    again = L.KeyLedger(spark, path, "k", 16)
    assert [r.k for r in again.unknown(keys([*range(5000, 5040), 7]), "a", 1).collect() if r.k < 5000] == []
    assert again.unknown(keys([*range(5000, 5040), 7]), "a", 1).count() == 40
    assert all(len(b) <= 8 for b in asked)
    assert again.unknown(keys(range(10)), "a", 0).count() == 10                      # a replay of the batch that landed them
    assert again.unknown(keys(range(10)), "b", 0).count() == 0                       # another run


def test_ledger_compacts(spark, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(L.BucketedTable, "FOLDERS", 2)
    monkeypatch.setattr(L.KeyLedger, "BITS", 1 << 12)
    path = scratch_path(spark, "ledger")
    for n in range(4):
        ledger = L.KeyLedger(spark, path, "k", 1)
        batch = spark.createDataFrame([(k,) for k in range(n * 10, n * 10 + 15)], "k long")
        got = sorted(r.k for r in ledger.unknown(batch, "r", n).collect())
        assert got == list(range(n * 10 + (5 if n else 0), n * 10 + 15))
        ledger.add(spark.createDataFrame([(k,) for k in got], "k long"), "r", n)
        assert all(len(f) <= 2 for f in ledger.keys.folders.values())
    assert L.KeyLedger(spark, path, "k").keys.read().select("k").distinct().count() == 45


def test_crash_between_rows_and_ledger(spark, monkeypatch):
    """A batch that dies after its rows were written is replayed in full."""
    schema = spark.createDataFrame([], "event_id long, ts timestamp_ntz, day string").schema
    events = lambda r: spark.createDataFrame([(k,) for k in r], "event_id long").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    land, out, ck = (scratch_path(spark, x) for x in ("land", "out", "ck"))
    L.land_by_day(events(range(10)), "ts", land)
    with monkeypatch.context() as m:
        m.setattr(L.KeyLedger, "add", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(Exception, match="killed"):
            L.ingest_incremental(spark, land, out, ck, schema, key="event_id")
    L.ingest_incremental(spark, land, out, ck, schema, key="event_id")
    L.land_by_day(events(range(5, 15)), "ts", land)
    L.ingest_incremental(spark, land, out, ck, schema, key="event_id")
    assert sorted(r.event_id for r in L.read_ingested(spark, out, schema).collect()) == list(range(15))
