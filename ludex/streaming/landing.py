"""Resumable incremental ingest of landed files.

The reference pulls pages from web APIs, saves a progress marker and a
partial output periodically, and continues where it stopped after a
restart.  On Spark the same contract is a Structured Streaming file source
with a checkpoint: ``trigger(availableNow=True)`` processes every file not
yet recorded in the checkpoint's source log and stops; a rerun after a crash
or with new files picks up exactly the unprocessed ones.  The sink is
``foreachBatch`` writing each micro-batch to its own folder
``run=<checkpoint>/batch=<id>`` with overwrite: a replayed batch replaces its
own output, and another checkpoint (whose ids start at 0 again) never touches
it.  A ``key`` is unique over the whole ingested table: rows of a batch whose
key was landed by an earlier batch or run are dropped (``KeyLedger``: a batch
reads the filters of its buckets and the keys that may be known, not the table).
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.operators.assemble import first_per_key
from ludex.session import cut_lineage, drop_path, list_names, path_exists, ship_package


def land_by_day(df: DataFrame, ts: str, path: str, mode: str = "append") -> None:
    """Write NDJSON files partitioned by the day of ``ts`` (the landing zone)."""
    df.withColumn("day", F.to_date(ts).cast("string")).write.mode(mode).partitionBy("day").json(path)


class BucketedTable:
    """A table in hash buckets of ``key`` with versions: ``data/v=N/_bucket=K`` and ``manifest/v=N`` under ``path``.

    A commit writes the files of new buckets under its own version and then the manifest (which folders make up
    which bucket, and how many buckets there are); the manifest's success marker is the commit.  A crash before
    it leaves the version before, whose files are never touched; the replay overwrites the half-written version.
    The driver holds the manifest: at most ``FOLDERS`` rows a bucket.  Folders that two versions no
    longer name are deleted."""

    FOLDERS = 16

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.version, self.folders, self.schema = 0, {}, None
        versions = [v for v in self._versions() if path_exists(spark, f"{self.path}/manifest/v={v}/_SUCCESS")]
        if versions:
            self.version = max(versions)
            rows = spark.read.parquet(f"{self.path}/manifest/v={self.version}").collect()
            self.key, self.buckets = rows[0]["key"], rows[0]["buckets"]       # the stored ones count
            self.schema = T.StructType.fromJson(json.loads(rows[0]["columns"]))
            for r in sorted(rows, key=lambda r: r["folder"] or ""):
                if r["folder"] is not None:
                    self.folders.setdefault(r["bucket"], []).append(r["folder"])

    def _versions(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in list_names(self.spark, f"{self.path}/manifest") if n.startswith("v="))

    def bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_bucket", F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int"))

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of all or some buckets (with ``_bucket``); None before the first commit."""
        if self.schema is None:
            return None
        paths = [f for b, fs in self.folders.items() if buckets is None or b in set(buckets) for f in fs]
        full = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.bucketed(self.spark.read.schema(self.schema).parquet(*paths)).select(*full.names)

    def commit(self, rows: DataFrame, replace: bool) -> None:
        """Write rows (with ``_bucket``) as the next version: in place of their buckets' rows, or beside them."""
        new, columns = self.version + 1, rows.drop("_bucket")
        if self.schema is not None and set(columns.columns) != set(self.schema.names):
            raise ValueError(f"columns differ from the table's: {sorted(set(columns.columns) ^ set(self.schema.names))}")
        where = f"{self.path}/data/v={new}"
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(where)
        wrote = sorted(int(n.partition("=")[2]) for n in list_names(self.spark, where) if n.startswith("_bucket="))
        folders = {b: list(f) for b, f in self.folders.items()}
        for b in wrote:
            folders[b] = [*([] if replace else folders.get(b, [])), f"{where}/_bucket={b}"]
        schema = self.schema or columns.schema
        stored = (self.key, self.buckets, schema.json())
        flat = [(b, f, *stored) for b, fs in folders.items() for f in fs] or [(None, None, *stored)]
        self.spark.createDataFrame(flat, "bucket int, folder string, key string, buckets int, columns string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.path}/manifest/v={new}")
        before = {f for fs in self.folders.values() for f in fs}
        self._forget(before | {f for fs in folders.values() for f in fs})
        self.version, self.folders, self.schema = new, folders, schema

    def _forget(self, named: set[str]) -> None:
        """Delete folders that neither the last version nor the one before names, and older manifests."""
        for v in [v for v in self._versions() if v < self.version]:
            rows = self.spark.read.parquet(f"{self.path}/manifest/v={v}").collect()
            for r in rows:
                if r["folder"] is not None and r["folder"] not in named:
                    drop_path(self.spark, r["folder"])
            drop_path(self.spark, f"{self.path}/manifest/v={v}")


def upsert_latest(batch: DataFrame, snapshot: str, key: str, order: list[str], buckets: int = 64) -> None:
    """Merge a batch into a snapshot that keeps the latest row per ``key`` (largest ``order``).

    The snapshot is a ``BucketedTable`` (``buckets``: choose it so that a bucket is a few hundred MB; a table
    keeps the number that it was made with).  Only the buckets that the batch touches are read, merged with one
    ``max(struct(order, ...))`` aggregate per key and written as a new version.  Re-applying the same batch
    gives the same snapshot.  Columns must be those of the snapshot: a batch with others is refused."""
    table = BucketedTable(batch.sparkSession, snapshot, key, buckets)
    merged = table.bucketed(batch)
    if table.schema is not None:
        if set(table.schema.names) != set(batch.columns):
            raise ValueError(f"columns differ from the snapshot's: {sorted(set(table.schema.names) ^ set(batch.columns))}")
        touched = [r[0] for r in merged.select("_bucket").distinct().collect()]      # at most ``buckets`` values
        merged = table.read(touched).unionByName(merged)
    rest = [c for c in merged.columns if c not in [key, *order]]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    latest = merged.groupBy(key).agg(F.max(packed).alias("_m")).select(
        key, *[F.col(f"_m._o{i}").alias(c) for i, c in enumerate(order)], *[F.col(f"_m.{c}").alias(c) for c in rest])
    table.commit(latest.select(*batch.columns, "_bucket"), replace=True)


def read_snapshot(spark: SparkSession, snapshot: str) -> DataFrame:
    """The snapshot's last committed version."""
    rows = BucketedTable(spark, snapshot, "").read()         # the key is stored
    if rows is None:
        raise FileNotFoundError(f"no committed snapshot in {snapshot}")
    return rows.drop("_bucket")


class KeyLedger:
    """Keys that were landed, with the run and batch that did, and a Bloom filter per bucket.

    A batch's keys are first held against the filters of their buckets (one row of ``BITS`` bits each, met by
    a cogroup, so neither filters nor keys pass the driver); only keys that may be known are looked up,
    and only in the buckets that have such keys.  New keys are added as further files of their buckets."""

    BITS = 1 << 23            # 1 MB a bucket: 1 % false hits at some 900,000 keys; more keys cost lookups, not results
    HASHES = 4

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64) -> None:
        self.spark, self.key = spark, key
        self.keys = BucketedTable(spark, f"{path}/keys", key, buckets)
        self.filters = BucketedTable(spark, f"{path}/filters", "b", buckets)

    def _hashed(self, df: DataFrame) -> DataFrame:
        return self.keys.bucketed(df.select(self.key)).withColumn("_h", F.xxhash64(F.col(self.key), F.lit(1)))

    def _bits(self) -> DataFrame:
        old = self.filters.read()
        return self.spark.createDataFrame([], "b int, bits binary") if old is None else old.select("b", "bits")

    def unknown(self, batch: DataFrame, run: str, number: int) -> DataFrame:
        """Rows of the batch whose key no other batch landed (a replay does not see itself)."""
        if self.keys.schema is None:
            return batch
        bits, hashes = self.BITS, self.HASHES
        hashed = self._hashed(batch)
        schema = T.StructType([hashed.schema[self.key], hashed.schema["_bucket"]])

        def probe(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(rows):
                return rows.iloc[:0][schema.names]
            at = _positions(rows["_h"].to_numpy(), bits, hashes)
            known = np.frombuffer(held["bits"].iloc[0], np.uint8)
            return rows[((known[at >> 3] >> (at & 7)) & 1).all(axis=0)][schema.names]

        maybe = cut_lineage(hashed.groupBy("_bucket").cogroup(self._bits().groupBy("b")).applyInPandas(probe, schema))
        some = [r[0] for r in maybe.select("_bucket").distinct().collect()]          # at most ``buckets`` values
        mine = (F.col("run") == run) & (F.col("batch") == number)
        landed = self.keys.read(some).filter(~mine).select(self.key)
        return batch.join(landed.join(maybe.select(self.key), self.key, "left_semi"), self.key, "left_anti").select(*batch.columns)

    def add(self, batch: DataFrame, run: str, number: int) -> None:
        """Record the keys of a written batch; a replay adds the same ones again, which does no harm."""
        keys = self.keys.bucketed(batch.filter(F.col(self.key).isNotNull()).select(
            self.key, F.lit(run).alias("run"), F.lit(number).cast("int").alias("batch")))
        bits, hashes = self.BITS, self.HASHES

        def merge(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            known = np.frombuffer(held["bits"].iloc[0], np.uint8).copy() if len(held) else np.zeros(bits >> 3, np.uint8)
            at = _positions(rows["_h"].to_numpy(), bits, hashes).ravel()
            np.bitwise_or.at(known, at >> 3, (1 << (at & 7)).astype(np.uint8))
            return pd.DataFrame({"b": [int((rows["_bucket"] if len(rows) else held["b"]).iloc[0])], "bits": [known.tobytes()]})

        filters = self._hashed(batch).groupBy("_bucket").cogroup(self._bits().groupBy("b")).applyInPandas(merge, "b int, bits binary")
        self.filters.commit(self.filters.bucketed(filters), replace=True)             # first: a filter may know too much, never too little
        full = [b for b, f in self.keys.folders.items() if len(f) >= BucketedTable.FOLDERS]
        if full:
            self.keys.commit(self.keys.read(full).unionByName(keys.filter(F.col("_bucket").isin(full))).distinct(), replace=True)
            keys = keys.filter(~F.col("_bucket").isin(full))
        self.keys.commit(keys, replace=False)


def _positions(h: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Bits of each hash: (hashes, keys)."""
    h = h.astype(np.int64).view(np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) % np.uint64(bits)).astype(np.int64) for k in range(hashes)])


def _run_name(checkpoint: str) -> str:
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def ingest_incremental(spark: SparkSession, src: str, dst: str, checkpoint: str, schema: T.StructType,
                       key: str | None = None, max_files_per_trigger: int | None = None,
                       snapshot: tuple[str, str, list[str]] | None = None, buckets: int = 64) -> int:
    """Process every landed file not yet in the checkpoint; returns the
    number of micro-batches run.  ``key`` keeps one row per key in the whole
    table (the first landed; within a batch the first by the other columns);
    ``snapshot=(path, key, order)`` also upserts the latest row per key.

    Each batch is evaluated once, into its own folder; snapshot and later
    batches read that folder."""
    reader = spark.readStream.schema(schema).option("basePath", src)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.json(src)
    ship_package(spark)
    run, runs = _run_name(checkpoint), []

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = batch
        if key:
            ledger = KeyLedger(spark, f"{dst}/_keys", key, buckets)       # the file listing of ``dst`` skips the folder
            out = ledger.unknown(cut_lineage(first_per_key(batch, key, [c for c in batch.columns if c != key])), run, batch_id)
        path = f"{dst}/run={run}/batch={batch_id}"
        out.write.mode("overwrite").parquet(path)
        if key:
            ledger.add(spark.read.schema(batch.schema).parquet(path), run, batch_id)
        if snapshot is not None:
            upsert_latest(spark.read.schema(batch.schema).parquet(path), *snapshot, buckets=buckets)
        runs.append(batch_id)

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return len(runs)


def _landed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.IntegerType())])


def read_ingested(spark: SparkSession, dst: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """The ingested table (all runs and batches), empty if nothing was landed; a key keeps one row per key."""
    if not path_exists(spark, dst):
        return spark.createDataFrame([], schema)
    df = spark.read.schema(_landed(schema)).parquet(dst).drop("run", "batch")
    return first_per_key(df, key, [c for c in df.columns if c != key]) if key else df
