"""Session construction, shared scratch space and join-size policy."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Largest fitted / dimension table (driver-known rows, measured bytes of its
# variable-width columns) that is ever broadcast by hint.  Anything larger, or of
# unknown size, is left to AQE, which measures the shuffled side at runtime and
# either turns the join into a broadcast join (below
# spark.sql.adaptive.autoBroadcastJoinThreshold) or keeps a sort-merge join with
# skew-partition splitting.
BROADCAST_MAX_BYTES = 64 << 20


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "ludex") -> SparkSession:
    """Session tuned for the library: AQE on, UTC, no UI, Arrow transfer."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    wanted = shuffle_partitions or os.environ.get("LUDEX_SHUFFLE_PARTITIONS")
    conf = {} if is_local(master) else cluster_conf(int(os.environ.get("LUDEX_TOTAL_CORES", "50")))
    conf |= {"spark.sql.shuffle.partitions": str(wanted or conf.get("spark.sql.shuffle.partitions", "8"))}
    conf |= {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("LUDEX_DRIVER_MEMORY", "16g"),
    }
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str | None) -> bool:
    """Driver and executors are one process (``local``, ``local[n]``; not ``local-cluster``).

    No master given: the one that spark-submit set, else local."""
    master = master or os.environ.get("MASTER") or "local[*]"
    return re.fullmatch(r"local(\[[^\]]*\])?", master) is not None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be configured (shared storage).  Only a
    local-mode session without one (tests, laptops) gets a fresh folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not is_local(sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ludex-ckpt-", dir="/tmp"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written stage."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def _hadoop_path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on ITS file system (not the driver's disk)."""
    fs, p = _hadoop_path(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder (none where it is missing)."""
    fs, p = _hadoop_path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch stage that nothing reads any more."""
    fs, p = _hadoop_path(spark, path)
    fs.delete(p, True)


def cut_lineage(df: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Write the frame once as parquet under the shared checkpoint folder and read it back.

    Survives executor loss (never a local checkpoint), is computed once, and
    later reads prune columns and push filters.  ``group_rows``: rows of a row group, for rows of
    megabytes (a writer holds a row group, a reader up to a batch of its rows)."""
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    small = {} if group_rows is None else {"parquet.block.row.count.limit": group_rows, "parquet.page.size.row.check.min": 1}
    df.write.options(**small).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop_stage(*stages: DataFrame) -> None:
    """Delete what ``cut_lineage`` wrote, when its last reader is done."""
    for df in stages:
        drop_path(df.sparkSession, df.stage_path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs now: it does when the driver collects its garbage, which a
    driver with memory to spare may not do until the disk is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_VARIABLE = (T.ArrayType, T.MapType, T.StructType, T.StringType, T.BinaryType)


def _table_bytes(df: DataFrame, rows: int) -> int:
    """Bytes of a table of ``rows`` rows: 16 a row, 8 a column of fixed width, 40 and its measured bytes a column of variable width."""
    wide = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, _VARIABLE)]
    size = rows * (16 + 8 * len(df.columns) + 32 * len(wide))
    if wide and size <= BROADCAST_MAX_BYTES:
        text = [c if isinstance(df.schema[i].dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(c))
                for i, c in zip([f.name for f in df.schema.fields if isinstance(f.dataType, _VARIABLE)], wide)]
        size += df.agg(sum((F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c in text), F.lit(0))).first()[0]
    return size


def join_small(left: DataFrame, right: DataFrame, on, how: str = "left",
               known_rows: int | None = None,
               max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Join ``right`` (a fitted or dimension table) onto ``left``.

    ``right`` is broadcast only when the caller knows its row count and its
    measured size is within ``max_bytes``; otherwise the strategy is left to
    AQE's runtime size check, with sort-merge + skew splitting beyond it.
    """
    if known_rows is not None and _table_bytes(right, known_rows) <= max_bytes:
        right = F.broadcast(right)
    return left.join(right, on, how)


def cluster_conf(total_cores: int, shuffle_bytes_per_task: str = "256m") -> dict[str, str]:
    """Settings for a large cluster run (pass to ``SparkSession.builder.config``).

    Shuffle partitions start high (several per core) and AQE coalesces them
    to ~``shuffle_bytes_per_task``; skewed partitions above 5x the median and
    256 MB are split; scans read 256 MB splits.  ``spark.checkpoint.dir`` must
    name the shared folder (e.g. the cluster's distributed file system)."""
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": shuffle_bytes_per_task,
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.shuffle.partitions": str(max(200, 4 * total_cores)),
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.ui.enabled": "false",
    }


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ludex`` importable in the Python workers (mapInPandas kernels).

    The package is zipped once per SparkContext and added with ``addPyFile``,
    which distributes it to every executor (the in-code equivalent of
    ``spark-submit --py-files``)."""
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import ludex
    pkg = os.path.dirname(os.path.abspath(ludex.__file__))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="ludex-pkg-"), "ludex.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
