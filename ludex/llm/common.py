"""Helpers shared by the corpus operators: column names, stages, components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.session import drop_path, scratch_path

HOT_SHARE = 1000      # a key with over one thousandth of the rows is hot: at most so many keys


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that do not clash (case-insensitively) with ``df``'s."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def col(name: str) -> Column:
    """A column by its literal name (dots and blanks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and reread it.

    Cuts the lineage with a file that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def drop_stages(*stages: DataFrame) -> None:
    """Delete stages whose last reader is done, and let Spark drop the shuffle files of finished jobs."""
    for df in stages:
        drop_path(df.sparkSession, df.stage_path)
    if stages:
        gc.collect()
        stages[0].sparkSession._jvm.System.gc()


def byte_slices(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to ``limit`` bytes in a string or binary column, or one longer row."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy())])
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def give_back() -> None:
    """Return a Python worker's freed memory to the system (workers outlive their tasks)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):        # another C library
        pass


def giving_back(kernel: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A ``mapIn...`` kernel that gives memory back when its task's rows are done."""
    @functools.wraps(kernel)
    def run(batches: Iterator) -> Iterator:
        yield from kernel(batches)
        give_back()
    return run


def join_hot(facts: DataFrame, dim: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``facts`` to the one ``dim`` row of its key (nulls match); ``dim[size]`` is the key's rows in ``facts``.

    Keys with over 1 / ``HOT_SHARE`` of the ``total`` rows (so fewer than ``HOT_SHARE`` of them) are broadcast,
    so no task gathers a hot key; the other keys are shuffled.  ``size`` is dropped."""
    least = total // HOT_SHARE
    rest = [c for c in dim.columns if c not in on and c != size]
    hot, cold = dim.where(F.col(size) > least), dim.where(F.col(size) <= least)

    def joined(left: DataFrame, right: DataFrame, few: bool, how: str = "inner") -> DataFrame:
        right = right.select(*(F.col(c).alias(f"_on{i}") for i, c in enumerate(on)), *rest)
        cond = None
        for i, c in enumerate(on):
            same = F.col(c).eqNullSafe(F.col(f"_on{i}"))
            cond = same if cond is None else cond & same
        out = left.join(F.broadcast(right) if few else right, cond, how)
        return out if how == "leftanti" else out.drop(*(f"_on{i}" for i in range(len(on))))

    others = joined(facts, hot, True, "leftanti")
    return joined(facts, hot, True).unionByName(joined(others, cold, False))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, root)`` for every vertex of an undirected edge table of longs.

    Randomised contraction: per round every vertex points to the closed
    neighbour with the least seeded hash, edges are rewritten to the pointed-to
    vertices and loops dropped, so the graph shrinks by a constant factor in
    expectation whatever its shape (chains included).  Per-vertex minima are
    partial aggregates, so a hub is never gathered; every round is a written
    stage.  Null vertices and loops are ignored.
    """
    spark = edges.sparkSession
    e = (edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
         .where("a is not null and b is not null and a <> b"))
    cur = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    maps: list[DataFrame] = []
    while not cur.isEmpty():
        seed = F.lit(len(maps))
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hb, ha = F.xxhash64("b", seed), F.xxhash64("v", seed)
        best = both.groupBy(F.col("a").alias("v")).agg(F.min(hb).alias("h"), F.min_by("b", hb).alias("n"))
        m = stage(best.select("v", F.when(F.col("h") < ha, F.col("n")).otherwise(F.col("v")).alias("r")), "cc-map")
        maps.append(m)
        nxt = (cur.join(m.select(F.col("v").alias("a"), F.col("r").alias("ra")), "a")
               .join(m.select(F.col("v").alias("b"), F.col("r").alias("rb")), "b")
               .where("ra <> rb")
               .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        cur = stage(nxt, "cc-edges")
    if not maps:
        return spark.createDataFrame([], "v long, root long")
    out = maps[-1].select("v", F.col("r").alias("root"))
    for m in reversed(maps[:-1]):
        nx = out.select(F.col("v").alias("r"), F.col("root").alias("next"))
        out = m.join(nx, "r", "left").select("v", F.coalesce("next", "r").alias("root"))
    return stage(out, "cc-roots")
