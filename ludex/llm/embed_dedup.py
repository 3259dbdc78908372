"""Embedding near-duplicates by Euclidean p-stable hashing.

Vectors are scaled to length one, so cosine >= c means a distance of at most
sqrt(2 - 2 c).  Each of ``TABLES`` tables quantises ``PROJECTIONS`` random normal
projections with bin width ``WIDTH``; vectors that share all bins of a table
share its bucket, and every bucket is checked by exact cosines in double
precision.  At cosine 0.9 (distance 0.447) one projection agrees with
probability 0.76, a table with 0.022, and one of 104 tables with 0.90; closer
pairs are found more surely (0.95: over 0.999), unrelated ones meet in a table
with a probability below 2e-6.  ``tables_for`` gives other settings.

Equal vectors enter once, with their number.  A bucket with over ``BLOCK``
different vectors is dealt out as pairs of blocks, so no task gathers it.  A
link found in several tables counts in the first one only, so counts need no
list of pairs; a bucket passes on counts and a spanning forest of its links.

Vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different length never meet.  Repeated ids are rows of
their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, connected_components, stage

COSINE = 0.9
TABLES = 104
PROJECTIONS = 14
WIDTH = 1.5
BLOCK = 1024
SEED = 17


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection agrees for two points at a distance."""
    r = width / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(recall: float, cosine: float = COSINE, projections: int = PROJECTIONS, width: float = WIDTH) -> int:
    """Tables needed to find a pair at the threshold with probability ``recall``."""
    p = agreement(math.sqrt(2 - 2 * cosine), width) ** projections
    return math.ceil(math.log(1 - recall) / math.log(1 - p))


class Hashes:
    """Projections of one dimension; the same on every task."""

    def __init__(self, dim: int, tables: int, projections: int, width: float) -> None:
        rng = np.random.default_rng([SEED, dim])
        self.a = rng.standard_normal((dim, tables * projections)) / width
        self.b = rng.random(tables * projections)
        self.weights = rng.integers(1, 1 << 62, (tables, projections)) | 1
        self.tables = tables

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(vectors, tables) bucket keys."""
        bins = np.floor(unit @ self.a + self.b).astype(np.int64).reshape(len(unit), *self.weights.shape)
        with np.errstate(over="ignore"):
            key = (bins * self.weights).sum(axis=2)
            key ^= (key >> 31) * np.int64(0x5851F42D4C957F2D)
            return key + np.arange(self.tables) * np.int64(0x14057B7EF767814F)


def _unit(vec: np.ndarray) -> np.ndarray:
    top = np.abs(vec).max(axis=1, keepdims=True)             # against overflow and underflow of the squares
    vec = vec / top
    return vec / np.sqrt((vec * vec).sum(axis=1, keepdims=True))


def near_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                 tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = table.select(col(vec_id).alias("vec_id"), col(embedding).cast("array<double>").alias("e"))
    big = F.lit(float("inf"))
    fine = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != big)) & F.exists("e", lambda x: x != 0)
    classes = stage(rows.where(fine).groupBy("e").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
                    .withColumn("cid", F.monotonically_increasing_id()), "embed-classes")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Hashes] = {}
        for pdf in batches:
            for dim, some in pdf.groupby(pdf["e"].map(len)):
                h = made.setdefault(dim, Hashes(dim, tables, projections, width))
                for lo in range(0, len(some), 2000):
                    part = some.iloc[lo:lo + 2000]
                    keys = h.keys(_unit(np.stack(part["e"].to_numpy())))
                    yield pd.DataFrame({"key": keys.ravel(), "t": np.tile(np.arange(tables, dtype=np.int32), len(part)),
                                        "cid": np.repeat(part["cid"].to_numpy(), tables)})

    entries = stage(classes.select("cid", "e").mapInPandas(index, "key long, t int, cid long"), "embed-index")
    shared = entries.groupBy("key", "t").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("cid"), blocks).cast("int")
    met = entries.join(shared, ["key", "t"]).withColumn("own", own)
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("lo"), F.greatest(k, F.col("own")).alias("hi")))
    dealt = met.withColumn("pair", F.explode(pairs)).select("key", "t", "pair.lo", "pair.hi", "own", "cid")
    full = dealt.join(classes.select("cid", "copies", "e"), "cid").select("key", "t", "lo", "hi", "own", "cid", "copies", "e")

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[int, Hashes] = {}

        def check(g: pd.DataFrame) -> pd.DataFrame | None:
            e = g["e"].to_numpy()
            if len({len(x) for x in e}) > 1:                    # a key met by chance across lengths
                parts = [check(s) for _, s in g.groupby(g["e"].map(len)) if len(s) > 1]
                parts = [p for p in parts if p is not None]
                return pd.concat(parts) if parts else None
            unit, t = _unit(np.stack(e)), int(g["t"].iloc[0])
            own, cross = g["own"].to_numpy(), g["lo"].iloc[0] != g["hi"].iloc[0]
            ii, jj = [], []
            for lo in range(0, len(unit), 256):
                i, j = np.nonzero(unit[lo:lo + 256] @ unit.T >= cosine - 1e-9)
                i = i + lo
                keep = (i < j) & ((own[i] != own[j]) if cross else True)
                ii.append(i[keep])
                jj.append(j[keep])
            i, j = np.concatenate(ii), np.concatenate(jj)
            ok = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
            i, j = i[ok], j[ok]
            if not len(i):
                return None
            h = made.setdefault(unit.shape[1], Hashes(unit.shape[1], tables, projections, width))
            used = np.unique(np.r_[i, j])
            at = np.searchsorted(used, np.arange(len(unit)))
            keys = h.keys(unit[used])
            root = np.arange(len(unit))
            fi, fj = i, j
            while len(fi):                                        # spanning forest
                ri, rj = root[fi], root[fj]
                far = ri != rj
                fi, fj, ri, rj = fi[far], fj[far], ri[far], rj[far]
                np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
            for s in range(t):                                    # a link counts in its first table only
                new = keys[at[i], s] != keys[at[j], s]
                i, j = i[new], j[new]
                if not len(i):
                    break
            copies = g["copies"].to_numpy()
            add = np.bincount(i, weights=copies[j], minlength=len(unit)) + np.bincount(j, weights=copies[i], minlength=len(unit))
            cid = g["cid"].to_numpy()
            return pd.DataFrame({"cid": cid[used], "root": cid[root[used]], "links": add[used].astype(np.int64)})

        rest: pd.DataFrame | None = None
        for pdf in batches:
            if rest is not None:
                pdf = pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            ids = pdf[["key", "t", "lo", "hi"]].to_numpy()
            edge = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            for a, b in zip(edge[:-1], edge[1:]):
                if b - a > 1 and (got := check(pdf.iloc[a:b])) is not None:
                    yield got
            rest = pdf.iloc[edge[-1]:]
        if rest is not None and len(rest) > 1 and (got := check(rest)) is not None:
            yield got

    found = stage(full.repartition("key", "t", "lo", "hi").sortWithinPartitions("key", "t", "lo", "hi")
                  .mapInPandas(links, "cid long, root long, links long"), "embed-links")
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = (classes.join(counts, "cid", "left").join(roots.withColumnRenamed("v", "cid"), "cid", "left")
             .select("e", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root")))
    named = stage(named, "embed-named")
    comp = named.groupBy("root").agg(F.min("first").alias("component"))
    final = named.join(comp, "root").select("e", "n_links", "component")
    return (rows.withColumn("e", F.when(fine, F.col("e"))).join(final, "e", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
