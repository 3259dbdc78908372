"""SimHash near-duplicates with pigeonring filtering.

Fingerprint: texts are lower-cased (A-Z only), cut into words
``[^\\x20\\x09-\\x0D]+`` and ``shingle``-word shingles (repeats included, joined
by one space; a shorter text is one shingle of all its words); bit i of the
fingerprint is set if it is set in over half of the shingles' XXH64 (seed 42).
A text without words, or null, has fingerprint zero and is linked like others.

Links: two fingerprints at Hamming distance <= t.  The 64 bits are a ring of
m = t + 1 segments.  By the pigeonring principle some start i has every chain
i..i+l-1 differing in at most l*t/m bits: the first segment in none, the first
two together in at most one.  The index therefore holds each DISTINCT
fingerprint under (first segment, second segment with one of four quarters
blanked) for each start; chains of three and more are checked before the full
distance.  Buckets with over ``BUCKET`` distinct fingerprints (large groups of
near copies) are split again: of t + 1 parts of the still free bits one must
agree, so each part becomes a longer key; with 11 free bits a bucket cannot
exceed 2,048 values.  A bucket yields a spanning forest of its verified links
(not all pairs), which keeps components exact; they come from
``connected_components``.  Copies share a fingerprint and enter once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, connected_components, fresh, join_hot, stage

SHINGLE = 3
MAX_BITS = 3
SEED = 42                 # fixed value: seed of the shingle hash
BUCKET = 2048
FREE_BITS = 11            # 2 ** FREE_BITS == BUCKET
FULL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []   # bytes: ASCII only
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:n - 1]].tolist()
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(flat[s:e], SEED) for s, e in zip(starts, stops)], np.uint64, n)
    bits = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        part = h[k:k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The 64 bits as a signed long."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))
    return run(text.cast("string"))


def _segments(t: int) -> list[int]:
    """Masks of the t + 1 ring segments."""
    edge = [64 * k // (t + 1) for k in range(t + 2)]
    return [(1 << edge[k + 1]) - (1 << edge[k]) for k in range(t + 1)]


def _parts(mask: int, n: int) -> list[int]:
    """``mask`` cut into ``n`` runs of its set bits."""
    on = [b for b in range(64) if mask >> b & 1]
    return [sum(1 << b for b in on[len(on) * k // n:len(on) * (k + 1) // n]) for k in range(n)]


def chain_keys(t: int) -> list[tuple[int, int]]:
    """``(start segment, mask of the bits that must agree)`` of every index entry."""
    seg = _segments(t)
    if t == 0:
        return [(0, FULL)]
    out = []
    for i in range(t + 1):
        nxt = seg[(i + 1) % (t + 1)]
        out += [(i, seg[i] | nxt & ~hole) for hole in _parts(nxt, 4)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _budget_masks(start: int, t: int) -> list[tuple[int, int]]:
    """Ring chains from ``start``: ``(bits of the first l segments, floor(l t / m))``."""
    seg, out, acc = _segments(t), [], 0
    for l in range(1, t + 2):
        acc |= seg[(start + l - 1) % (t + 1)]
        out.append((acc, l * t // (t + 1)))
    return out


def _linker(t: int, starts: list[int]):
    """Kernel over rows sorted by (path, bucket): a spanning forest of each bucket's links."""
    def forest(fp: np.ndarray, start: int) -> np.ndarray:
        root = np.arange(len(fp))
        chains = _budget_masks(start, t)
        for lo in range(0, len(fp), 256):
            x = fp[lo:lo + 256, None] ^ fp[None, lo:]
            i, j = np.nonzero(np.bitwise_count(x & np.uint64(chains[min(1, t)][0])) <= chains[min(1, t)][1])
            keep = i < j
            i, j = i[keep], j[keep]
            for mask, budget in chains[2:]:                   # longer chains, last the whole ring
                ok = np.bitwise_count(x[i, j] & np.uint64(mask)) <= budget
                i, j = i[ok], j[ok]
            i, j = i + lo, j + lo
            while len(i):                                     # hook the larger root on the smaller, then flatten
                ri, rj = root[i], root[j]
                far = ri != rj
                i, j, ri, rj = i[far], j[far], ri[far], rj[far]
                np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
                while (up := root[root]).tobytes() != root.tobytes():
                    root = up
        return root

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[np.ndarray] = [np.zeros((3, 0), np.int64)]
        def flush(block: np.ndarray) -> pd.DataFrame:
            a, b = [], []
            edge = np.flatnonzero(np.r_[True, (block[:2, 1:] != block[:2, :-1]).any(axis=0), True])
            for lo, hi in zip(edge[:-1], edge[1:]):
                fp = block[2, lo:hi]
                root = forest(fp.view(np.uint64), starts[block[0, lo]])
                own = np.flatnonzero(root != np.arange(len(fp)))
                a.append(fp[root[own]])
                b.append(fp[own])
            return pd.DataFrame({"a": np.concatenate(a) if a else np.zeros(0, np.int64),
                                 "b": np.concatenate(b) if b else np.zeros(0, np.int64)})
        for pdf in batches:
            block = np.concatenate([rest[0], pdf[["path", "key", "fp"]].to_numpy(np.int64).T], axis=1)
            if not block.shape[1]:
                continue
            last = np.flatnonzero((block[:2] != block[:2, -1:]).any(axis=0))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield flush(np.ascontiguousarray(block[:, :cut]))
            rest[0] = block[:, cut:]
        if rest[0].shape[1]:
            yield flush(np.ascontiguousarray(rest[0]))
    return run


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, fp: str = "fp") -> DataFrame:
    """``(a, b)``: links of distinct 64-bit fingerprints whose closure has exactly the
    components of the graph "Hamming distance <= max_bits"."""
    spark = fps.sparkSession
    if not 0 <= max_bits <= 15:
        raise ValueError("max_bits must be 0 to 15")
    paths = chain_keys(max_bits)
    values = stage(fps.select(col(fp).cast("long").alias("fp")).where("fp is not null").distinct(), "simhash-values")
    rows = values.withColumn("path", F.explode(F.array(*(F.lit(k) for k in range(len(paths))))))
    out: list[DataFrame] = []
    while max_bits:
        masks = F.array(*(F.lit(_signed(m)) for _, m in paths))
        keyed = rows.withColumn("key", F.col("fp").bitwiseAND(masks[F.col("path")]))
        last = all(64 - m.bit_count() <= FREE_BITS for _, m in paths)
        stats = stage(keyed.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
                      .where("n > 1"), "simhash-buckets")
        apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
        out.append(stats.where("n = 2").where(apart <= max_bits).select("a", "b"))
        some = stats.where("n > 2") if last else stats.where(F.col("n").between(3, BUCKET))
        members = keyed.join(some.select("path", "key"), ["path", "key"])
        out.append(members.repartition("path", "key").sortWithinPartitions("path", "key")
                   .select("path", "key", "fp").mapInPandas(_linker(max_bits, [s for s, _ in paths]), "a long, b long"))
        hot = stats.where(F.col("n") > BUCKET)
        if last or hot.isEmpty():
            break
        width = max_bits + 1
        rows = (keyed.join(hot.select("path", "key"), ["path", "key"])
                .select("fp", F.explode(F.sequence(F.col("path") * width, F.col("path") * width + width - 1)).alias("path")))
        paths = [(s, m | part) for s, m in paths for part in _parts(FULL & ~m, width)]
    links = spark.createDataFrame([], "a long, b long")
    for x in out:
        links = links.unionByName(x)
    return links


def _row_key(doc_id: Column, text: Column) -> Column:
    """A string that tells rows apart by id and text (nulls included)."""
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.hex(F.xxhash64(text)))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: ``doc_id, row_key, fp`` (signed long), ``group`` (a fingerprint that
    stands for the component) and ``component_id``, the smallest id reachable over links (null
    only if all ids of the component are null).

    Repeated ids keep a row each; an empty table gives an empty result; other
    columns are not read."""
    prints = stage(docs.select(col(doc_id).alias("doc_id"), _row_key(col(doc_id), col(text)).alias("row_key"),
                               fingerprints(col(text), shingle).alias("fp")), "simhash-fp")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(near_links(prints, max_bits))
    comp = (least.join(roots.withColumnRenamed("v", "fp"), "fp")
            .groupBy("root").agg(F.min("first").alias("component")))
    members = roots.join(comp, "root").select(F.col("v").alias("fp"), "root", "component")
    named = stage(least.join(members, "fp", "left")
                  .select("fp", "n", F.coalesce("root", "fp").alias("group"), F.coalesce("component", "first").alias("component_id")),
                  "simhash-classes")
    return join_hot(prints, named, ["fp"], "n", prints.count()).select("doc_id", "row_key", "fp", "group", "component_id")


def keep_one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group: its smallest id (null ids last), of rows with that
    id the one with the smallest hash of its text."""
    groups = simhash_groups(docs, doc_id, text, shingle, max_bits)
    best = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("keep"))
    (key,) = fresh(docs, "row_key")
    rows = docs.withColumn(key, _row_key(col(doc_id), col(text)))
    kept = rows.join(best.select(F.col("keep").alias(key)), key, "left_semi")
    return kept.dropDuplicates([key]).select(*(col(c) for c in docs.columns))
