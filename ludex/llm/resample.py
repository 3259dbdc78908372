"""Target-distribution importance resampling on hashed word n-grams.

Every run of one to ``ORDER`` words is a feature and falls in a bucket by its
CRC-32.  A bucket's gain is the scaled log ratio of its smoothed share in the
target texts (``benchmark``) and in the raw texts; a document's weight is the sum
of the gains of its features.  Adding Gumbel noise that depends on the id alone
and keeping the largest scores draws without replacement by weight.

The kernel works on whole Arrow columns: ``ascii_lower``, ``split_pattern_regex``
and a flattened, dictionary-encoded word column.  Shifted dictionary indices
form n-gram codes, which are dictionary-encoded again, so the CRC of a distinct
n-gram is computed once, from the CRC of its prefix and of its last word; gains
are then taken by index and summed per document by segments.

Scale: two passes over the texts, no shuffle of texts or features.  A task sends
one sum per bucket; the driver holds ``buckets`` gains.  The draw orders only
the rows at or above the cut, found by histograms of at most ``BINS`` rows.

Defined results: null and empty texts have no features and weight 0; a null id
hashes as the empty string; rows that repeat an id get the same noise and a row
each; ties go to the smaller id, null first; texts beyond ``SLICE`` bytes
are counted in pieces that overlap by ``ORDER`` - 1 words, so their features are
those of the whole text; empty tables give empty results or gains of the other
table alone; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, stage
from ludex.operators.ordered import running_total

BUCKETS = 10_000
ORDER = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
SLICE = 2 << 20           # bytes of text that a kernel call holds
BINS = 4096
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BREAK = re.compile(BREAK.encode())


def _zeros() -> np.ndarray:
    """Table of the CRC register's step over one zero byte: [byte of the register, its value]."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    v = np.arange(256, dtype=np.uint32)
    return np.stack([c, v, v << np.uint32(8), v << np.uint32(16)])


def _step(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24])


@functools.cache
def _steps() -> tuple[np.ndarray, list[np.ndarray]]:
    """Tables of 0 to 63 zero bytes, and of 64 times every power of two."""
    one = _zeros()
    v = np.arange(256, dtype=np.uint32)
    tables = [np.stack([v << np.uint32(8 * k) for k in range(4)])]
    for _ in range(64):
        tables.append(_step(one, tables[-1]))
    far = [tables.pop()]
    for _ in range(26):
        far.append(_step(far[-1], far[-1]))
    return np.stack(tables), far


def crc_joined(crc: np.ndarray, tail: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of a string followed by one of ``size`` bytes, from both CRCs."""
    near, far = _steps()
    rest = size & 63
    out = near[rest, 0, crc & 255] ^ near[rest, 1, crc >> 8 & 255] ^ near[rest, 2, crc >> 16 & 255] ^ near[rest, 3, crc >> 24]
    for k in range(int(size.max(initial=0)).bit_length() - 6):
        on = np.flatnonzero(size >> (6 + k) & 1)
        out[on] = _step(far[k], out[on])
    return out ^ tail


def feature_buckets(texts: pa.Array, skip: np.ndarray, buckets: int, order: int = ORDER) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and per n-gram length the rows and buckets of its n-grams in row order.

    n-grams that end in the first ``skip`` words of a row are left out."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAK)
    words, row = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    words, row = words.filter(full).dictionary_encode(), row[full.to_numpy(zero_copy_only=False)].astype(np.int64)
    n_words = np.bincount(row, minlength=len(texts))
    idx, names = words.indices.to_numpy().astype(np.int64), [w.encode() for w in words.dictionary.to_pylist()]
    size = np.array([len(w) + 1 for w in names], np.int64)
    tail = np.array([zlib.crc32(b" " + w) for w in names], np.uint32)
    crc = np.array([zlib.crc32(w) for w in names], np.uint32)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n_words) - n_words, n_words)   # within the row
    new = place >= skip[row]
    out = [(row[new], crc[idx[new]].astype(np.int64) % buckets)]
    at, code = np.arange(len(row)), idx                                              # first word and code of each n-gram
    for n in range(1, order):
        go = at + n < len(row)
        at, code = at[go], code[go]
        go = row[at] == row[at + n]
        at, code = at[go], code[go]
        pairs = pa.array(code * max(len(names), 1) + idx[at + n]).dictionary_encode()
        distinct, code = pairs.dictionary.to_numpy(), pairs.indices.to_numpy().astype(np.int64)
        head, last = distinct // max(len(names), 1), distinct % max(len(names), 1)
        crc = crc_joined(crc[head], tail[last], size[last])
        new = place[at] + n >= skip[row[at]]
        out.append((row[at[new]], crc[code[new]].astype(np.int64) % buckets))
    return n_words, out


def _slices(texts: pa.Array, order: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, texts, words to skip) of up to ``SLICE`` bytes; a longer text in overlapping pieces."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())])
    lo = 0
    while lo < len(texts):
        hi = max(int(np.searchsorted(sizes, sizes[lo] + SLICE, "right")) - 1, lo + 1)
        if sizes[hi] - sizes[lo] <= SLICE:
            yield lo, texts.slice(lo, hi - lo), np.zeros(hi - lo, np.int64)
        else:
            whole, start, before = texts[lo].as_py().encode(), 0, []
            while start < len(whole):
                cut = _BREAK.search(whole, min(start + SLICE, len(whole)))
                end = cut.end() if cut else len(whole)
                piece = b" ".join([*before, whole[start:end]])
                yield lo, pa.array([piece.decode()]), np.array([len(before)], np.int64)
                before = [w for w in _BREAK.split(piece) if w][1 - order:] if order > 1 else []
                start = end
        lo = hi


def _counter(buckets: int, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts, skip in _slices(pc.fill_null(batch.column(0), ""), order):
                for _, bucket in feature_buckets(texts, skip, buckets, order)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, order: int = ORDER) -> np.ndarray:
    """Features per bucket over all texts."""
    parts = texts.select(col(text).cast("string").alias("text")).mapInArrow(_counter(buckets, order), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of smoothed shares per bucket, floored."""
    b, S, T = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(S + b) / (float(s + 1) * float(T + b))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Scaled Gumbel noise of an id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scorer(gain: np.ndarray, order: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for lo, texts, skip in _slices(pc.fill_null(batch.column(1), ""), order):
                words, grams = feature_buckets(texts, skip, len(gain), order)
                n_words[lo:lo + len(words)] += words - skip
                for row, bucket in grams:
                    n = np.bincount(row, minlength=len(texts))
                    sums = np.concatenate([[0], np.cumsum(gain[bucket])])
                    ends = np.cumsum(n)
                    n_features[lo:lo + len(n)] += n
                    weight[lo:lo + len(n)] += sums[ends] - sums[ends - n]
            ids = batch.column(0)
            score = weight + np.array([noise(d, seed) for d in ids.to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words, n_features, weight, score))],
                                             ["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def nth_largest(df: DataFrame, value: str, n: int) -> int | None:
    """The n-th largest of a long column (exact; null if there are fewer): histograms of at most ``BINS`` bins."""
    ends = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < 1 or n > ends[2]:
        return None
    lo, hi = ends[0], ends[1]
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        bins = (df.where(F.col(value).between(lo, hi)).groupBy(((F.col(value) - lo) / width).cast("long").alias("bin"))
                .count().orderBy(F.desc("bin")).collect())
        for r in bins:
            if n <= r["count"]:
                lo, hi = lo + r["bin"] * width, min(hi, lo + (r["bin"] + 1) * width - 1)
                break
            n -= r["count"]
    return lo


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
             buckets: int = BUCKETS, order: int = ORDER, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_features, weight, score, rank``.

    ``rank`` (1, 2, ...) numbers the drawn documents, the floor of ``percent``
    per cent of those with at least ``min_words`` words; it is null for others."""
    gain = gains(bucket_counts(docs, text, buckets, order), bucket_counts(target, target_text, buckets, order))
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    scored = stage(rows.mapInArrow(_scorer(gain, order, seed), "doc_id long, n_words long, n_features long, weight long, score long"),
                   "resample-scores")
    able = scored.where(F.col("n_words") >= min_words)
    draw = percent * able.count() // 100
    cut = nth_largest(able, "score", draw)
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    top = (F.col("n_words") >= min_words) & (F.col("score") >= cut)
    order_by = [F.col("score").desc(), F.col("doc_id").asc(), F.col("n_features").asc(), F.col("weight").asc()]
    drawn = running_total(scored.where(top).withColumn("one", F.lit(1).cast("long")), order_by, "one", "rank").drop("one")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return drawn.unionByName(scored.where(~top).withColumn("rank", F.lit(None).cast("long")))
