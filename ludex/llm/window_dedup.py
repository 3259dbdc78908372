"""Removal of words in repeated windows by level-wise doubling.

A word goes if a window of ``window`` consecutive words that covers it also
starts anywhere else in the corpus, in the same text or another.

Levels: lengths a quarter, half and all of the window (9, 18, 35), each at most
twice the one before; the hash of a longer window joins the hashes of its first
and last shorter one.  Only windows repeated at one length are extended to the
next, until none is left or the full length is reached:

1. Of the quarter windows inside a full one the least by hash (the leftmost of
   ties) stands for it, its anchor, so equal windows have equal anchors and one
   position in fourteen is counted.  Anchors whose quarter window occurs once fall
   out with all windows that they stand for.
2. The half window that extends the anchor to the right, or to the left where
   the window ends before, is counted for the rest.  Consecutive windows with one
   half window are a run; a run's row holds the hashes of its full windows.
3. Runs equal in all full windows are one class.  Classes of two or more runs are
   repeated as a whole.  Where a half window has several classes, full windows are
   counted by half window and full hash (128 bits), each class once or twice.

Scale: texts are shuffled twice (to meet their anchors, and their verdicts); all
counts are partial aggregates.  Keys that hold many rows (copied texts, shared
passages) are split off: hot keys of counts are broadcast (``join_hot``), hot
texts are spread and wholly repeated by definition.  Stages are deleted when
their last reader is done.

Defined results: a null text has no words; texts of fewer than ``window`` words
keep all; nulls, repeated ids and repeated rows get a row each (a repeated row
repeats all its windows); an empty table gives an empty result; very long texts are
hashed in blocks and take some 100 bytes a word in one task; other columns are
not read.  Words equal in 64 bits of their hash count as equal.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import HOT_SHARE, col, drop_stages, join_hot, stage

WINDOW = 35
SLICE = 2 << 20           # bytes of text that a kernel call holds
BLOCK = 1 << 20           # bytes hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the bytes, and the powers of an odd base and of its inverse mod 2^64."""
    base = 0x9E3779B97F4A7C15
    up, down = np.ones((2, n), np.uint64)
    for powers, b in ((up, base), (down, pow(base, -1, 1 << 64))):
        powers[1:] = b
        np.cumprod(powers, out=powers)
    return np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), up, down


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xD6E8FEB86659FD93) + (b ^ (b >> np.uint64(32))) * np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of every word of texts that lie one after another in ``data`` from ``starts`` (with the end) on."""
    blank = _SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    prev = np.concatenate([[True], blank[:-1]]) if len(data) else blank
    begin = np.flatnonzero(~blank & (prev | first[:-1]))
    end = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]]) | first[1:])) + 1 if len(data) else begin
    out = np.zeros(len(begin), np.uint64)
    lo = 0
    while lo < len(begin):                                   # whole words, BLOCK bytes or one longer word at once
        hi = max(int(np.searchsorted(end, begin[lo] + BLOCK, "right")), lo + 1)
        a, b = int(begin[lo]), int(end[hi - 1])
        code, up, down = _powers(1 << max(20, (b - a - 1).bit_length()))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code[data[a:b]] * up[:b - a], dtype=np.uint64)])
        out[lo:hi] = (sums[end[lo:hi] - a] - sums[begin[lo:hi] - a]) * down[begin[lo:hi] - a]
        lo = hi
    return _joined(out, out), np.searchsorted(starts, begin, "right") - 1


def levels(window: int) -> tuple[int, int, int]:
    quarter = -(-window // 4)
    return quarter, min(2 * quarter, window), window


def _longer(h: np.ndarray, size: int, want: int) -> np.ndarray:
    """Hashes of windows of ``want`` words from those of ``size`` words."""
    while size < want:
        step = min(size, want - size)
        h, size = _joined(h[:len(h) - step], h[step:]) if len(h) > step else h[:0], size + step
    return h


def _argmin(h: np.ndarray, n: int) -> np.ndarray:
    """Position of the leftmost least of every ``n`` consecutive values."""
    at, size = np.arange(len(h)), 1
    while size < n:
        step = min(size, n - size)
        a, b = at[:len(at) - step], at[step:]
        at, size = np.where(h[b] < h[a], b, a), size + step
    return at


class _Windows:
    """Windows of the texts of a slice: ``start`` (word), ``anchor`` and the hashes by level."""

    def __init__(self, texts: pa.Array, window: int):
        quarter, half, _ = levels(window)
        buffers, at = texts.buffers(), texts.offset
        offsets = np.frombuffer(buffers[1], np.int32, len(texts) + 1 + at)[at:].astype(np.int64)
        data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        h, self.text = word_hashes(data, offsets - offsets[0])
        n_words = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(n_words) - n_words                        # first word of each text
        self.quarter = _longer(h, 1, quarter)
        self.half = _longer(self.quarter, quarter, half)
        self.full = _longer(self.half, half, window)
        n = len(self.full)
        self.start = np.flatnonzero(self.text[:n] == self.text[window - 1:]) if n else np.zeros(0, np.int64)
        self.anchor = _argmin(self.quarter, window - quarter + 1)[self.start] if n else self.start
        right = self.anchor + half <= self.start + window
        self.pivot = np.where(right, self.anchor, self.anchor + quarter - half)


def _slices(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``SLICE`` bytes of text, or one longer text."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy())])
    lo = 0
    while lo < batch.num_rows:
        hi = max(int(np.searchsorted(sizes, sizes[lo] + SLICE, "right")) - 1, lo + 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _strings(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.string()), "")


def _signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def _anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                w = _Windows(_strings(part.column(2)), window)
                at = np.unique(w.anchor)
                row = w.text[at]
                yield pa.RecordBatch.from_arrays(
                    [_signed(w.quarter[at]), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array((at - w.first[row]).astype(np.int32))], ["h", "k1", "k2", "at"])
    return run


def _runs(window: int):
    """Rows of windows whose anchor is marked (no marks: all), consecutive ones with one half window together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 2):
                w = _Windows(_strings(part.column(2)), window)
                marks = part.column(3)
                row = pc.list_parent_indices(marks).to_numpy()
                marked = np.zeros(len(w.text) + 1, bool)
                marked[pc.list_flatten(marks).to_numpy() + w.first[row]] = True
                whole = np.asarray(pc.is_null(marks))
                on = marked[w.anchor] | whole[w.text[w.start]] if len(w.start) else np.zeros(0, bool)
                start, pivot = w.start[on], w.pivot[on]
                text = w.text[start]
                new = np.concatenate([[True], (np.diff(start) != 1) | (np.diff(pivot) != 0) | (np.diff(text) != 0)]) if len(start) else on[:0]
                lo = np.flatnonzero(new)
                ends = np.concatenate([lo, [len(start)]]).astype(np.int32)
                row = text[lo]
                yield pa.RecordBatch.from_arrays(
                    [_signed(w.half[pivot[lo]]), part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                     pa.array((start[lo] - w.first[row]).astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends), _signed(w.full[start]))], ["h", "k1", "k2", "at", "full"])
    return run


def _keeper(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                n_words, n_removed, kept = [], [], []
                for text, whole, ranges in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    words = (text or "").encode().split()            # bytes split at blanks 9 to 13 and 32 only
                    n_words.append(len(words))
                    if whole and len(words) >= window:
                        words = []
                    elif ranges and not whole:
                        rest, at = [], 0
                        for lo, hi in sorted((r["at"], r["upto"]) for r in ranges):
                            rest += words[at:max(lo, at)]
                            at = max(at, hi)
                        words = rest + words[at:]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                                  pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])
    return run


def _repeated(counted: DataFrame, keys: list[str]) -> DataFrame:
    return counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def remove_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept`` (the words left, joined by one space)."""
    if window < 1:
        raise ValueError("a window has at least one word")
    out = "doc_id long, n_words long, n_removed long, kept string"
    body = col(text).cast("string")
    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), body.alias("text"),
                       F.xxhash64(body).alias("k1"), F.xxhash64(F.lit("second"), body).alias("k2"))
    key = ["k1", "k2"]

    # Texts that make up much of the table (so few): spread over all tasks, and wholly repeated.
    total = rows.count()
    copied = stage(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(1, total // HOT_SHARE)), "windows-copied")
    hot = F.broadcast(copied.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.lit(True).alias("whole")))
    spread = F.when(F.col("whole"), F.xxhash64("k1", "doc_id"))
    texts = (rows.join(hot, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
             .select("doc_id", F.coalesce(spread, "k1").alias("k1"), "k2", "text", F.coalesce("whole", F.lit(False)).alias("whole")))

    # Level 1: anchors.
    anchors = stage(texts.select("k1", "k2", "text").mapInArrow(_anchors(window), "h long, k1 long, k2 long, at int"), "windows-anchors")
    twice = stage(_repeated(anchors, ["h"]), "windows-level1")
    marks = stage(join_hot(anchors, twice, ["h"], "n", anchors.count()).groupBy(*key).agg(F.collect_set("at").alias("marks")), "windows-marks")
    drop_stages(anchors, twice)

    # Level 2: runs of full windows with one half window.
    marked = (texts.join(marks.withColumn("found", F.lit(True)), key, "left").where("found or whole")
              .select("k1", "k2", "text", F.when(~F.col("whole"), F.col("marks")).alias("marks")))
    runs = stage(marked.mapInArrow(_runs(window), "h long, k1 long, k2 long, at int, full array<bigint>")
                 .withColumn("r", F.xxhash64("full")), "windows-runs")
    drop_stages(marks)

    # Level 3: classes of equal runs, then single windows where a half window has several classes.
    n_runs = runs.count()
    classes = stage(runs.groupBy("h", "r").agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("k1", "k2", "at", "full")).alias("one")), "windows-classes")
    several = stage(_repeated(classes, ["h"]), "windows-several")
    settled = join_hot(runs.select("h", "r", "k1", "k2", "at", (F.col("at") + F.size("full") + window - 1).alias("upto")),
                       classes.where("n > 1").select("h", "r", "n"), ["h", "r"], "n", n_runs)
    n_several = several.agg(F.sum("n")).first()[0] or 0
    each = stage(join_hot(classes.withColumnRenamed("n", "weight"), several, ["h"], "n", n_several)
                 .select("h", "weight", "one.k1", "one.k2", "one.at", F.posexplode("one.full").alias("i", "x")), "windows-each")
    counts = each.groupBy("h", "x").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")).where("weight > 1").drop("weight")
    found = join_hot(each.where("weight = 1"), stage(counts, "windows-found"), ["h", "x"], "n", each.count())
    ranges = settled.select(*key, "at", "upto").unionByName(
        found.select(*key, (F.col("at") + F.col("i")).alias("at"), (F.col("at") + F.col("i") + window).alias("upto")))
    verdicts = stage(ranges.groupBy(*key).agg(F.collect_set(F.struct("at", "upto")).alias("ranges")), "windows-verdicts")
    drop_stages(runs, classes, several, each)
    return texts.join(verdicts, key, "left").select("doc_id", "text", "whole", "ranges").mapInArrow(_keeper(window), out)
