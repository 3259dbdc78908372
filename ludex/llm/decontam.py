"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item is cut into windows of ``window`` consecutive words (an
item with fewer words is one window).  Word shingles are ordered by rarity in
the whole corpus; exact containment of a window (threshold 1) leaves a prefix
of ONE shingle, the rarest, that a document must contain.  Documents are
probed with these prefix shingles; a match fixes where the window would start
(positional bound), the document's word range bounds it (length bound), and
the words are then compared one by one.

The documents are never shuffled.  The benchmark is indexed in blocks of at
most ``block_bytes`` of item text (a proven bound of what is shipped to the
tasks); a larger benchmark makes more blocks, each probed by its own column
expression, never a larger broadcast.

Null or empty texts have no words; null item ids count as hits but are not
listed; repeated rows are handled one by one; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, fresh

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 32 << 20
CHUNK_WORDS = 1 << 20

# Word bytes: digits, letters (A-Z folded to a-z) and every byte of a non-ASCII code point.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Index:
    """Windows of one benchmark block over a private word numbering.

    ``groups[n]``: the distinct windows of n words with their shingle codes;
    ``items``: window -> item labels in CSR form."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, shingle: int) -> None:
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for label, text in items:
            w = [self.ids.setdefault(x, len(self.ids)) for x in words_of(text)]
            n = min(window, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                got = found.setdefault(tuple(w[k:k + n]), set())
                if label is not None:
                    got.add(label)
        self.labels = [sorted(found[k]) for k in found]
        self.by_len: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(k) for k in found}):
            at = [i for i, k in enumerate(found) if len(k) == n]
            rows = list(found)
            self.by_len[n] = np.array([rows[i] for i in at], np.int64), np.array(at, np.int64)
        self.size = {n: min(shingle, n) for n in self.by_len}
        self.codes = {s: np.unique(np.concatenate([_codes(w, s).ravel()
                                                   for n, (w, _) in self.by_len.items() if self.size[n] == s]))
                      for s in set(self.size.values())}
        self.prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def choose_prefixes(self, counts: dict[int, np.ndarray]) -> None:
        """Rarest shingle of each window (ties: the smaller code, then the first place)."""
        for n, (w, _) in self.by_len.items():
            s = self.size[n]
            codes = _codes(w, s)
            rank = np.argsort(np.lexsort((self.codes[s], counts[s])))     # code index -> rarity rank
            place = np.argmin(rank[np.searchsorted(self.codes[s], codes)], axis=1)
            key = codes[np.arange(len(w)), place]
            order = np.argsort(key, kind="stable")
            keys, first, many = np.unique(key[order], return_index=True, return_counts=True)
            self.prefix[n] = keys, np.stack([first, many]), order, place[order]


def _codes(rows: np.ndarray, s: int) -> np.ndarray:
    """Shingle codes along the last axis, hashes of 63 bits (occurrences are verified by words); negative where a word is unknown."""
    n = rows.shape[-1] - s + 1
    code, bad = np.zeros(rows.shape[:-1] + (n,), np.uint64), np.zeros(rows.shape[:-1] + (n,), bool)
    for k in range(s):
        part = rows[..., k:k + n]
        code, bad = code * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64), bad | (part < 0)
    return np.where(bad, -1, (code >> np.uint64(1)).astype(np.int64))


def _chunks(texts: pd.Series, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, word numbers of some rows, row bounds)``; rows are held apart by an unknown word."""
    get, ids, bounds, first = index.ids.get, [], [0], 0
    for k, t in enumerate(texts):
        ids += [get(w, -1) for w in words_of(t)]
        ids.append(-1)
        bounds.append(len(ids))
        if len(ids) >= CHUNK_WORDS:
            yield first, np.array(ids, np.int64), np.array(bounds)
            ids, bounds, first = [], [0], k + 1
    if len(bounds) > 1:
        yield first, np.array(ids, np.int64), np.array(bounds)


def _hits(ids: np.ndarray, bounds: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and window number of every verified occurrence."""
    out = []
    for n, (keys, csr, order, place) in index.prefix.items():
        s = index.size[n]
        if len(ids) < s:
            continue
        codes = _codes(ids, s)
        at = np.flatnonzero(codes >= 0)
        near = np.searchsorted(keys, codes[at])
        ok = keys[np.minimum(near, len(keys) - 1)] == codes[at]
        at, near = at[ok], near[ok]
        many = csr[1][near]
        at = np.repeat(at, many)
        pick = np.repeat(csr[0][near] - np.cumsum(many) + many, many) + np.arange(len(at))
        start, win = at - place[pick], order[pick]
        row = np.searchsorted(bounds, at, "right") - 1
        ok = (start >= bounds[row]) & (start + n < bounds[row + 1])       # inside the document's words
        start, win = start[ok], win[ok]
        for k in range(n):                                                # exact words, cheapest first
            ok = ids[start + k] == index.by_len[n][0][win, k]
            start, win = start[ok], win[ok]
        out.append((start, np.full(len(start), n), index.by_len[n][1][win]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _count_rarity(docs: DataFrame, text: str, index: Index) -> dict[int, np.ndarray]:
    """Occurrences in all documents of the block's shingles (sums per task before the shuffle)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {s: np.zeros(len(c), np.int64) for s, c in index.codes.items()}
        for pdf in batches:
            for _, ids, _ in _chunks(pdf.iloc[:, 0], index):
                for s, known in index.codes.items():
                    if len(ids) >= s:
                        codes = _codes(ids, s)
                        codes = codes[codes >= 0]
                        near = np.minimum(np.searchsorted(known, codes), len(known) - 1)
                        sums[s] += np.bincount(near[known[near] == codes], minlength=len(known))
        for s, n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"s": s, "k": at, "n": n[at]})

    found = docs.select(col(text).cast("string").alias("t")).mapInPandas(count, "s int, k long, n long")
    counts = {s: np.zeros(len(c), np.int64) for s, c in index.codes.items()}
    for r in found.groupBy("s", "k").agg(F.sum("n").alias("n")).collect():   # at most the block's shingles
        counts[r.s][r.k] = r.n
    return counts


def _probe(index: Index):
    schema = "n_words long, starts array<int>, ends array<int>, items array<string>"

    @F.pandas_udf(schema)
    def probe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows: list[tuple] = [(0, [], [], [])] * len(texts)
            for first, ids, bounds in _chunks(texts, index):
                for k, n in enumerate(np.diff(bounds) - 1):
                    rows[first + k] = (n, [], [], [])
                start, size, win = _hits(ids, bounds, index)
                order = np.argsort(start, kind="stable")
                start, size, win = start[order], size[order], win[order]
                row = np.searchsorted(bounds, start, "right") - 1
                for k in np.unique(row):
                    lo, hi = np.searchsorted(row, [k, k + 1])
                    s, e = start[lo:hi] - bounds[k], start[lo:hi] + size[lo:hi] - bounds[k]
                    top = np.maximum.accumulate(e)
                    cut = np.flatnonzero(np.r_[True, s[1:] > top[:-1]])
                    labels = sorted({x for w in np.unique(win[lo:hi]) for x in index.labels[w]})
                    rows[first + k] = (rows[first + k][0], s[cut], top[np.r_[cut[1:] - 1, len(s) - 1]], labels)
            yield pd.DataFrame(rows, columns=["n_words", "starts", "ends", "items"])
    return probe


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about ``block_bytes`` of text, cut by a hash of the item."""
    items = benchmark.select(col(item_id).cast("string").alias("i"), col(text).cast("string").alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r.i, r.t) for r in part.distinct().collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                  block_bytes: int = BLOCK_BYTES, out: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``out``: ``n_words, n_hit, items, contaminated``."""
    parts = []
    for items in blocks_of(benchmark, item_id, item_text, block_bytes):
        index = Index(items, window, shingle)
        index.choose_prefixes(_count_rarity(docs, text, index) if index.by_len else {})
        parts.append(_probe(index))
    names = fresh(docs, *(f"probe{k}" for k in range(len(parts))))
    done = docs.withColumns({n: f(col(text).cast("string")) for n, f in zip(names, parts)})
    spans = F.concat(*(F.arrays_zip(col(n)["starts"].alias("s"), col(n)["ends"].alias("e")) for n in names))
    if len(names) == 1:
        n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda x, p: x + p["e"] - p["s"])
    else:
        n_hit = F.size(F.array_distinct(F.flatten(F.transform(spans, lambda p: F.sequence(p["s"], p["e"] - 1))))).cast("long")
    found = F.array_sort(F.array_distinct(F.concat(*(col(n)["items"] for n in names))))
    return (done.withColumn(out, F.struct(col(names[0])["n_words"].alias("n_words"), n_hit.alias("n_hit"),
                                          found.alias("items"), (n_hit > 0).alias("contaminated")))
            .drop(*names))
