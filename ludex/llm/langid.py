"""Language identification by language-bitmask n-gram filters.

Fit: character 3-grams (one per letter: the letter with its neighbours, other
characters folded to a blank) are counted by language over ALL training rows;
a language's profile holds the n-grams with a relative frequency of at least
``MIN_SHARE``, hence at most 1 / MIN_SHARE of them whatever the corpus size.
The profiles go into one bit-sliced Bloom filter: an array of slots, each a
bitmask of languages.  The AND of an n-gram's ``HASHES`` slots has a bit for
every language that holds it.

Predict: popcounts per language over a text's n-grams; a language whose bits
fill a share f of the slots shows f ** HASHES of foreign n-grams by chance, so
with n n-grams the count c becomes (c - n p) / (1 - p), p that rate.  The
largest corrected count decides (ties: the smaller language name); the score is
its share of all corrected counts.  ``und`` with score 0: null text, no letter,
or nothing learned; no known n-gram: the language with most training n-grams,
score 0.  Rows with null language are not learned from; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col, stage

MIN_SHARE = 2e-5
HASHES = 3
SLOTS_PER_GRAM = 12
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"

_letter: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters (one table per process)."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def grams(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, n-gram codes, bounds by row)`` for runs of texts of about ``CHUNK_CHARS``."""
    part: list[str] = []
    held = first = 0
    for k, t in enumerate([*texts, None]):
        if part and (k == len(texts) or held >= CHUNK_CHARS):
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            c = np.frombuffer(("\n" + "\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
            is_letter = letters()[c]
            c = np.where(is_letter, c, 32).astype(np.uint64)
            mid = np.flatnonzero(is_letter)
            code = c[mid - 1] << np.uint64(42) | c[mid] << np.uint64(21) | c[mid + 1]
            yield first, code, np.searchsorted(mid, np.r_[1, 1 + np.cumsum(size)])
            part, held, first = [], 0, k
        if k < len(texts):
            part.append((t or "").lower())
            held += len(part[-1])


def _mix(code: np.ndarray, k: int) -> np.ndarray:
    x = code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k * 0xBF58476D1CE4E5B9 & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x >> np.uint64(32)


@dataclass
class BitmaskFilter:
    """Slots of language bits; ``words`` 64-bit words (slices) hold any number of languages."""
    langs: list[str]
    slots: np.ndarray            # (words, slots)
    fill: np.ndarray             # false-positive rate per language
    default: str

    @classmethod
    def build(cls, profile: dict[str, np.ndarray], default: str) -> BitmaskFilter:
        langs = sorted(profile)
        kind = np.uint8 if len(langs) <= 8 else np.uint64
        per = 8 * np.dtype(kind).itemsize
        held = len(np.unique(np.concatenate([profile[x] for x in langs]))) if langs else 0
        size = 1 << max(10, int(held * SLOTS_PER_GRAM - 1).bit_length())
        slots = np.zeros((-(-len(langs) // per) or 1, size), kind)
        for k, x in enumerate(langs):
            for h in range(HASHES):
                slots[k // per][_mix(profile[x], h) & np.uint64(size - 1)] |= kind(1 << k % per)
        share = [np.count_nonzero(slots[k // per] >> kind(k % per) & kind(1)) / size for k in range(len(langs))]
        return cls(langs, slots, np.array(share) ** HASHES, default)

    def languages(self, code: np.ndarray) -> np.ndarray:
        """(words, n-grams) bitmasks of the languages that hold each n-gram."""
        keep = np.uint64(self.slots.shape[1] - 1)
        mask = self.slots[:, _mix(code, 0) & keep]
        for h in range(1, HASHES):
            mask &= self.slots[:, _mix(code, h) & keep]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        per = 8 * self.slots.dtype.itemsize
        for first, code, bounds in grams(texts):
            if not self.langs:
                continue
            n = np.diff(bounds)
            some = np.flatnonzero(n)
            mask = self.languages(code)
            one = self.slots.dtype.type(1)
            hits = np.stack([np.add.reduceat((mask[k // per] >> self.slots.dtype.type(k % per) & one).astype(np.int32), bounds[some])
                             if len(some) else np.zeros(0) for k in range(len(self.langs))], axis=1)
            fixed = np.maximum(0, (hits - n[some, None] * self.fill) / (1 - self.fill))
            for row, at, top, total in zip(some, fixed.argmax(axis=1), fixed.max(axis=1), fixed.sum(axis=1)):
                pred[first + row] = self.langs[at] if top > 0 else self.default
                score[first + row] = top / total if top > 0 else 0.0
        return pred, score


def fit(train: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> BitmaskFilter:
    """The filter learned from all rows of ``train`` (sums per task, then per key)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, some in pdf.groupby("lang"):
                got = [np.unique(code, return_counts=True) for _, code, _ in grams(some["text"].tolist())]
                if got:
                    code, where = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                    n = np.bincount(where, weights=np.concatenate([n for _, n in got])).astype(np.int64)
                    yield pd.DataFrame({"lang": name, "gram": code.astype(np.int64), "n": n})

    rows = (train.select(col(text).cast("string").alias("text"), col(lang).cast("string").alias("lang"))
            .where("text is not null and lang is not null"))
    sums = rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = stage(sums, "langid-grams")
    total = {r.lang: r.n for r in sums.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not total:
        return BitmaskFilter.build({}, UNKNOWN)
    least = F.create_map(*(x for k, n in total.items() for x in (F.lit(k), F.lit(n * min_share))))[F.col("lang")]
    kept = sums.where(F.col("n") >= least).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    profile = {r.lang: np.array(sorted(r.grams), np.int64).astype(np.uint64) for r in kept}    # <= 1 / min_share each
    return BitmaskFilter.build(profile, min(total, key=lambda k: (-total[k], k)))


def predict(text: Column, model: BitmaskFilter) -> Column:
    """Struct ``lang_pred, score`` of a text column (the filter's size is bounded by its languages)."""
    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            pred, score = model.predict(texts.tolist())
            yield pd.DataFrame({"lang_pred": pred, "score": score})
    return run(text.cast("string"))


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; rows whose crc32(id) mod 4 is 2 are held out
    of the fit (a null id is not held out)."""
    held = F.coalesce(F.pmod(F.crc32(col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
    model = fit(docs.where(~held), text, lang)
    got = docs.select(col(doc_id).alias("doc_id"), held.alias("held_out"), predict(col(text), model).alias("p"))
    return got.select("doc_id", "held_out", F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))
