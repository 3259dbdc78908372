"""Toxicity as severity grades: cumulative-link ordinal regression on sparse words.

Model: P(grade > k) = sigmoid(w.x - b_k) with ONE weight vector w for all
thresholds b_0 < b_1 < ...; x holds 1 for each vocabulary word that occurs in
the text.  Severity is the expected grade, sum over k of P(grade > k).

Labels say toxic or not; grades above 1 come from the text: a toxic row whose
number of telling words (log-odds over ``TELLING`` in the sample) lies above
the median of the toxic rows is graded 2.  ``fit`` takes any integer grades.

The classifier is fitted on a bounded sample: ``SAMPLE`` labelled rows per
class, those with the smallest hash of the id, weighted back to the class's
size.  Scoring reads every word of every text.

A text is rejected at P(grade > 0) >= ``REJECT``.  Null or empty texts have no
words; ids that are labelled twice count as toxic if any label says so; null
labels and labels without document are left out.  With fewer than two grades
in the labels nothing is learned and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.llm.common import col

SAMPLE = 3000             # labelled rows per class the classifier is fitted on
VOCABULARY = 512
MIN_ROWS = 3
TELLING = 2.0
PENALTY = 0.02
STEPS = 400
REJECT = 0.3

# Letters: ASCII letters folded to lower case, and all bytes of other code points.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def word_set(text: str | None) -> set[bytes]:
    return set(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) if text else set()


@dataclass
class OrdinalModel:
    weights: dict[bytes, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)      # increasing; none: nothing learned

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for every threshold."""
        s = sum(self.weights[w] for w in sorted(word_set(text) & self.weights.keys()))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - s, -500, 500)))


def fit_ordinal(words: list[set[bytes]], grades: np.ndarray, weight: np.ndarray | None = None,
                vocabulary: int = VOCABULARY, penalty: float = PENALTY, steps: int = STEPS) -> OrdinalModel:
    """Penalised maximum likelihood (Adam on the exact gradient) over the words that tell grades apart."""
    top = int(grades.max(initial=0))
    if not len(grades) or not top or not (grades == 0).any():
        return OrdinalModel()
    weight = np.ones(len(grades)) if weight is None else weight
    seen: dict[bytes, list[int]] = {}
    for k, ws in enumerate(words):
        for w in ws:
            seen.setdefault(w, []).append(k)
    pos, n = grades > 0, len(grades)
    tell = []
    for w, at in seen.items():
        if len(at) >= MIN_ROWS:
            a, b = int(pos[at].sum()), pos.sum() * len(at) / n
            tell.append((-(a - b) ** 2 / b - (a - b) ** 2 / max(len(at) - b, 1e-9), w))
    vocab = sorted(w for _, w in sorted(tell)[:vocabulary])
    col_of = np.concatenate([np.full(len(seen[w]), k) for k, w in enumerate(vocab)]) if vocab else np.zeros(0, int)
    row_of = np.concatenate([np.array(seen[w]) for w in vocab]) if vocab else np.zeros(0, int)
    p = weight / weight.sum()
    share = np.array([(p * (grades > k)).sum() for k in range(top)])
    b = np.log((1 - share) / np.maximum(share, 1e-9))
    theta = np.r_[np.zeros(len(vocab)), b[0], np.log(np.maximum(np.diff(b), 1e-2))]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    for step in range(1, steps + 1):
        w, gaps = theta[:len(vocab)], np.exp(theta[len(vocab) + 1:])
        b = theta[len(vocab)] + np.r_[0, np.cumsum(gaps)]
        s = np.bincount(row_of, weights=w[col_of], minlength=n)
        q = np.c_[np.ones(n), sig(s[:, None] - b), np.zeros(n)]          # P(grade > k), k = -1 .. top - 1, and 0
        i = np.arange(n)
        like = np.maximum(q[i, grades] - q[i, grades + 1], 1e-12)
        d = q * (1 - q)
        ds = (d[i, grades] - d[i, grades + 1]) / like * p                # of the log-likelihood
        db = np.stack([-(d[:, k + 1] * ((grades == k + 1).astype(float) - (grades == k))) / like * p for k in range(top)])
        gb = db.sum(axis=1)
        g = np.r_[np.bincount(col_of, weights=ds[row_of], minlength=len(vocab)) - penalty * w / len(vocab or [1]),
                  gb.sum(), [gaps[k] * gb[k + 1:].sum() for k in range(top - 1)]]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta += 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    b = theta[len(vocab)] + np.r_[0, np.cumsum(np.exp(theta[len(vocab) + 1:]))]
    return OrdinalModel({w: float(x) for w, x in zip(vocab, theta)}, [float(x) for x in b])


def severity_grades(words: list[set[bytes]], toxic: np.ndarray) -> np.ndarray:
    """0 clean, 1 toxic, 2 toxic with more telling words than the median toxic row."""
    seen: dict[bytes, np.ndarray] = {}
    for ws, t in zip(words, toxic):
        for w in ws:
            seen.setdefault(w, np.zeros(2))[int(t)] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()]) + 1.0
    tell = {w for w, c in seen.items() if c.sum() >= MIN_ROWS and np.log((c[1] + 0.5) / n[1]) - np.log((c[0] + 0.5) / n[0]) >= TELLING}
    hits = np.array([len(ws & tell) for ws in words], float)
    middle = np.median(hits[toxic == 1]) if (toxic == 1).any() else 0
    return (toxic * (1 + (hits > middle))).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        sample: int = SAMPLE) -> OrdinalModel:
    """Fitted on at most ``sample`` labelled documents per class (smallest hash of the id first)."""
    known = (labels.select(col(doc_id).alias("d"), (col(toxic) > 0).cast("int").alias("y")).where("d is not null and y is not null")
             .groupBy("d").agg(F.max("y").alias("y")))
    size = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picks = [known.where(F.col("y") == y).orderBy(F.xxhash64("d"), "d").limit(sample) for y in (0, 1)]
    chosen = F.broadcast(picks[0].unionByName(picks[1]))                 # at most 2 * sample ids
    pairs = docs.select(col(doc_id).alias("d"), col(text).cast("string").alias("t")).where("t is not null").join(chosen, "d")

    @F.pandas_udf("binary")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(sorted(word_set(t))) for t in texts])

    rows = sorted(pairs.groupBy("d", "y").agg(F.min("t").alias("t")).select("d", "y", distinct("t").alias("w")).collect())
    words, y = [set(bytes(r.w).split()) for r in rows], np.array([r.y for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return OrdinalModel()
    weight = np.array([size[k] / max(1, (y == k).sum()) for k in y])
    return fit_ordinal(words, severity_grades(words, y), weight)


def score(text: Column, model: OrdinalModel) -> Column:
    """Struct ``severity`` (expected grade), ``p_toxic`` (P(grade > 0)), ``grade`` (most likely) of a text."""
    @F.pandas_udf("severity double, p_toxic double, grade int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        k = len(model.thresholds)
        for texts in batches:
            q = np.array([model.above(t) for t in texts]).reshape(len(texts), k)
            p = -np.diff(np.c_[np.ones(len(q)), q, np.zeros(len(q))], axis=1)
            yield pd.DataFrame({"severity": q.sum(axis=1), "p_toxic": q[:, 0] if k else 0.0, "grade": p.argmax(axis=1).astype("int32")})
    return run(text.cast("string"))


def grade_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
                    reject: float = REJECT) -> DataFrame:
    """``doc_id, severity, p_toxic, grade, toxic`` for every row (extra columns are not read)."""
    model = fit(docs, labels, doc_id, text, toxic)
    got = docs.select(col(doc_id).alias("doc_id"), score(col(text), model).alias("s")).select("doc_id", "s.*")
    return got.withColumn("toxic", F.col("p_toxic") >= reject)
