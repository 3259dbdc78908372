"""Importance resampling against a plain Python twin."""

import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ludex.llm import resample

TARGET = ["w1 w2 w3 w4 w5 w6", None, "", "w7 w7 w7 Æ W1"]


def result(rows):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in rows)


def target(spark, texts=TARGET):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def test_nasty_rows(spark, nasty, docs, odd_docs):
    want = Counter((r[0], *x) for r, x in zip(nasty, brute.resample([r[:2] for r in nasty], TARGET, percent=30)))
    for frame in (docs, odd_docs):
        got = resample.resample(frame, target(spark), percent=30).collect()
        # rows that repeat an id and a text may swap their ranks
        assert Counter({k[:4]: 0 for k in result(got)}) == Counter({k[:4]: 0 for k in want})
        assert sorted(r["rank"] for r in got if r["rank"]) == sorted(k[4] for k in want.elements() if k[4])
        assert {k[3] for k in result(got) if k[4]} == {k[3] for k in want if k[4]}


def test_ties_go_to_the_smaller_id(spark):
    frame = spark.createDataFrame([(i, "w1 " * 30) for i in (9, 3, 5, 5)], "doc_id long, text string")
    got = resample.resample(frame, target(spark), percent=100).collect()
    best = sorted(got, key=lambda r: (-r.score, r.doc_id))
    assert [r["rank"] for r in best] == [1, 2, 3, 4]


def test_empty_tables(spark, empty_docs, docs):
    assert resample.resample(empty_docs, target(spark)).count() == 0
    got = resample.resample(docs, target(spark, [])).agg(F.count("rank"), F.count(F.lit(1))).first()
    assert got[0] > 0 and got[1] == docs.count()


def test_long_texts_in_pieces():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(9, size=n)) + end for n, end in ((500, "."), (0, "§"), (3, ""), (700, " "))]
    texts.append("x" * 900 + " " + "y" * 70 + " z")
    want = Counter(zlib.crc32(g.encode()) % 10_000 for t in texts for g in brute.grams(t)[1])
    old, resample.SLICE = resample.SLICE, 64
    try:
        got, words = Counter(), 0
        for _, part, skip in resample._slices(pa.array(texts), 3):
            n, grams = resample.feature_buckets(part, skip, 10_000)
            words += int((n - skip).sum())
            for _, b in grams:
                got.update(b.tolist())
    finally:
        resample.SLICE = old
    assert got == want and words == sum(brute.grams(t)[0] for t in texts)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=9000))
def test_crc_of_joined_strings(a, b):
    got = resample.crc_joined(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
    assert got[0] == zlib.crc32(a + b)


def test_nth_largest(spark):
    rng = np.random.default_rng(2)
    values = [int(v) for v in np.concatenate([rng.integers(-10 ** 12, 10 ** 12, 300), [5] * 50, rng.integers(-9, 9, 50)])]
    frame = spark.createDataFrame([(v,) for v in values], "v long")
    for n in (1, 2, 57, 200, 399, 400):
        assert resample.nth_largest(frame, "v", n) == sorted(values, reverse=True)[n - 1]
    assert resample.nth_largest(frame, "v", 401) is None and resample.nth_largest(frame, "v", 0) is None
