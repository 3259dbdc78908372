"""Repeated windows of words against brute force."""

import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401

from ludex.llm import common, window_dedup


def got(frame, window=35):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in window_dedup.remove_windows(frame, window=window).collect())


def want(rows, window=35):
    return Counter((r[0], *x) for r, x in zip(rows, brute.windows_removed([r[1] for r in rows], window)))


@pytest.mark.parametrize("window", [35, 1, 2, 3, 7])
def test_nasty_rows(nasty, docs, window):
    assert got(docs, window) == want(nasty, window)


def test_clashing_columns(nasty, odd_docs):
    assert got(odd_docs) == want(nasty)


def test_empty(empty_docs):
    assert not got(empty_docs)


def test_passages_and_hot_keys(spark, monkeypatch):
    """Overlapping shared passages, periodic texts and copies; most keys are hot."""
    monkeypatch.setattr(common, "HOT_SHARE", 4)
    monkeypatch.setattr(window_dedup, "HOT_SHARE", 4)
    rng = random.Random(5)
    source = [f"s{rng.randrange(40)}" for _ in range(400)]
    rows = []
    for k in range(60):
        a = rng.randrange(300)
        body = [f"u{rng.randrange(9999)}" for _ in range(rng.randrange(60))] + source[a:a + rng.randrange(100)] + [f"u{rng.randrange(9999)}"]
        rows.append((k, rng.choice([" ", "\n ", "\t"]).join(body)))
    rows += [(100 + k, "same words again " * 40) for k in range(30)] + [(200, "a b " * 300), (201, "z " * 34), (202, "z " * 36), (203, "a\x0bb\x0cc d\x85 " * 20)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == want(rows)


def test_hashes_across_blocks(monkeypatch):
    texts = ["é" * 50 + " b", "", " x  y ", "longer" * 40 + " q"] * 3
    whole = pa.array(texts)
    offsets = np.frombuffer(whole.buffers()[1], np.int32).astype(np.int64)[:len(texts) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[:offsets[-1]]
    h, text = window_dedup.word_hashes(data, offsets)
    monkeypatch.setattr(window_dedup, "BLOCK", 16)
    h2, text2 = window_dedup.word_hashes(data, offsets)
    words = [w for t in texts for w in t.split()]
    assert (h == h2).all() and (text == text2).all() and len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert all(a == b for x, a in zip(words, h.tolist()) for y, b in zip(words, h.tolist()) if x == y)
