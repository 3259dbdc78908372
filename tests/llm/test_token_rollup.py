import os
import shutil
from collections import Counter

from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import public_tokenizers
import pytest
from ludex.llm import token_rollup as R
from ludex.session import scratch_path
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture()
def store(spark):
    return R.RollupStore(spark, scratch_path(spark, "test-rollup"))


def batch(spark, rows):
    """rows: (change, doc_id, source, lang, n) under version v1, or with a version as sixth item"""
    return spark.createDataFrame([(r[0], r[1], r[5] if len(r) > 5 else "v1", r[2], r[3], r[4], k) for k, r in enumerate(rows)], R._CHANGE)


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_deltas(spark, store):
    assert totals(store) == {} and store.committed() == []
    assert store.commit(0, batch(spark, [("insert", "1", "a", "en", 10), ("insert", "2", "a", "en", 5), ("insert", "3", "b", None, 7),
                                         ("insert", None, None, "en", 2), ("insert", "1", "a", "en", 11), ("insert", "9", "a", "en", None)]))
    assert totals(store) == {("a", "en", "v1"): (3, 16), ("b", None, "v1"): (1, 7), (None, "en", "v1"): (1, 2)}
    assert store.commit(1, batch(spark, [("delete", "2", None, None, 0), ("revise", "1", "c", "fr", 4), ("delete", "77", None, None, 0),
                                         ("delete", None, None, None, 0), ("insert", "3", "b", None, 8), ("insert", "1", "a", "en", 6, "v2")]))
    assert totals(store) == {("a", "en", "v1"): (1, 0), ("b", None, "v1"): (1, 8), ("c", "fr", "v1"): (1, 4), ("a", "en", "v2"): (1, 6)}
    assert store.commit(2, batch(spark, []))
    assert store.commit(3, batch(spark, [("insert", "2", "a", "en", 5)]))
    assert totals(store)[("a", "en", "v1")] == (2, 5) and store.committed() == [0, 1, 2, 3]


def test_commits_are_idempotent(spark, store):
    first = batch(spark, [("insert", "1", "a", "en", 10)])
    assert store.commit(0, first)
    assert not store.commit(0, first) and totals(store) == {("a", "en", "v1"): (1, 10)}
    second = batch(spark, [("revise", "1", "a", "en", 3), ("insert", "2", "a", "en", 1)])
    assert store.commit(1, second)
    shutil.rmtree(store.folder.removeprefix("file:") + "/commits/batch=1")          # as if it had died before its marker
    assert totals(store) == {("a", "en", "v1"): (1, 10)}
    assert store.commit(1, second) and totals(store) == {("a", "en", "v1"): (2, 4)}
    assert os.path.isdir(store.folder.removeprefix("file:") + "/rollup/batch=1")


def brute(rows):
    tok = Tokenizer.from_file(PATH)
    least = {}
    for d, t, *_ in rows:
        if t is not None and d is not None:
            least[t] = min(d, least.get(t, d))
    docs = {}
    for d, t, lang, source, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        docs.setdefault(d, []).append((n, source, lang, t))
    out = Counter(), Counter()
    for d, versions in docs.items():
        if len(versions) > 1 and len({v for v in versions}) > 1:
            continue                                       # an id with several texts: not compared here
        n, source, lang, t = versions[0]
        if d is not None and t is not None and least[t] < d:
            continue
        lines = (t or "").split("\n")
        if len(set(lines)) < len(lines):
            n = len(tok.encode("\n".join(dict.fromkeys(lines)), add_special_tokens=False).ids)
        out[0][(source, lang)] += 1
        out[1][(source, lang)] += n
    return out


def test_corpus_totals(spark, nasty):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    rows += [(10_000, "same line\nsame line\nother", "en", "hot", 1), (10_001, None, None, None, None), (10_002, "", "en", "hot", 0), rows[0]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = R.corpus_totals(df, scratch_path(spark, "test-rollup"), PATH, "v1").collect()
    n, tokens = brute(rows)
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == {k: (n[k], tokens[k]) for k in n}


def test_nasty_and_empty(spark, odd_docs, empty_docs):
    got = R.corpus_totals(odd_docs, scratch_path(spark, "test-rollup"), PATH, "v1")
    assert sum(r.n_docs for r in got.collect()) > 40
    assert R.corpus_totals(empty_docs, scratch_path(spark, "test-rollup"), PATH, "v1").count() == 0


def test_every_row_without_id_counts(spark):
    texts = ["one two three", "one two three", "other words", "same\nsame\nlast", None, None]
    rows = [(None, t, "en", "a") for t in texts] + [(None, "other words", None, "a"), (None, "other words", "a", None), (7, "one two three", "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = R.corpus_totals(df, scratch_path(spark, "test-rollup"), PATH, "v1").collect()
    tok = Tokenizer.from_file(PATH)
    n = {t: len(tok.encode(t, add_special_tokens=False).ids) for t in ("one two three", "other words", "same\nlast")}
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in got} == {
        ("a", "en"): (7, 3 * n["one two three"] + n["other words"] + n["same\nlast"]), ("a", None): (1, n["other words"]), (None, "a"): (1, n["other words"])}
