"""The registered queries over whole small tables against brute force."""

import base64
import hashlib
import zlib
from collections import Counter

import __spark_entry__ as entry
import brute
import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ludex.llm.queries import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")


def run(spark, name):
    (f,) = [f for k, f in entry.queries().items() if k == name]
    return f(spark, SF).toPandas()


def test_registered():
    names = [k for k in entry.queries() if k.startswith("op")]
    assert sorted(int(k[2:].split("_")[0]) for k in names) == list(range(1, 14)) and "pipeline" in entry.queries()


def test_op1(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = run(spark, "op1_warc")
    want = Counter((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()) for p, h in zip(pages.page_id, pages.html.fillna("")))
    assert Counter(zip(got.page_id, got.payload_bytes, got.payload_digest)) == want


def test_op3(spark, documents):
    got = run(spark, "op3_simhash").sort_values("doc_id")
    fps, _, comp = brute.simhash(list(zip(documents.doc_id, documents.text)))
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps] and got.component_id.tolist() == comp


def test_op6(spark, documents):
    got = run(spark, "op6_pii").sort_values("doc_id")
    for r, t in zip(got.itertuples(), documents.text):
        base = brute.pii(t)
        n = Counter(k for k, _, _ in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in ("email", "ip", "card", "phone"))
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert not Counter(listed) - Counter(r.spans.split(","))


def test_op7(spark, documents):
    got = run(spark, "op7_suffix_dedup").sort_values("doc_id")
    want = brute.repeats(list(zip(documents.doc_id, documents.text)))
    assert list(zip(got.n_bytes, got.n_removed, got.n_spans, got.kept_sha256)) == want


def test_op8(spark, documents):
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    wins = brute.windows(zip(bench.item_id, bench.text))
    got = run(spark, "op8_decontamination").sort_values("doc_id")
    assert list(zip(got.n_words, got.n_hit, got.n_items, got.items_sha256, got.contaminated)) == [brute.contamination(t, wins) for t in documents.text]


def test_op9(spark):
    table = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    v = np.stack(table.embedding).astype(float)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(axis=1) - 1
    got = run(spark, "op9_embedding_dedup").sort_values("vec_id")
    assert (got.n_links <= near).all() and got.n_links.sum() >= 0.9 * near.sum() and (got.kept == (got.vec_id == got.component_id)).all()


def test_op10(spark, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for d, t in zip(documents.doc_id, documents.text)}
    got = run(spark, "op10_packing").sort_values(["doc_id", "start"])
    assert got.doc_tokens.tolist() == [len(ids[d]) for d in got.doc_id]
    assert got.ids_crc32.tolist() == [zlib.crc32(ids[d][s:s + n].tobytes()) for d, s, n in zip(got.doc_id, got.start, got.length)]
    assert got.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in ids.items()}
    seq = got.sort_values(["sequence_id", "offset"])
    assert (seq.offset == seq.groupby("sequence_id").length.cumsum() - seq.length).all()
    full = seq.groupby("sequence_id").length.sum()
    assert (full.iloc[:-1] == 4096).all() and full.iloc[-1] <= 4096


@pytest.mark.parametrize("name", [k for k in ORACLE if k.startswith("op")])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = run(spark, name), con.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    as_rows = lambda f: Counter(f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None))
    assert as_rows(got) == as_rows(want) and len(got)


@pytest.mark.parametrize("name", ["op2_language_id", "op4_token_counts", "op5_toxicity"])
def test_whole_tables(spark, documents, name):
    got = run(spark, name)
    assert (got.n_docs.sum() if "n_docs" in got else got.doc_id.nunique()) >= 0.9 * len(documents)
