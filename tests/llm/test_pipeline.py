from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import brute
import corpus_pipeline as P
import pandas as pd
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, n = docs.columns, docs.count()
    for name, step in P.STAGES[:-1]:
        out = step(spark, docs, SF).cache()
        assert out.columns == cols and 0 < out.count() <= n, name
        docs, n = out, out.count()
    last = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    whole = P.run(spark, SF)
    assert whole.columns == last.columns and whole.agg(F.sum("length")).first()[0] == last.agg(F.sum("length")).first()[0]


@pytest.mark.parametrize("name,step", P.STAGES)
def test_nasty_documents(spark, odd_docs, nasty, name, step):
    out = step(spark, odd_docs, SF)
    rows = out.collect()
    assert rows
    if name != "packing":
        assert out.columns == odd_docs.columns and len(rows) <= len(nasty)
    if name in ("toxicity", "decontamination", "pii"):                # no clean document goes
        assert len(rows) == len(nasty) and sum(r.text is None for r in rows) == 2


@pytest.mark.parametrize("name,step", P.STAGES)
def test_empty_documents(spark, empty_docs, name, step):
    assert step(spark, empty_docs, SF).count() == 0


def test_stages_against_brute_force(spark):
    """SimHash and decontamination of the whole small tables against plain Python, each on what the stage before kept."""
    documents = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = list(zip(documents.doc_id.tolist(), documents.text))
    comp = brute.simhash(rows)[2]
    want = sorted(d for (d, _), c in zip(rows, comp) if d == c)
    kept = P.simhash_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == want and kept.columns == docs.columns
    wins, texts = brute.windows(zip(bench.item_id, bench.text)), dict(rows)
    clean = P.decontamination_stage(spark, docs.where(F.col("doc_id").isin(want)), SF)
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [d for d in want if not brute.contamination(texts[d], wins)[4]]


def test_empty_benchmark_and_labels(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert P.decontamination_stage(spark, docs, str(tmp_path)).count() == docs.count()
    assert P.toxicity_stage(spark, docs, str(tmp_path)).count() == docs.count()
