"""The corpus pipeline: five stages over ``documents``, each one operator of ``ludex.llm``.

Every stage function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its
result is written as parquet and reread as the next stage's ``docs``.  All but
the last return the columns of ``documents`` (further columns ride along).

1. toxicity: documents graded as toxic by the ordinal model go.
2. simhash: of each group of linked fingerprints (3-word shingles, 3 bits) the
   row with the smallest doc_id stays (equal or null ids: the smallest text).
3. decontamination: documents that hold a benchmark window go.
4. pii: selected spans are replaced by ``[KIND]``; ``n_chars`` is the new length.
5. packing: the rest is packed into windows of 4,096 tokens.

Null texts pass stages 1, 3 and 4 as they are; in stage 2 they form one group
with all texts without words.  Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.llm import decontam, packing, pii, simhash, toxicity
from ludex.llm.common import fresh, stage
from ludex.llm.queries import TOKENIZER
from ludex.session import ship_package


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (s,) = fresh(docs, "score")
    graded = docs.withColumn(s, toxicity.score(F.col("text"), model))
    return graded.where(F.col(s)["p_toxic"] < toxicity.REJECT).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    (c,) = fresh(docs, "contamination")
    marked = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=c)
    return marked.where(~F.col(c)["contaminated"]).select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

# Model fits, XXH64 fingerprints and tokenizers are beyond SQL; tests/llm holds brute-force twins of SimHash, decontamination (both on what the
# stage before kept), personal data and packing, and held-out accuracy for the toxicity model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
