"""Registered queries of the corpus operators: one per operator, over its whole table."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.llm import (codes, decontam, embed_dedup, langid, oracle, packing, pii, resample, simhash, suffix_dedup, token_rollup, toxicity, warc,
                       window_dedup)
from ludex.session import scratch_path, ship_package

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def register(name: str, sql: str | None = None):
    def deco(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op2_language_id")
def op2(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@register("op3_simhash")
def op3(spark, sf_dir):
    got = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op5_toxicity")
def op5(spark, sf_dir):
    return toxicity.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op8_decontamination")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "contamination.n_words", "contamination.n_hit",
                      F.size("contamination.items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "contamination.items"), 256).alias("items_sha256"),
                      "contamination.contaminated")


@register("op10_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@register("op6_pii")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = pii.detect(docs)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    return got.select("doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                      pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


@register("op1_warc")
def op1(spark, sf_dir):
    got = warc.read_archive(warc.write_archive(table(spark, sf_dir, "pages")))
    return got.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                      F.col("refers_to").cast("long").alias("refers_to"))


@register("op4_token_counts")
def op4(spark, sf_dir):
    return token_rollup.corpus_totals(table(spark, sf_dir, "documents"), scratch_path(spark, "token-rollup"),
                                      public_tokenizers.path(TOKENIZER), TOKENIZER.partition(".")[0])


@register("op9_embedding_dedup")
def op9(spark, sf_dir):
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@register("op7_suffix_dedup")
def op7(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op11_importance_resampling", oracle.OP11)
def op11(spark, sf_dir):
    got = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


@register("op12_vector_codes", oracle.OP12)
def op12(spark, sf_dir):
    got, books = codes.code_vectors(table(spark, sf_dir, "embeddings"))
    listed = ",".join(map(str, books.ravel().tolist()))
    pairs = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    return got.select("vec_id", F.concat_ws("", pairs).alias("code"), "error", "label_error",
                      F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))


@register("op13_substring_dedup", oracle.OP13)
def op13(spark, sf_dir):
    got = window_dedup.remove_windows(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
