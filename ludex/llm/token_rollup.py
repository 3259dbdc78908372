"""Token counts as delta-maintained rollups.

A store (a folder that all tasks share) holds three things per batch: ``ledger``
(signed rows per document and tokenizer version), ``rollup`` (their sums by
source, language and version) and a ``commits`` marker, written last.  A batch
is a set of changes: ``insert``, ``delete`` or ``revise``.  Against the net ledger
of the batches committed before it, each change becomes signed rows: minus the
document's present counts, plus the new ones.  Totals are sums over the
rollups of committed batches, so a batch adds what it changes; of old rows it
reads the ledgers, to find the present counts of changed documents.

Commits are idempotent: a committed batch id is skipped; a batch that died
before its marker is written over by its next attempt; uncommitted folders are
never read.

An insert of a known document revises it, a revision of an unknown one inserts
it, its deletion changes nothing.  Several changes of one key in a batch count
as the last: highest ``seq``, then the most tokens.  To the store, null ids,
sources and languages are keys of their own; ``corpus_totals`` gives every row
without an id its own key.  Null texts have no tokens.  A hot source is
summed in its tasks first.  Extra columns are ignored; empty batches commit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.llm.common import col, join_hot
from ludex.llm.packing import chunks
from ludex.llm.packing import tokenizer as load

_CHANGE = "change string, doc_id string, tokenizer string, source string, lang string, n_tokens long, seq long"
_LEDGER = "doc_id string, tokenizer string, source string, lang string, n_docs long, n_tokens long"
_ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(text: Column, tokenizer_path: str) -> Column:
    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tok = load(tokenizer_path)
        for texts in batches:
            texts = texts.tolist()
            yield pd.Series(np.concatenate([np.zeros(0, np.int64), *(tok.sizes(texts[a:b]) for a, b in chunks(texts))]), dtype="int64")
    return run(text.cast("string"))


def changes(rows: DataFrame, change: str, tokenizer: str, doc_id: str = "doc_id", source: str = "source", lang: str = "lang",
            n_tokens: str = "n_tokens") -> DataFrame:
    """``rows`` as changes of one kind under one tokenizer version."""
    return rows.select(F.lit(change).alias("change"), col(doc_id).cast("string").alias("doc_id"), F.lit(tokenizer).alias("tokenizer"),
                       col(source).cast("string").alias("source"), col(lang).cast("string").alias("lang"),
                       col(n_tokens).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("seq"))


class RollupStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> list[int]:
        """Batch ids with a finished marker."""
        fs, p = self._fs(f"{self.folder}/commits")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.partition("=")[2]) for n in names
                      if n.startswith("batch=") and self._done(f"{self.folder}/commits/{n}"))

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _read(self, what: str, schema: str, batches: list[int]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{what}/batch={b}" for b in batches))

    def _net(self, batches: list[int]) -> DataFrame:
        """Present counts per document and version."""
        return (self._read("ledger", _LEDGER, batches).groupBy("doc_id", "tokenizer", "source", "lang")
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0"))

    def commit(self, batch: int, rows: DataFrame) -> bool:
        """Apply the changes as batch ``batch``; False if it was committed before."""
        known = self.committed()
        if batch in known:
            return False
        order = F.struct("seq", "n_tokens", "change", "source", "lang")
        last = (rows.groupBy("doc_id", "tokenizer").agg(F.max(order).alias("x"))
                .select("doc_id", "tokenizer", "x.change", "x.source", "x.lang", "x.n_tokens"))
        new = last.where("change <> 'delete'").select("doc_id", "tokenizer", "source", "lang", F.lit(1).cast("long").alias("n_docs"),
                                                      F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
        if known:
            net, mine = self._net(known).alias("o"), last.select("doc_id", "tokenizer").alias("c")
            same = F.col("o.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("o.tokenizer") == F.col("c.tokenizer"))
            old = net.join(mine, same, "left_semi").select("doc_id", "tokenizer", "source", "lang",
                                                           (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
            new = new.unionByName(old)
        new.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        sums = (self._read("ledger", _LEDGER, [batch]).groupBy("source", "lang", "tokenizer")
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
        sums.write.mode("overwrite").parquet(f"{self.folder}/rollup/batch={batch}")
        self.spark.range(batch, batch + 1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` over all committed batches."""
        return (self._read("rollup", _ROLLUP, self.committed()).groupBy("source", "lang", "tokenizer")
                .agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0"))


def keyed(docs: DataFrame) -> DataFrame:
    """``documents`` with a string ``key``: the id, or for each row without one its content and a running number among
    equal rows (which are alike, so the same keys come out of every evaluation)."""
    there = docs.where("doc_id is not null").select(F.col("doc_id").cast("string").alias("key"), "doc_id", "text", "source", "lang")
    none = docs.where("doc_id is null").groupBy("text", "source", "lang").agg(F.count("*").alias("n"))
    content = F.sha2(F.to_json(F.struct("text", "source", "lang")), 256)
    none = none.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("k"))
    return there.unionByName(none.select(F.concat_ws(":", F.lit("null"), content, "k").alias("key"),
                                         F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "source", "lang"))


def corpus_totals(docs: DataFrame, folder: str, tokenizer_path: str, tokenizer: str) -> DataFrame:
    """Totals of ``documents`` after three batches: all rows are inserted; exact copies (a text that a smaller
    id has too) are deleted; documents with repeated lines are revised to the count without the repeats."""
    spark = docs.sparkSession
    store = RollupStore(spark, folder)
    every = keyed(docs)
    store.commit(0, changes(every.withColumn("n_tokens", count_tokens(F.col("text"), tokenizer_path)), "insert", tokenizer, doc_id="key"))
    rows = docs.select("doc_id", "source", "lang", F.sha2("text", 256).alias("sha"))
    first = rows.where("sha is not null").groupBy("sha").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = join_hot(rows, first, ["sha"], "n", rows.count()).where("doc_id > first").withColumn("n_tokens", F.lit(0))
    store.commit(1, changes(copies, "delete", tokenizer))
    lines = F.split("text", "\n", -1)
    thin = every.where(F.size(lines) > F.size(F.array_distinct(lines))).withColumn("thin", F.concat_ws("\n", F.array_distinct(lines)))
    gone = copies.select(F.col("doc_id").alias("gone")).distinct()
    thin = thin.join(gone, F.col("doc_id") == F.col("gone"), "left_anti")
    store.commit(2, changes(thin.withColumn("n_tokens", count_tokens(F.col("thin"), tokenizer_path)), "revise", tokenizer, doc_id="key"))
    return store.totals()
