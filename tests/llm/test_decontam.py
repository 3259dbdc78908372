import random
from collections import Counter

from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import brute
import numpy as np
import pytest
from ludex.llm import decontam
from pyspark.sql import functions as F


def digest(df):
    return [tuple(r) for r in df.select("doc_id", "c.n_words", "c.n_hit", F.size("c.items").alias("k"),
                                        F.sha2(F.concat_ws(",", "c.items"), 256).alias("s"), "c.contaminated").collect()]


@pytest.fixture(scope="module")
def items(nasty):
    rng = random.Random(5)
    out = [(k, " ".join(t.split()[i:i + 14])) for k, t in enumerate(r[1] for r in nasty if r[1] and len(r[1]) > 200) for i in [rng.randrange(10)]]
    return out + [(900, "W3 w4"), (901, None), (902, ""), (903, "w5"), (904, "w5"), (None, out[0][1]), (905, "w1 w1 w1"), out[1], (906, "--")]


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 500])
def test_matches_brute_force(spark, odd_docs, nasty, items, block):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("c", F.lit(1))
    got = decontam.decontaminate(odd_docs, bench, out="c", block_bytes=block)
    assert got.columns == odd_docs.columns + ["c"]
    wins = brute.windows(items)
    assert Counter(digest(got)) == Counter((r[0], *brute.contamination(r[1], wins)) for r in nasty)


def test_empty_tables(spark, docs, empty_docs, items):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(r[2:4] == (0, 0) and not r[5] for r in digest(decontam.decontaminate(docs, none, out="c")))
    assert decontam.decontaminate(empty_docs, spark.createDataFrame(items, "item_id long, text string"), out="c").count() == 0


def test_prefix_is_the_rarest_shingle():
    index = decontam.Index([("1", "a b c d e f g h i j")], 10, 3)
    third = decontam._codes(next(iter(index.by_len.values()))[0][0], 3)[3]
    counts = np.full(8, 9)
    counts[list(index.codes[3]).index(third)] = 0
    index.choose_prefixes({3: counts})
    assert index.prefix[10][0][0] == third and index.prefix[10][3][0] == 3


def test_more_words_than_fit_an_exact_code():
    """One item of 2.2 million different words: every window of it is found, from its first to its last words."""
    words = [f"{k:x}" for k in range(2_200_000)]
    index = decontam.Index([("1", " ".join(words))], 10, 3)
    index.choose_prefixes({3: np.zeros(len(index.codes[3]), np.int64)})
    for first in (0, 1_900_000, 2_000_000, 2_100_000, 2_199_980):
        (_, ids, bounds), = decontam._chunks([" ".join(words[first:first + 20])], index)
        assert sorted(decontam._hits(ids, bounds, index)[0].tolist()) == list(range(11))
