import random

import pytest
from pyspark.sql import types as T

from ludex.session import ship_package

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" + rng.choice(["", ",", ".", "é"]) for _ in range(n))


def nasty_rows(seed: int = 0) -> list[tuple]:
    """Documents with nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(seed)
    rows = [(k, prose(rng, rng.choice([1, 2, 3, 9, 30, 80])), rng.choice(["en", "fr"]), rng.choice(["a", "a", "b"]), 1) for k in range(40)]
    passage = prose(rng, 25)
    rows += [(100 + k, prose(rng, 20) + " " + passage + " " + prose(rng, 15), "en", "a", 1) for k in range(5)]
    body = prose(rng, 300)
    rows += [(200 + k, body, "en", "hot", 1) for k in range(6)]                                  # copies
    rows += [(300 + k, body.replace("w7", f"x{k}", 1), "en", "hot", 1) for k in range(6)]        # near copies
    rows += [(400, None, "en", "a", None), (401, "", None, None, 0), (402, " \t\n", "fr", "b", 3), (403, None, None, "a", None),
             (None, prose(rng, 30), "en", "a", 1), (None, body, "en", None, 1), (404, "12 34 $$", "en", "a", 5),
             (405, prose(rng, 9000, 60), "en", "a", 1), (406, "a" * 3000, "en", "a", 1)]
    rows += [rows[3], rows[41], rows[41]]                                                         # repeated rows
    rows += [(5, prose(rng, 40), "en", "b", 1)]                                                   # an id with another text
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    ship_package(spark)
    return nasty_rows()


@pytest.fixture(scope="session")
def docs(spark, nasty):
    return spark.createDataFrame(nasty, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """Extra columns with names that the operators use inside."""
    from pyspark.sql import functions as F
    out = docs
    for c in ("fp", "key", "row", "queue", "part", "score", "base", "probe0", "row_key", "contamination_", "n", "t"):
        out = out.withColumn(c, F.lit("x"))
    return out
