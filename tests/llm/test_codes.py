"""Vector codes against exact Python integers."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pytest

from ludex.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(n=150, dim=32, seed=3, spread=1.0):
    rng = random.Random(seed)
    return [(k, [float(np.float32(rng.gauss(0, spread))) for _ in range(dim)], rng.choice([None, 1, 1, 1, 2])) for k in range(n)]


def got(frame, **more):
    rows, books = codes.code_vectors(frame, **more)
    return Counter((r.vec_id, r.label, tuple(r.codes), r.error, r.label_error) for r in rows.collect()), books


@pytest.mark.parametrize("spread", [1.0, 0.01, 90_000.0])
def test_brute_force(spark, spread):
    data = vectors(spread=spread)
    data += [data[3], (None, data[5][1], 9), (200, data[7][1], 2)]                      # a repeated row, a null id, ties
    bad = [(301, None, 1), (302, [], 1), (303, [math.nan] * 32, 1), (304, [math.inf] + [0.0] * 31, 1), (305, [None] + [0.0] * 31, 1),
           (306, [3e6] + [0.0] * 31, 1), (307, [0.5] * 16, None)]
    want, books = brute.vector_codes([(i, lab, v) for i, v, lab in data])
    rows, mine = got(spark.createDataFrame(data + bad, SCHEMA).repartition(3), rounds=2)
    assert rows == Counter(want) and mine.tolist() == books


def test_clashing_columns(spark):
    data = vectors(40)
    frame = spark.createDataFrame(data, SCHEMA)
    odd = frame.selectExpr("*", "'x' as codes", "'x' as error", "'x' as n", "'x' as vector", "'x' as label_error")
    assert got(frame)[0] == got(odd)[0]


def test_few_and_no_rows(spark):
    rows, books = got(spark.createDataFrame(vectors(5), SCHEMA))
    assert books.shape == (16, 5, 2) and {r[3] for r in rows} == {0}
    rows, books = got(spark.createDataFrame([], SCHEMA))
    assert not rows and books.size == 0


def test_uneven_parts(spark):
    with pytest.raises(ValueError):
        codes.code_vectors(spark.createDataFrame(vectors(3, dim=30), SCHEMA))


def test_products_by_limbs():
    rng = np.random.default_rng(4)
    for bits in (5, 20, 27, 29):
        a, b = rng.integers(-1 << bits, 1 << bits, (3, 50, 4)), rng.integers(-1 << bits, 1 << bits, (3, 4, 7))
        want = (a.astype(object)[:, :, None, :] * b.transpose(0, 2, 1).astype(object)[:, None, :, :]).sum(axis=3)
        assert (codes.exact_products(a, b) == want).all()
