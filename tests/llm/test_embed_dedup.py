import math

import brute
import numpy as np
import pytest
from ludex.llm import embed_dedup as E
from ludex.session import ship_package


def cosines(rows):
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)
    links = []
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if fine(a) and fine(b) and len(a) == len(b):
                x, y = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= 0.9:
                    links.append((i, j))
    root = brute.components(len(rows), links)
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    least = {}
    for r, (v, _) in zip(root, rows):
        if v is not None:
            least[r] = min(v, least.get(r, v))
    return sorted(((v, k, least.get(r), v is not None and v == least.get(r)) for (v, _), k, r in zip(rows, n, root)), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = [(k, rng.standard_normal(16).tolist()) for k in range(60)]
    base = rng.standard_normal((5, 16))
    for k in range(80):
        out.append((100 + k, (base[k % 5] * (1 + k % 3) + 0.03 * rng.standard_normal(16)).tolist()))
    out += [(300 + k, out[0][1]) for k in range(9)]
    out += [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0, None] * 8), (404, [float("nan")] * 16), (405, [float("inf")] * 16),
            (406, [1.0, 2.0]), (407, [2.0, 4.0]), (None, out[0][1]), (None, None), (3, out[4][1]), out[5], out[5], (408, [1e200] * 16), (409, [1e-200] * 16), (410, [-1.0] * 16)]
    return out


@pytest.mark.parametrize("block", [E.BLOCK, 7])
def test_matches_brute_force(spark, rows, block):
    ship_package(spark)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cid int").repartition(3)
    got = [tuple(r) for r in E.near_vectors(df, block=block).collect()]
    assert sorted(got, key=repr) == cosines(rows)


def test_empty(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_settings_reach_the_recall():
    assert E.tables_for(0.9) <= E.TABLES
    rng = np.random.default_rng(1)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((2000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    h = E.Hashes(64, E.TABLES, E.PROJECTIONS, E.WIDTH)
    for cos, least in ((0.9, 0.87), (0.95, 0.995)):
        near = cos * a + math.sqrt(1 - cos * cos) * b
        assert (h.keys(a) == h.keys(near)).any(axis=1).mean() >= least
