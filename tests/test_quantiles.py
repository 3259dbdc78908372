"""Exact quantiles: both plans against numpy, hot groups, odd values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludex.operators import ordered

QS = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]


def table():
    rng = np.random.default_rng(0)
    odd = [lambda: rng.normal(), lambda: float(rng.integers(5)), lambda: 10 ** rng.normal() * 100, lambda: -0.0, lambda: 0.0,
           lambda: 1e300, lambda: -5e-324]
    rows = [(g or None, float(odd[rng.integers(len(odd))]()), None if rng.random() < 0.3 else float(rng.normal()))
            for g in range(30) for _ in range(rng.integers(40))]
    rows += [(99, None, None), (97, -1e9, 1.0)] + [(97, 1e9 + k * 1e-6, float(k)) for k in range(3000)]     # close values and one far off
    rows += [(96, 2.0 ** k, -(2.0 ** k)) for k in range(-300, 300)]
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(table(), "g int, x double, y double").repartition(5).cache()


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-12))


@pytest.mark.parametrize("bounded", [True, False])
@pytest.mark.parametrize("digits", [4096, 7])
def test_against_numpy(frame, bounded, digits, monkeypatch):
    monkeypatch.setattr(ordered, "DIGITS", digits)
    got = {r.g: (r.x, r.y) for r in ordered.exact_quantiles(frame, ["x", "y"], QS, ["g"], bounded=bounded).collect()}
    rows = table()
    assert set(got) == {r[0] for r in rows}
    for g in got:
        for c in (0, 1):
            v = [r[1 + c] for r in rows if r[0] == g and r[1 + c] is not None]
            want = [float(q) for q in np.quantile(v, QS)] if v else [None] * len(QS)
            assert all(map(close, got[g][c], want)), (g, c)


@pytest.mark.parametrize("bounded", [True, False])
def test_ungrouped_and_empty(frame, bounded):
    q = lambda df, by=None: ordered.exact_quantiles(df, ["x"], [0.5], by, bounded=bounded).collect()
    assert q(frame)[0].x[0] == np.median([r[1] for r in table() if r[1] is not None])
    assert [r.x for r in q(frame.limit(0))] == [[None]] and q(frame.limit(0), ["g"]) == []


def test_one_hot_group_by_radix_selection(spark):
    """A group of all rows: no task puts more than the values of a few digits in order."""
    df = spark.range(300_000).select(F.lit(1).alias("g"), (F.sin("id") * 1e6).alias("x"))
    q = ordered.exact_quantiles(df, ["x"], [0.05, 0.5, 0.95], ["g"], bounded=False)
    want = df.agg(F.percentile("x", [0.05, 0.5, 0.95]).alias("x")).first().x
    assert all(map(close, q.first().x, want))
    assert "Sort" in q._jdf.queryExecution().toString()
    heads = ordered._long(df, ["x"], ["g"]).crossJoin(df.agg(F.min("x").alias("a"), F.max("x").alias("b"))).groupBy(
        ordered._digit(F.col("_v"), F.col("a"), F.col("b")).alias("d")).count()
    assert heads.agg(F.max("count")).first()[0] < 300_000 / 100


def test_infinite_values(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf,), (1.0,), (-inf,), (2.0,), (3.0,)], "x double")
    for bounded in (True, False):
        assert ordered.exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0], bounded=bounded).first().x == [-inf, 1.0, 2.0, inf]


def test_broadcast_sizes_are_measured(spark):
    from ludex.session import _table_bytes
    long = spark.createDataFrame([(k, "x" * 10_000, [1.0] * 100) for k in range(20)], "k long, s string, a array<double>")
    assert _table_bytes(long, 20) > 200_000 and _table_bytes(long.select("k"), 20) == 20 * 24
    assert _table_bytes(long.limit(0), 0) == 0


def test_shares_by_either_plan(spark, monkeypatch):
    from ludex.operators import profile
    counts = spark.createDataFrame([(f"l{k}", (k * 7) % 5 + 1) for k in range(40)], "label string, n long")
    got = lambda: {r.label: r.cum_share for r in profile.cumulative_share(counts, "label").collect()}
    few = got()
    monkeypatch.setattr(profile, "GROUP_ROWS", 10)
    assert got() == few and max(few.values()) == 1.0
