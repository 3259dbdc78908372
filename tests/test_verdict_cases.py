"""Nulls, hot groups, long chains and late files: cases that clean fixtures do not hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ludex.operators import encode as enc
from ludex.operators import evaluate as ev
from ludex.operators import ordered as od
from ludex.operators import relevance as rel
from ludex.operators.assemble import rank_within_group
from ludex.operators.explore import density_clusters
from ludex.operators.profile import box_stats, cumulative_share, mode_min, value_counts
from ludex.operators.scale import YeoJohnson, zero_variance_columns
from ludex.session import is_local, join_small, path_exists, scratch_path
from ludex.streaming import landing as L

EVENTS = "event_id long, ts timestamp, user_id long, day string"


def events(spark, ids, user=1):
    return spark.createDataFrame([(i, "2024-01-01 00:00:00", user) for i in ids], "event_id long, ts string, user_id long") \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def schema(spark):
    return spark.createDataFrame([], EVENTS).schema


def test_landing_keeps_every_run_and_drops_late_duplicates(spark):
    a, b, out = (scratch_path(spark, x) for x in ("land", "land", "out"))
    ck = scratch_path(spark, "ck")
    L.land_by_day(events(spark, range(10)), "ts", a)
    assert L.ingest_incremental(spark, a, out, ck, schema(spark), key="event_id") == 1
    L.land_by_day(events(spark, range(5, 15)), "ts", a)
    L.ingest_incremental(spark, a, out, ck, schema(spark), key="event_id")
    L.land_by_day(events(spark, range(12, 20)), "ts", b)
    L.ingest_incremental(spark, b, out, scratch_path(spark, "ck"), schema(spark), key="event_id")
    got = sorted(r.event_id for r in L.read_ingested(spark, out, schema(spark)).collect())
    assert got == list(range(20))


def test_landing_of_nothing_and_of_other_columns(spark):
    assert L.read_ingested(spark, scratch_path(spark, "none"), schema(spark)).count() == 0
    snap = scratch_path(spark, "snap")
    rows = spark.createDataFrame([(i, i) for i in range(200)], "k long, o long")
    L.upsert_latest(rows, snap, "k", ["o"], buckets=4)
    with pytest.raises(ValueError, match="columns differ"):
        L.upsert_latest(rows.limit(4).withColumn("extra", F.lit(1)), snap, "k", ["o"], buckets=4)
    assert L.read_snapshot(spark, snap).count() == 200
    L.upsert_latest(spark.createDataFrame([(1, 999), (2, -1), (777, 0)], "k long, o long"), snap, "k", ["o"], buckets=4)
    got = {r.k: r.o for r in L.read_snapshot(spark, snap).collect()}
    assert len(got) == 201 and got[1] == 999 and got[2] == 2


def test_path_exists_asks_the_file_system(spark):
    p = scratch_path(spark, "x")
    assert not path_exists(spark, p)
    spark.range(1).write.parquet(p)
    assert path_exists(spark, p)


def test_chain_of_200_hops_is_one_cluster(spark):
    pts = [(k, float(k), 0.0) for k in range(201)] + [(500 + k, 1000.0 + k, 0.0) for k in range(5)] + [(900, -50.0, 0.0)]
    got = {r.pid: r.cluster for r in density_clusters(spark.createDataFrame(pts, "pid long, x double, y double"), "pid", ["x", "y"], 1.0, 2).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[500 + k] for k in range(5)} == {500} and got[900] == -1


def test_lambda_far_outside_the_first_grid(spark):
    rng = np.random.default_rng(0)
    lam = -9.0
    y = rng.normal(0.085, 0.003, 4000)                                   # normal after the transform
    x = (1 + lam * y) ** (1 / lam) - 1
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = YeoJohnson.fit(df, ["v"]).state["lambdas"][0]
    grid = np.arange(got - 40, got + 40, 0.05)
    ll = YeoJohnson.log_likelihoods(df, {"v": [got, got - 0.01, got + 0.01]})
    assert got < -4.3 and grid.size and ll[("v", got)] >= max(ll.values()) - 1e-9


def test_list_encoding_of_null_entries(spark):
    train = spark.createDataFrame([(["a", "b"],), (["c"],)], "g array<string>")
    e = enc.ListEncoder.fit(train, "g")
    df = spark.createDataFrame([(1, ["a", None, "z"]), (2, None), (3, []), (4, ["c", "a"]), (5, ["c", "a"])], "i long, g array<string>")
    got = {r.i: r.g_encoded_padded for r in e.apply(df).collect()}
    assert e.state["width"] == 2 and got == {1: [1, 4], 2: [0, 0], 3: [0, 0], 4: [3, 1], 5: [3, 1]}
    c = enc.CoverageCap(col="g", coverage=0.8, kept=["a"])
    got = {r.i: r.g for r in c.apply(df).collect()}
    assert got == {1: ["a", "Other"], 2: None, 3: [], 4: ["Other", "a"], 5: ["Other", "a"]}
    lab = enc.LabelEncoder(col="x", labels=["p", "q"])
    assert [r.x_encoded for r in lab.apply(spark.createDataFrame([("q",), (None,), ("zz",)], "x string")).orderBy("x_encoded").collect()] == [1, 2, 2]


@pytest.mark.parametrize("bounded", [True, False])
def test_ranking_keeps_null_keys(spark, bounded):
    df = spark.createDataFrame([(None, 1), (None, 2), (1, 1), (1, 2)], "k long, v long")
    got = sorted(((r.k is None, r.v, r.pos) for r in rank_within_group(df, "k", [F.asc("v")], "pos", bounded).collect()))
    assert got == [(False, 1, 1), (False, 2, 2), (True, 1, 1), (True, 2, 2)]


def test_null_playtime_stays_null(spark):
    rows = [(u, 1, None if u == 3 else float(u), 1) for u in range(8)]
    df = spark.createDataFrame(rows, "user_id long, app_id long, playtime_forever double, achievements long")
    got = {r.user_id: r.relevance_score for r in rel.relevance(df).collect()}
    assert got[3] is None and all(v is not None for u, v in got.items() if u != 3)
    w = {r.user_id: r.playtime_forever for r in rel.winsorize(df, "playtime_forever", "app_id").collect()}
    assert w[3] is None


def test_ranknet_with_null_scores_and_equal_rows(spark):
    rows = [(1, float(i % 5), float(i % 3)) for i in range(50)] + [(1, None, 2.0), (2, 1.0, None), (2, 0.5, 1.0), (2, 0.1, 3.0)] + [(3, 1.0, 1.0)] * 40
    df = spark.createDataFrame(rows, "u long, s double, y double")
    want = {}
    for u in (1, 2, 3):
        r = [(s, y) for a, s, y in rows if a == u and s is not None and y is not None]
        d = [np.log1p(np.exp(-np.sign(a[1] - b[1]) * (a[0] - b[0]))) for i, a in enumerate(r) for b in r[:i] if a[1] != b[1]]
        want[u] = float(np.mean(d)) if d else 0.0
    for block in (1024, 7):
        got = {r.u: (r.n, r.ranknet_loss) for r in ev.ranknet_loss_per_user(df, "u", "s", "y", block).collect()}
        assert {u: n for u, (n, _) in got.items()} == {1: 50, 2: 2, 3: 40}
        assert all(abs(got[u][1] - want[u]) < 1e-9 for u in want)
    spread = ev.pair_blocks(df.filter("u = 3").select("u", "s", "y"), "u", ["s", "y"], 4).filter("same").select(F.size("s_a").alias("n")).collect()
    assert len(spread) > 3                                                # equal rows do not share one block


def test_quantiles_of_one_hot_group_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.exponential(10, 4000), 2)
    rows = [("hot", float(v)) for v in vals] + [("few", 1.0), ("few", 4.0), ("none", None), (None, 2.0), ("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(16)
    qs = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    out = od.exact_quantiles(df, ["v"], qs, ["g"])
    got = {r.g: r.v for r in out.collect()}
    assert np.allclose(got["hot"], np.quantile(vals, qs)) and np.allclose(got["few"], [1.0, 1.15, 1.75, 2.5, 3.85, 4.0])
    assert got["none"] == [None] * 6 and got[None] == [2.0] * 6
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "median" not in plan
    assert od.exact_quantiles(df.filter("v is null"), ["v"], [0.5]).collect()[0].v == [None]
    assert od.exact_quantiles(df.limit(0), ["v"], [0.5]).collect()[0].v == [None]
    two = od.exact_quantiles(df.withColumn("w", -F.col("v")), ["v", "w"], [0.25]).first()
    allv = np.r_[vals, 1.0, 4.0, 2.0]
    assert np.allclose([two.v[0], two.w[0]], [np.quantile(allv, 0.25), np.quantile(-allv, 0.25)])


def test_modes_box_and_shares(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("a", 1), ("b", None), (None, 5)], "g string, v int")
    assert {r.g: r.v_mode for r in mode_min(df, "v", "g").collect()} == {"a": 1, "b": None, None: 5}
    assert mode_min(df, "v").first().v_mode == 1 and mode_min(df.limit(0), "v").first().v_mode is None
    box = box_stats(spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 100]], "v double"), "v").first()
    assert (box.n, box.min, box.max, box.median, box.n_outliers) == (6, 1.0, 100.0, 3.5, 1)
    lab = spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)] * 2, "l string")
    got = {r.l: r.cum_share for r in cumulative_share(value_counts(lab, "l"), "l").collect()}
    assert got == {"x": 0.5, "y": 0.8, "z": 1.0}


def test_zero_variance_and_bool_inference(spark):
    from ludex.functions.clean import infer_bool
    df = spark.createDataFrame([(1, None, 0, 0, 0), (1, None, 1, 1, 0), (None, None, 2, None, 0)], "a int, b int, c int, d int, e int")
    assert zero_variance_columns(df, list("abcde")) == ["a", "b", "e"]
    assert infer_bool(df, list("acde")) == ["d"]


def test_gbt_takes_many_categories(spark):
    from ludex.operators.rank import fit_gbt
    rows = [(f"c{k % 150}", float(k % 150), float(k)) for k in range(600)]
    df = spark.createDataFrame(rows, "c string, y double, x double")
    assert fit_gbt(df, ["x"], "y", max_iter=2, depth=3, categorical=["c"]).transform(df).count() == 600


def test_session_rules(spark):
    assert is_local("local") and is_local("local[8]") and is_local("local[*]") and is_local("local[4,2]")
    assert not is_local("local-cluster[3,2,1000]") and not is_local("spark://h:7077") and not is_local("yarn")
    wide = spark.createDataFrame([(1, "x" * 10)], "k long, s string")
    hint = lambda df: "strategy=broadcast" in df._jdf.queryExecution().logical().toString()
    assert hint(join_small(spark.range(3).withColumnRenamed("id", "k"), wide, "k", known_rows=1000))
    assert not hint(join_small(spark.range(3).withColumnRenamed("id", "k"), wide, "k", known_rows=2_000_000))


def test_factor_inputs_of_the_mlp_are_not_zero(spark, monkeypatch):
    from conftest import SF_SMALL
    from ludex.operators import rank as rk
    from ludex.plans import q_model
    seen = {}
    monkeypatch.setattr(rk, "score_mlp", lambda df, roles, w: seen.update(df=df, roles=roles) or df.withColumn("score", F.lit(0.0)))
    q_model.q_mlp(spark, SF_SMALL).count()
    cf = seen["roles"]["cf"]
    share = seen["df"].agg(*[F.avg((F.col(c) != 0).cast("double")).alias(c) for c in cf]).first()
    assert len(cf) == 128 and min(share) > 0.5
