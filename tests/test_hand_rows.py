"""Hand-computed rows (FIXTURES section 4) for the unit-checked operators."""

import math

import pytest
from pyspark.sql import functions as F

from ludex.functions import clean as cl
from ludex.operators import encode as enc
from ludex.operators import evaluate as ev
from ludex.operators import profile as pf
from ludex.operators import relevance as rel


def _rel(spark, playtimes):
    df = spark.createDataFrame([(i, 1, float(p), None) for i, p in enumerate(playtimes)],
                               "user_id long, app_id long, playtime_forever double, achievements long")
    return [r["relevance_score"] for r in rel.relevance(df).orderBy("user_id").collect()]


def test_relevance_five_users_playtime_branch(spark):
    s = _rel(spark, [0, 10, 100, 1000, 10000])
    assert s[0] == 0.0
    assert s[-1] == pytest.approx(1.0, abs=1e-5)
    assert all(0.0 <= x <= 1.0 for x in s) and s == sorted(s)


def test_relevance_four_users_all_zero(spark):
    assert _rel(spark, [0, 10, 100, 1000]) == [0.0] * 4


def test_relevance_constant_playtime_zero(spark):
    assert _rel(spark, [7] * 5) == [0.0] * 5


def test_relevance_blend_with_achievements(spark):
    rows = [(i, 1, float(p), a) for i, (p, a) in enumerate([(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)])]
    df = spark.createDataFrame(rows, "user_id long, app_id long, playtime_forever double, achievements long")
    out = rel.relevance(df, keep_parts=True).orderBy("user_id").collect()
    for r in out:
        assert r["relevance_score"] == pytest.approx(0.7 * r["minmax_playtime"] + 0.3 * r["minmax_achievements"])


def test_parse_range(spark):
    lo, hi = cl.parse_range(F.lit("20,000 .. 50,000"))
    r = spark.range(1).select(lo.alias("a"), hi.alias("b")).first()
    assert (r["a"], r["b"]) == (20000, 50000)


def test_company_names(spark):
    r = spark.range(1).select(cl.normalize_names(F.lit("Foo, Inc., Bar LLC,  ")).alias("x"),
                              cl.normalize_names(F.lit("Princess Games")).alias("y"),
                              cl.normalize_names(F.lit("Princess Games"), whole_word=True).alias("z")).first()
    assert r["x"] == ["foo", "bar"]
    assert r["y"] == ["press games"]   # str.replace("inc", "") on "princess"
    assert r["z"] == ["princess games"]


def test_ratings_pivot_defaults(spark):
    df = spark.createDataFrame([([(5, 50.0), (4, 30.0)],)], "r array<struct<id:int, percent:double>>")
    r = df.select(*cl.pivot_array("r", "id", "percent", cl.RATING_KEYS)).first()
    assert list(r) == [50.0, 30.0, 0.0, 0.0]


def test_coordinates_fallback(spark):
    countries = spark.createDataFrame([("A", "1,1")], "country string, coordinates string")
    states = spark.createDataFrame([("A", "s1", "2,2")], "country string, state string, coordinates string")
    cities = spark.createDataFrame([("A", "s1", "c1", "3,3")],
                                   "country string, state string, city string, coordinates string")
    users = spark.createDataFrame([(1, "A", "s1", "cX"), (2, "A", "sX", "c1"), (3, None, "s1", "c1"),
                                   (4, "A", "s1", "c1")], "id int, country string, state string, city string")
    got = {r["id"]: r["coordinates"] for r in cl.lookup_coordinates(users, countries, states, cities).collect()}
    assert got == {1: "2,2", 2: "1,1", 3: None, 4: "3,3"}


def test_split_coordinates(spark):
    df = spark.createDataFrame([("1.5,2.5",), ("1.5",), ("a,b",), (None,)], "c string")
    lat, lon = cl.split_coordinates("c")
    assert [tuple(r) for r in df.select(lat, lon).collect()] == [(1.5, 2.5), (None, None), (None, None), (None, None)]


def test_discount_half_even(spark):
    df = spark.createDataFrame([(10.0, 5.0), (10.0, 4.0), (10.0, 0.0), (0.0, 0.0)], "i double, c double")
    assert [r[0] for r in df.select(cl.discount("i", "c")).collect()] == [0.0, 1.0, 1.0, 0.0]


def test_bins_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.2000001,), (1.0,), (1.1,)], "x double")
    assert [r[0] for r in df.select(cl.cut("x")).collect()] == ["None", "very low", "low", "very high", None]


def test_coverage_cut(spark):
    rows = [(["a"],)] * 50 + [(["b"],)] * 30 + [(["c"],)] * 15 + [(["d"],)] * 5
    df = spark.createDataFrame(rows, "l array<string>")
    cap = enc.CoverageCap.fit(df, "l", 0.8)
    assert cap.state["kept"] == ["a"]
    out = cap.apply(spark.createDataFrame([(["a", "c", "d"],)], "l array<string>")).first()[0]
    assert out == ["a", "Other"]


def test_multilabel_unknown(spark):
    train = spark.createDataFrame([(["a"],), (["b"],)], "g array<string>")
    ml = enc.MultiLabel.fit(train, "g", "g")
    r = ml.apply(spark.createDataFrame([(["a", "x", "y"],)], "g array<string>")).first().asDict()
    assert r == {"g_Unknown": 1, "g_a": 1, "g_b": 0}


def test_list_padding(spark):
    train = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "g array<string>")
    le = enc.ListEncoder.fit(train, "g")
    out = le.apply(spark.createDataFrame([([],), (["c", "z"],)], "g array<string>")).collect()
    assert out[0]["g_encoded_padded"] == [0, 0, 0]
    assert out[1]["g_encoded_padded"] == [3, 4, 0]


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (1,)], "x int")
    assert pf.mode_min(df, "x").first()[0] == 1


def test_skew_bias_corrected(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    g1 = pf.skew_table(df, ["x"]).first()["skewness"]
    assert g1 == pytest.approx(1.018234 * math.sqrt(12) / 2, rel=1e-5)


def _ndcg(spark, truth, score):
    df = spark.createDataFrame([(1, float(t), float(s)) for t, s in zip(truth, score)], "u long, y double, s double")
    return ev.ndcg(df, "u", "y", "s").first()["mean_ndcg"]


def test_ndcg_perfect_reversed_tied(spark):
    assert _ndcg(spark, [3, 2, 1], [3, 2, 1]) == pytest.approx(1.0)
    assert _ndcg(spark, [3, 2, 1], [1, 2, 3]) == pytest.approx(0.789998, abs=1e-6)
    assert _ndcg(spark, [3, 2, 1], [0, 0, 0]) == pytest.approx(0.894999, abs=1e-6)


def test_ranknet_constant_score_ln2(spark):
    df = spark.createDataFrame([(1, i, float(i % 3), 0.5) for i in range(10)], "u long, k long, y double, s double")
    assert ev.ranknet_loss(df, "u", "s", "y", key="k").first()["ranknet_loss"] == pytest.approx(math.log(2))


def test_anti_join_null_key(spark):
    from ludex.operators.assemble import anti
    games = spark.createDataFrame([(1,), (2,), (3,)], "app_id long")
    seen = spark.createDataFrame([(1,), (None,)], "app_id long")
    assert sorted(r[0] for r in anti(games, seen, "app_id").collect()) == [2, 3]


def test_flatten_users(spark):
    df = spark.createDataFrame([(1, [(10, 5), (11, None)]), (2, [])],
                               "user_id long, owned_games array<struct<appid:long, playtime_forever:long>>")
    out = sorted(tuple(r) for r in cl.flatten_users(df, "user_id", "owned_games").collect())
    assert out == [(1, 10, 5), (1, 11, 0)]


def test_align_and_harmonize(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("flag", T.BooleanType()),
                           T.StructField("b", T.DoubleType())])
    df = spark.createDataFrame([(1.5, 2, "x")], "b double, a int, extra string")
    out = enc.align(df, schema)
    assert out.columns == ["a", "flag", "b"] and tuple(out.first()) == (2, False, 1.5)
    h = cl.harmonize(spark.createDataFrame([(1, 2.0)], "a int, b float"))
    assert [f.dataType.simpleString() for f in h.schema.fields] == ["bigint", "double"]


def test_fitted_roundtrip(spark, tmpdir_path):
    train = spark.createDataFrame([("x",), ("y",)], "c string")
    oh = enc.OneHot.fit(train, "c")
    oh.save(spark, tmpdir_path + "/oh")
    back = enc.OneHot.load(spark, tmpdir_path + "/oh")
    assert back.state == oh.state


def test_group_median_fill_roundtrip(spark, tmpdir_path):
    from ludex.operators.impute import GroupMedianFill
    train = spark.createDataFrame([("A", 1.0), ("A", 3.0), ("B", 10.0), ("B", None), (None, 7.0)], "c string, x double")
    f = GroupMedianFill.fit(train, ["x"], "c")
    f.save(spark, tmpdir_path + "/gm")
    back = GroupMedianFill.load(spark, tmpdir_path + "/gm")
    test = spark.createDataFrame([("A", None), ("B", None), ("Z", None), ("A", 5.0)], "c string, x double")
    got = [r["x"] for r in back.apply(test).orderBy("c", "x").collect()]
    assert sorted(got) == sorted([2.0, 10.0, 5.0, 5.0])


def test_profile_links(spark):
    from ludex.sources.ingest import extract_profile_links
    html = ('<a href="https://community.example.com/id/gamer_1/">x</a> <a href="https://community.example.com/profiles/'
            '76561198000000001">y</a> <a href="https://community.example.com/profiles/123">bad</a> '
            '<a href="https://community.example.com/id/gamer_1/">dup</a>')
    pages = spark.createDataFrame([(html,), (html,)], "html string")
    got = sorted((r["kind"], r["profile"]) for r in extract_profile_links(pages, "community.example.com").collect())
    assert got == [("id", "gamer_1"), ("profiles", "76561198000000001")]
