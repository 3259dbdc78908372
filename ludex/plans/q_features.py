"""Registered queries: encoders (C*), imputers (I*), scalers (N*), profiles (A1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ludex.operators import encode as enc
from ludex.operators import impute as imp
from ludex.operators import profile as pf
from ludex.operators import scale as sc
from ludex.plans import fixtures as fx
from ludex.plans.registry import register, round_doubles

I, G, U = fx.INTERACTIONS_SQL, fx.GAMES_SQL, fx.USERS_SQL
M = fx.TRAIN_MOD
HOLD = fx.HELD_OUT_BRAND
UNSEEN_WORD = "gizmo"   # fixture: games named with this word are kept out of train


def _games_split(spark, d):
    g = fx.games(spark, d)
    train = g.filter((F.col("app_id") % M != 0) & (F.col("game_brand") != HOLD)
                     & ~F.array_contains("game_genres", UNSEEN_WORD))
    test = g.filter(F.col("app_id") % M == 0)
    return train, test


TRAIN_G = f"SELECT * FROM g WHERE app_id % {M} <> 0 AND game_brand <> '{HOLD}' AND NOT list_contains(game_genres, '{UNSEEN_WORD}')"
TEST_G = f"SELECT * FROM g WHERE app_id % {M} = 0"
SPLIT_CTE = fx.cte(g=G, tr=TRAIN_G, te=TEST_G)


def _long(df, key, prefix):
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.select(key, *[F.col(c).cast("int").alias(c) for c in cols]).unpivot(key, cols, "column_name", "value")


# ------------------------------------------------------------------ C1
@register("onehot_brand_unknown", "C1", SPLIT_CTE + """,
cats AS (SELECT DISTINCT game_brand AS c FROM tr UNION SELECT 'Unknown'),
v AS (SELECT app_id, CASE WHEN game_brand IN (SELECT game_brand FROM tr) THEN game_brand ELSE 'Unknown' END AS v FROM te)
SELECT app_id, 'game_brand_' || c AS column_name, CAST(v = c AS INTEGER) AS value FROM v, cats""")
def q_onehot(spark, d):
    train, test = _games_split(spark, d)
    oh = enc.OneHot.fit(train, "game_brand")
    return _long(oh.apply(test.select("app_id", "game_brand")), "app_id", "game_brand_")


# ------------------------------------------------------------------ C2 C7
MULTI_SQL = SPLIT_CTE + """,
known AS (SELECT DISTINCT unnest(game_genres) AS c FROM tr),
classes AS (SELECT c FROM known UNION SELECT 'Unknown')
SELECT te.app_id, 'game_genres_' || c AS column_name,
  CAST(CASE WHEN c = 'Unknown' THEN len(list_filter(te.game_genres, lambda x: NOT list_contains(k.kl, x))) > 0
            ELSE list_contains(te.game_genres, c) END AS INTEGER) AS value
FROM te, classes, (SELECT list(c) AS kl FROM known) k"""


@register("multilabel_genres_unknown", "C2", MULTI_SQL)
def q_multilabel(spark, d):
    train, test = _games_split(spark, d)
    ml = enc.MultiLabel.fit(train, "game_genres", "game_genres", unknown=True)
    return _long(ml.apply(test.select("app_id", "game_genres")), "app_id", "game_genres_")


@register("multilabel_genres_ignore_unseen", "C7", SPLIT_CTE + """,
known AS (SELECT DISTINCT unnest(game_genres) AS c FROM tr)
SELECT te.app_id, 'game_genres_' || c AS column_name, CAST(list_contains(te.game_genres, c) AS INTEGER) AS value
FROM te, known""")
def q_multilabel_ignore(spark, d):
    train, test = _games_split(spark, d)
    ml = enc.MultiLabel.fit(train, "game_genres", "game_genres", unknown=False)
    return _long(ml.apply(test.select("app_id", "game_genres")), "app_id", "game_genres_")


# ------------------------------------------------------------------ C3
@register("label_encode_brand", "C3", SPLIT_CTE + """,
lab AS (SELECT game_brand, CAST(row_number() OVER (ORDER BY game_brand) - 1 AS INTEGER) AS idx
        FROM (SELECT DISTINCT game_brand FROM tr))
SELECT te.app_id, coalesce(lab.idx, CAST((SELECT count(*) FROM lab) AS INTEGER)) AS game_brand_encoded
FROM te LEFT JOIN lab USING (game_brand)""")
def q_label_encode(spark, d):
    train, test = _games_split(spark, d)
    le = enc.LabelEncoder.fit(train, "game_brand")
    return le.apply(test.select("app_id", "game_brand")).select("app_id", "game_brand_encoded")


# ------------------------------------------------------------------ C4
@register("list_encode_pad_genres", "C4 A22", SPLIT_CTE + """,
lab AS (SELECT list(c ORDER BY c) AS l FROM (SELECT DISTINCT unnest(game_genres) AS c FROM tr)),
w AS (SELECT max(len(game_genres)) AS width FROM tr)
SELECT app_id, array_to_string(list_resize(
         list_transform(game_genres, lambda x: coalesce(list_position(lab.l, x), len(lab.l) + 1)),
         w.width, 0), ',') AS game_genres_encoded_padded
FROM te, lab, w""")
def q_list_encode(spark, d):
    train, test = _games_split(spark, d)
    le = enc.ListEncoder.fit(train, "game_genres")
    out = le.apply(test.select("app_id", "game_genres"))
    return out.select("app_id", F.concat_ws(",", F.col("game_genres_encoded_padded").cast("array<string>"))
                      .alias("game_genres_encoded_padded"))


# ------------------------------------------------------------------ C5 C6 C8
@register("coverage_cap_genres", "C5 A14", SPLIT_CTE + """,
cnt AS (SELECT c, count(*) AS n FROM (SELECT unnest(game_genres) AS c FROM tr) GROUP BY c),
cum AS (SELECT c, sum(n) OVER (ORDER BY n DESC, c ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS s FROM cnt),
kept AS (SELECT c FROM cum WHERE s < 0.8)
SELECT app_id, array_to_string(list_sort(list_distinct(list_transform(game_genres,
          lambda x: CASE WHEN coalesce(list_contains(k.kl, x), false) THEN x ELSE 'Other' END))), '|') AS game_genres
FROM te, (SELECT list(c) AS kl FROM kept) k""")
def q_coverage(spark, d):
    train, test = _games_split(spark, d)
    cap = enc.CoverageCap.fit(train, "game_genres", 0.8)
    out = cap.apply(test.select("app_id", "game_genres"))
    return out.select("app_id", F.concat_ws("|", F.array_sort("game_genres")).alias("game_genres"))


@register("top_tags_binarized", "C6", SPLIT_CTE + """,
top AS (SELECT c FROM (SELECT unnest(game_genres) AS c FROM tr) GROUP BY c ORDER BY count(*) DESC, c LIMIT 5)
SELECT app_id, 'tag_' || c AS column_name, CAST(list_contains(game_genres, c) AS INTEGER) AS value FROM te, top""")
def q_top_tags(spark, d):
    train, test = _games_split(spark, d)
    t = enc.TopNLabels.fit(train, "game_genres", 5, "tag")
    return _long(t.apply(test.select("app_id", "game_genres")), "app_id", "tag_")


TOPN_SQL = fx.cte(inter=I, g=G) + f""",
cnt AS (SELECT game_brand, count(*) AS n FROM inter JOIN g USING (app_id)
        WHERE app_id % {M} <> 0 GROUP BY game_brand),
top AS (SELECT game_brand FROM cnt ORDER BY n DESC, game_brand LIMIT 10)"""


@register("top_brands_else_other", "C8", TOPN_SQL + f"""
SELECT app_id, CASE WHEN game_brand IN (SELECT game_brand FROM top) THEN game_brand ELSE 'Other' END AS game_brand
FROM g WHERE app_id % {M} = 0""")
def q_topn(spark, d):
    i = fx.interactions(spark, d).select("app_id")
    g = fx.games(spark, d).select("app_id", "game_brand")
    train_rows = i.filter(F.col("app_id") % M != 0).join(g, "app_id")
    t = enc.TopN.fit(train_rows, "game_brand", 10)
    return t.apply(g.filter(F.col("app_id") % M == 0))


@register("enforce_test_categories", "C9 C8", TOPN_SQL + f""",
trb AS (SELECT DISTINCT game_brand FROM g WHERE app_id % {M} <> 0 AND game_brand <> '{HOLD}'),
trt AS (SELECT DISTINCT CASE WHEN game_brand IN (SELECT game_brand FROM top) THEN game_brand ELSE 'Other' END AS c
        FROM trb)
SELECT app_id,
  CASE WHEN game_brand IN (SELECT game_brand FROM trb) THEN game_brand END AS game_brand,
  CASE WHEN brand_top IN (SELECT c FROM trt) THEN brand_top WHEN 'Other' IN (SELECT c FROM trt) THEN 'Other'
       WHEN 'Missing' IN (SELECT c FROM trt) THEN 'Missing' END AS brand_top
FROM (SELECT app_id, game_brand, game_brand AS brand_top FROM g WHERE app_id % {M} = 0)""")
def q_enforce(spark, d):
    i = fx.interactions(spark, d).select("app_id")
    g = fx.games(spark, d).select("app_id", "game_brand")
    t = enc.TopN.fit(i.filter(F.col("app_id") % M != 0).join(g, "app_id"), "game_brand", 10)
    train = g.filter((F.col("app_id") % M != 0) & (F.col("game_brand") != HOLD))
    train = t.apply(train, "brand_top")
    fitted = enc.CategoryEnforcer.fit(train, ["game_brand", "brand_top"])
    test = g.filter(F.col("app_id") % M == 0).withColumn("brand_top", F.col("game_brand"))
    return fitted.apply(test)


@register("dense_user_index", "C11", fx.cte(inter=I) + """
SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT user_id FROM inter)""")
def q_index(spark, d):
    return enc.build_index(fx.interactions(spark, d), "user_id")


# ------------------------------------------------------------------ I1-I7
UTR = f"SELECT * FROM u WHERE user_id % {M} <> 0"


@register("median_fill_coordinates", "I1 A2", fx.cte(u=U, tr=UTR) + """
SELECT user_id, round(coalesce(user_latitude, (SELECT median(user_latitude) FROM tr)), 6) AS user_latitude,
       round(coalesce(user_longitude, (SELECT median(user_longitude) FROM tr)), 6) AS user_longitude FROM u""")
def q_median_fill(spark, d):
    u = fx.users(spark, d).select("user_id", "user_latitude", "user_longitude")
    f = imp.MedianFill.fit(u.filter(F.col("user_id") % M != 0), ["user_latitude", "user_longitude"])
    return round_doubles(f.apply(u))


@register("group_median_fill_coordinates", "I2 J5", fx.cte(u=U, tr=UTR) + """,
g AS (SELECT user_country_code, median(user_latitude) AS glat, median(user_longitude) AS glon FROM tr GROUP BY 1)
SELECT user_id, round(coalesce(user_latitude, g.glat, (SELECT median(user_latitude) FROM tr)), 6) AS user_latitude,
       round(coalesce(user_longitude, g.glon, (SELECT median(user_longitude) FROM tr)), 6) AS user_longitude
FROM u LEFT JOIN g USING (user_country_code)""")
def q_group_median_fill(spark, d):
    u = fx.users(spark, d).select("user_id", "user_country_code", "user_latitude", "user_longitude")
    f = imp.GroupMedianFill.fit(u.filter(F.col("user_id") % M != 0), ["user_latitude", "user_longitude"],
                                "user_country_code")
    return round_doubles(f.apply(u).select("user_id", "user_latitude", "user_longitude"))


RELEASE_SQL = """SELECT p_partkey AS app_id,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE year(DATE '1990-01-01' + CAST(p_partkey % 9000 AS INTEGER)) END AS ry,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE month(DATE '1990-01-01' + CAST(p_partkey % 9000 AS INTEGER)) END AS rm,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE day(DATE '1990-01-01' + CAST(p_partkey % 9000 AS INTEGER)) END AS rd
FROM part"""


def _mode_sql(c):
    return (f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM tr WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"ORDER BY n DESC, {c} LIMIT 1)")


@register("mode_fill_release_date", "I3 A3 P9", fx.cte(r=RELEASE_SQL, tr=f"SELECT * FROM r WHERE app_id % {M} <> 0") + f"""
SELECT app_id, CAST(coalesce(ry, {_mode_sql('ry')}) AS INTEGER) AS released_year,
       CAST(coalesce(rm, {_mode_sql('rm')}) AS INTEGER) AS released_month,
       CAST(coalesce(rd, {_mode_sql('rd')}) AS INTEGER) AS released_day FROM r""")
def q_mode_fill(spark, d):
    from ludex.plans.q_clean import catalog_raw
    from ludex.functions.clean import date_parts
    c = date_parts(catalog_raw(spark, d).select("id", "released"), "released", "released")
    c = c.select(F.col("id").alias("app_id"), "released_year", "released_month", "released_day")
    f = imp.ModeFill.fit(c.filter(F.col("app_id") % M != 0), ["released_year", "released_month", "released_day"])
    return f.apply(c)


# fixture: overlapping platform-like flags and a price with holes
FLAG_EXPRS = {
    "platform_a": "p_size > 10",
    "platform_b": "p_size > 25",
    "platform_c": "p_size % 2 = 0",
    "platform_d": "p_size < 40",
    "platform_e": "p_size > 60",
}
PRICE_HOLE = "p_partkey % 7 = 0"


def _flag_frame(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    cols = [F.col("p_partkey").alias("app_id"),
            F.when(F.expr(PRICE_HOLE), F.lit(None).cast("double")).otherwise(F.col("p_retailprice") / 10.0)
            .alias("game_current_price"),
            F.col("p_retailprice").alias("game_initial_price")]
    cols += [F.expr(e).cast("int").alias(k) for k, e in FLAG_EXPRS.items()]
    return p.select(*cols)


def _seq_sql():
    flags = list(FLAG_EXPRS)
    base = ("SELECT p_partkey AS app_id, CASE WHEN " + PRICE_HOLE + " THEN NULL ELSE p_retailprice / 10.0 END AS price, "
            "p_retailprice AS init, " + ", ".join(f"CAST({e} AS INTEGER) AS {k}" for k, e in FLAG_EXPRS.items())
            + " FROM part")
    ctes = {"b": base}
    chain = "price"
    for i, f in enumerate(flags):
        ctes[f"m{i}"] = f"SELECT median({chain}) AS m FROM b WHERE app_id % {M} <> 0 AND {f} > 0"
        chain = f"coalesce({chain}, CASE WHEN {f} > 0 THEN (SELECT m FROM m{i}) END)"
    return fx.cte(**ctes) + f"""
SELECT app_id, round({chain}, 6) AS game_current_price,
       round_even((init - {chain}) / (init + 0.000001), 0) + 0.0 AS game_current_discount FROM b"""


@register("sequential_flag_median_price", "I4 I5 P26", _seq_sql())
def q_seq_fill(spark, d):
    f = _flag_frame(spark, d)
    fit = imp.SequentialFlagMedianFill.fit(f.filter(F.col("app_id") % M != 0), ["game_current_price"],
                                           list(FLAG_EXPRS))
    out = imp.recompute_discount(fit.apply(f))
    return round_doubles(out.select("app_id", "game_current_price", "game_current_discount"))


@register("all_zero_indicator_columns", "I6", """
SELECT 'platform_a' AS column_name, max(CAST(p_size > 10 AS INTEGER)) = 0 AS dropped FROM part
UNION ALL SELECT 'platform_e', max(CAST(p_size > 60 AS INTEGER)) = 0 FROM part
UNION ALL SELECT 'platform_z', max(CAST(p_size > 1000 AS INTEGER)) = 0 FROM part""")
def q_zero_cols(spark, d):
    p = fx.table(spark, d, "part").select(F.expr("CAST(p_size > 10 AS INT)").alias("platform_a"),
                                          F.expr("CAST(p_size > 60 AS INT)").alias("platform_e"),
                                          F.expr("CAST(p_size > 1000 AS INT)").alias("platform_z"))
    zero = set(imp.zero_columns(p, p.columns))
    kept = imp.drop_zero_cols(p, p.columns).columns
    assert set(kept) == set(p.columns) - zero
    return spark.createDataFrame([(c, c in zero) for c in p.columns], "column_name string, dropped boolean")


PROFILE_IMP_SQL = fx.cte(u=U, tr=UTR) + f""",
te AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_country_code END AS user_country_code,
              user_latitude, user_longitude,
              CASE WHEN user_id % 4 = 0 THEN NULL ELSE (epoch({fx.AS_OF_SQL}) - epoch(user_created)) / (30.44 * 86400) END
                AS user_account_age_months
       FROM u WHERE user_id % {M} = 0),
trm AS (SELECT *, (epoch({fx.AS_OF_SQL}) - epoch(user_created)) / (30.44 * 86400) AS age FROM tr),
g AS (SELECT user_country_code, median(user_latitude) AS glat, median(user_longitude) AS glon FROM tr GROUP BY 1)
SELECT te.user_id, coalesce(te.user_country_code, 'Missing') AS user_country_code,
  coalesce(user_latitude <> 0 AND user_longitude <> 0, false) AS user_has_coordinates,
  round(coalesce(user_latitude, CASE WHEN te.user_country_code IS NOT NULL THEN g.glat
                                     ELSE (SELECT median(user_latitude) FROM tr) END), 6) AS user_latitude,
  round(coalesce(user_longitude, CASE WHEN te.user_country_code IS NOT NULL THEN g.glon
                                      ELSE (SELECT median(user_longitude) FROM tr) END), 6) AS user_longitude,
  round(coalesce(user_account_age_months, (SELECT median(age) FROM trm)), 6) AS user_account_age_months
FROM te LEFT JOIN g ON te.user_country_code = g.user_country_code"""


@register("profile_imputation_new_users", "I7 I1 I2", PROFILE_IMP_SQL)
def q_profile_imp(spark, d):
    from ludex.functions.clean import age_months
    u = fx.users(spark, d).withColumn("user_account_age_months", age_months("user_created", fx.AS_OF))
    tr = u.filter(F.col("user_id") % M != 0)
    te = u.filter(F.col("user_id") % M == 0).select(
        "user_id", F.when(F.col("user_id") % 3 == 0, F.lit(None)).otherwise(F.col("user_country_code"))
        .alias("user_country_code"), "user_latitude", "user_longitude",
        F.when(F.col("user_id") % 4 == 0, F.lit(None)).otherwise(F.col("user_account_age_months"))
        .alias("user_account_age_months"))
    geo = imp.GroupMedianFill.fit(tr, ["user_latitude", "user_longitude"], "user_country_code")
    age = imp.MedianFill.fit(tr, ["user_account_age_months"])
    out = imp.impute_profiles(te, geo, age)
    return round_doubles(out.select("user_id", "user_country_code", "user_has_coordinates", "user_latitude",
                                    "user_longitude", "user_account_age_months"))


@register("game_input_imputation", "I7 A16", fx.cte(inter=I) + f""",
means AS (SELECT app_id, coalesce(avg(playtime_forever), 0.0) AS pm, coalesce(avg(achievements), 0.0) AS am
          FROM inter WHERE user_id % {M} <> 0 GROUP BY app_id),
newr AS (SELECT user_id, app_id, CASE WHEN app_id % 3 = 0 THEN NULL ELSE playtime_forever END AS playtime_forever,
                achievements FROM inter WHERE user_id % {M} = 0)
SELECT user_id, app_id, round(coalesce(playtime_forever, pm, 0.0), 6) AS playtime_forever,
       round(coalesce(achievements, am, 0.0), 6) AS achievements
FROM newr LEFT JOIN means USING (app_id)""")
def q_game_inputs(spark, d):
    i = fx.interactions(spark, d)
    means = pf.game_means(i.filter(F.col("user_id") % M != 0), "app_id", ["playtime_forever", "achievements"])
    new = i.filter(F.col("user_id") % M == 0).select(
        "user_id", "app_id", F.when(F.col("app_id") % 3 == 0, F.lit(None)).otherwise(F.col("playtime_forever"))
        .alias("playtime_forever"), F.col("achievements").cast("double").alias("achievements"))
    return round_doubles(imp.impute_game_inputs(new, means))


# ------------------------------------------------------------------ N1 N2 N4 N6 A1
@register("user_profile_means", "A1 R9 J2", fx.cte(inter=I) + """
SELECT user_id, app_id, round(avg(playtime_forever) OVER (PARTITION BY user_id), 6) AS user_preference_playtime_forever,
       round(avg(achievements) OVER (PARTITION BY user_id), 6) AS user_preference_achievements,
       round((sum(playtime_forever) OVER (PARTITION BY user_id) - playtime_forever)
             / nullif(count(playtime_forever) OVER (PARTITION BY user_id) - 1, 0), 6) AS loo_playtime
FROM inter""")
def q_user_profile(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id", "playtime_forever", "achievements")
    a = pf.user_profile(i, "user_id", ["playtime_forever", "achievements"], loo={"playtime_forever": "loo_playtime"})
    return round_doubles(a.select("user_id", "app_id", "user_preference_playtime_forever",
                                  "user_preference_achievements", "loo_playtime"))


@register("minmax_scale_user_means", "N1 A1", fx.cte(inter=I) + f""",
p AS (SELECT user_id, avg(playtime_forever) AS a, avg(price_mean) AS b FROM inter GROUP BY user_id),
s AS (SELECT min(a) AS alo, max(a) AS ahi, min(b) AS blo, max(b) AS bhi FROM p WHERE user_id % {M} <> 0)
SELECT user_id, round((a - alo) / CASE WHEN ahi = alo THEN 1 ELSE ahi - alo END, 6) AS a,
       round((b - blo) / CASE WHEN bhi = blo THEN 1 ELSE bhi - blo END, 6) AS b FROM p, s""")
def q_minmax_scale(spark, d):
    i = fx.interactions(spark, d)
    p = pf.user_profile_table(i, "user_id", ["playtime_forever", "price_mean"], prefix="",
                              names={"playtime_forever": "a", "price_mean": "b"})
    mm = sc.MinMax.fit(p.filter(F.col("user_id") % M != 0), ["a", "b"])
    return round_doubles(mm.apply(p))


@register("standardize_totalprice", "N2 A20", f"""
WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd FROM orders WHERE o_orderkey % {M} <> 0)
SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS o_totalprice FROM orders, s""")
def q_standardize(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    st = sc.Standardize.fit(o.filter(F.col("o_orderkey") % M != 0), ["o_totalprice"])
    return round_doubles(st.apply(o))


def _yj_sql(x, lam):
    pos = f"ln(1 + {x})" if lam == 0 else f"(pow({x} + 1, {lam}) - 1) / {lam}"
    neg = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


YJ_LAMBDAS = {"c_acctbal": -0.85, "scaled": 0.5, "zero": 0.0, "two": 2.0}


@register("yeo_johnson_apply", "N4", """
SELECT c_custkey, round(""" + _yj_sql("c_acctbal / 1000.0", -0.85) + """, 6) AS c_acctbal,
       round(""" + _yj_sql("c_acctbal / 1000.0", 0.5) + """, 6) AS scaled,
       round(""" + _yj_sql("c_acctbal / 1000.0", 0.0) + """, 6) AS zero,
       round(""" + _yj_sql("c_acctbal / 1000.0", 2.0) + """, 6) AS two FROM customer""")
def q_yj_apply(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", *[(F.col("c_acctbal") / 1000.0).alias(k)
                                                             for k in YJ_LAMBDAS])
    yj = sc.YeoJohnson(cols=list(YJ_LAMBDAS), lambdas=list(YJ_LAMBDAS.values()))
    return round_doubles(yj.apply(c))


@register("yeo_johnson_fit", "N3 N5 A12")
def q_yj_fit(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_extendedprice", "l_quantity")
    o = fx.table(spark, d, "orders").select("o_totalprice")
    rows = []
    for df, cols in ((li, ["l_extendedprice", "l_quantity"]), (o, ["o_totalprice"])):
        fit = sc.YeoJohnson.fit(df, cols)
        lams = dict(zip(cols, fit.state["lambdas"]))
        llf = sc.YeoJohnson.log_likelihoods(df, {c: [lam, lam - 0.05, lam + 0.05] for c, lam in lams.items()})
        for col, lam in lams.items():
            rows.append((col, lam, llf[(col, lam)], llf[(col, lam - 0.05)], llf[(col, lam + 0.05)]))
    return spark.createDataFrame(rows, "column_name string, lambda double, llf double, llf_lo double, llf_hi double")


@register("zero_variance_columns", "N6", """
SELECT 'l_quantity' AS column_name, count(DISTINCT l_quantity) <= 1 AS zero_variance FROM lineitem
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag) <= 1 FROM lineitem
UNION ALL SELECT 'one', count(DISTINCT CASE WHEN l_quantity > 0 THEN 1 END) <= 1 FROM lineitem""")
def q_zero_var(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_quantity", "l_returnflag",
                                               F.when(F.col("l_quantity") > 0, F.lit(1)).alias("one"))
    zv = set(sc.zero_variance_columns(li, li.columns))
    return spark.createDataFrame([(c, c in zv) for c in li.columns], "column_name string, zero_variance boolean")


# ------------------------------------------------------------------ the offline build as one flow
FLOW_NUMBERS = ["user_account_age_months", "user_latitude", "user_longitude", "game_avg_playtime_forever", "game_released_year",
                "game_initial_price", "game_current_price", "game_current_discount", "game_popularity", "game_edition"]
FLOW_MEANS = {"game_popularity": "user_preference_game_popularity", "game_avg_playtime_forever": "user_preference_game_duration",
              "game_released_year": "user_preference_new_game", "game_initial_price": "user_preference_avg_spent"}
FLOW_FLAGS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]   # fixed value: part types, the fixture's platforms


def flow_steps(power: bool) -> list:
    """The offline build in its order: encode, user means, impute, scale."""
    from ludex.operators import flow as fl
    prices = ["game_initial_price", "game_current_price"]
    lists = ["game_esrb_rating_*", "game_genres_*", "game_platforms_*"]
    steps = [fl.OneHotStep("game_esrb_rating"), fl.MultiLabelStep("game_genres", "game_genres"),
             fl.MultiLabelStep("game_platforms", "game_platforms"),
             fl.Derive("game_popularity", "(game_estimate_owners_lower + game_estimate_owners_upper) / 2",
                       ["game_estimate_owners_lower", "game_estimate_owners_upper"]),
             fl.UserMeans("user_id", FLOW_MEANS, lists), fl.ScaleStep(list(FLOW_MEANS.values()), minmax=True),
             fl.DropConstant(["game_platforms_*"], zero=True), fl.MedianStep(["game_avg_playtime_forever", "user_account_age_months"]),
             fl.GroupMedianStep(["user_latitude", "user_longitude"], "user_country_code"), fl.ModeStep(["game_released_year"]),
             fl.FlagMediansStep(prices, "game_platforms_*"),
             fl.Derive("game_current_discount", "bround((game_initial_price - game_current_price) / (game_initial_price + 1e-6), 0)", prices),
             fl.DropConstant(FLOW_NUMBERS)]
    return [*steps, *([fl.PowerStep(FLOW_NUMBERS)] if power else []), fl.ScaleStep(FLOW_NUMBERS)]


def flow_frame(spark, d):
    """Fact rows with game and user columns, nulls planted by id."""
    from ludex.functions import clean as cl
    from ludex.plans.q_relevance import relevance_table
    def gap(key, mod, c):
        return F.when(F.col(key) % mod != 0, c)

    k = "p_partkey"
    g = fx.table(spark, d, "part").select(
        F.col(k).alias("app_id"), F.split("p_name", " ").alias("game_genres"),
        F.when((F.col("p_size") % 3 == 0) & (F.col("p_type") != "PROMO"), F.array("p_type", F.lit("PROMO")))
        .otherwise(F.array("p_type")).alias("game_platforms"),
        gap(k, 10, F.col("p_brand")).alias("game_esrb_rating"), (F.col("p_size") * 1000).alias("game_estimate_owners_lower"),
        (F.col("p_size") * 2000).alias("game_estimate_owners_upper"), gap(k, 6, F.col("p_size").cast("double")).alias("game_avg_playtime_forever"),
        gap(k, 9, F.lit(1980) + F.col("p_size") % 30).alias("game_released_year"), gap(k, 7, F.col("p_retailprice")).alias("game_initial_price"),
        gap(k, 4, F.col("p_retailprice") * 0.4).alias("game_current_price"), F.lit(1).alias("game_edition"))
    u = fx.users(spark, d).select(
        "user_id", F.coalesce(gap("user_id", 13, F.col("user_country_code")), F.lit(cl.MISSING)).alias("user_country_code"), "user_latitude",
        "user_longitude", gap("user_id", 17, cl.age_months("user_created", fx.AS_OF)).alias("user_account_age_months"))
    r = relevance_table(spark, d).select("user_id", "app_id", "relevance_score")
    return r.join(g, "app_id").join(u, "user_id", "left")


def _flow_sql() -> str:
    from ludex.plans.q_relevance import RELEVANCE_SQL_BODY
    chain = ""
    for i, w in enumerate(FLOW_FLAGS):
        fills = ", ".join(f"coalesce({c}, CASE WHEN list_contains(platforms, '{w}') THEN (SELECT median({c}) FROM p{i} WHERE tr AND "
                          f"list_contains(platforms, '{w}')) END) AS {c}" for c in ("ip", "cp"))
        chain += f"p{i + 1} AS MATERIALIZED (SELECT user_id, app_id, tr, platforms, {fills} FROM p{i}),\n"
    numbers = {"user_account_age_months": "age", "user_latitude": "lat", "user_longitude": "lon", "game_avg_playtime_forever": "dur",
               "game_released_year": "yr", "game_initial_price": "ip", "game_current_price": "cp",
               "game_current_discount": "round_even((ip - cp) / (ip + 1e-6), 0)", "game_popularity": "pop", "game_edition": "1"}
    long = " UNION ALL ".join(f"SELECT user_id, app_id, tr, '{n}' AS feature, CAST({c} AS DOUBLE) AS v FROM q" for n, c in numbers.items())
    prefs = " UNION ALL ".join(f"SELECT user_id, bool_and(tr) AS tr, '{n}' AS feature, avg({c}) AS v FROM f GROUP BY user_id"
                               for n, c in zip(FLOW_MEANS.values(), ("pop", "dur", "yr", "ip")))
    lists = " UNION ALL ".join(
        f"SELECT DISTINCT user_id, app_id, tr, 'game_{n}_' || CASE WHEN w IN (SELECT unnest({n}) FROM f WHERE tr) THEN w ELSE 'Unknown' END AS feature "
        f"FROM (SELECT user_id, app_id, tr, unnest({n}) AS w FROM f)" for n in ("genres", "platforms"))
    return RELEVANCE_SQL_BODY.rstrip() + f""",
u AS ({fx.USERS_SQL}),
f AS MATERIALIZED (SELECT r.user_id, r.app_id, r.user_id % {fx.TRAIN_MOD} <> 0 AS tr, string_split(p_name, ' ') AS genres,
             CASE WHEN p_size % 3 = 0 AND p_type <> 'PROMO' THEN [p_type, 'PROMO'] ELSE [p_type] END AS platforms, CASE WHEN p_partkey % 10 <> 0 THEN p_brand END AS esrb,
             p_size * 1500.0 AS pop, CASE WHEN p_partkey % 6 <> 0 THEN p_size END AS dur,
             CASE WHEN p_partkey % 9 <> 0 THEN 1980 + p_size % 30 END AS yr, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS ip,
             CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice * 0.4 END AS cp,
             coalesce(CASE WHEN r.user_id % 13 <> 0 THEN u.user_country_code END, 'Missing') AS country, u.user_latitude AS lat,
             u.user_longitude AS lon,
             CASE WHEN r.user_id % 17 <> 0 THEN (epoch({fx.AS_OF_SQL}) - epoch(u.user_created)) / (30.44 * 86400.0) END AS age
      FROM rel r JOIN part ON r.app_id = p_partkey LEFT JOIN u ON r.user_id = u.user_id),
ind AS MATERIALIZED (SELECT user_id, app_id, tr, 'game_esrb_rating_' || CASE WHEN esrb IN (SELECT esrb FROM f WHERE tr AND esrb IS NOT NULL)
                     THEN esrb ELSE 'Unknown' END AS feature FROM f UNION ALL {lists}),
p0 AS MATERIALIZED (SELECT user_id, app_id, tr, platforms, ip, cp FROM f),
{chain}
geo AS (SELECT country, median(lat) AS glat, median(lon) AS glon FROM f WHERE tr GROUP BY country),
whole AS (SELECT median(lat) AS mlat, median(lon) AS mlon, median(dur) AS mdur, median(age) AS mage FROM f WHERE tr),
yrs AS (SELECT yr AS myr FROM f WHERE tr AND yr IS NOT NULL GROUP BY yr ORDER BY count(*) DESC, yr LIMIT 1),
q AS MATERIALIZED (SELECT f.user_id, f.app_id, f.tr, pop, coalesce(dur, mdur) AS dur, coalesce(age, mage) AS age, coalesce(yr, myr) AS yr,
             coalesce(lat, glat, mlat) AS lat, coalesce(lon, glon, mlon) AS lon, p.ip, p.cp
      FROM f JOIN p{len(FLOW_FLAGS)} p USING (user_id, app_id) LEFT JOIN geo USING (country), whole, yrs),
num AS MATERIALIZED ({long}),
ns AS (SELECT feature, avg(v) AS m, stddev_pop(v) AS s FROM num WHERE tr GROUP BY feature HAVING min(v) <> max(v)),
pref AS MATERIALIZED ({prefs}),
ps AS (SELECT feature, min(pref.v) AS lo, max(pref.v) AS hi FROM pref JOIN (SELECT DISTINCT user_id FROM f WHERE tr) USING (user_id) GROUP BY feature),
cnt AS (SELECT user_id, count(*) AS n FROM f WHERE NOT tr GROUP BY user_id)
SELECT user_id, app_id, feature, round(v, 6) AS value FROM (
  SELECT user_id, app_id, feature, 1.0 AS v FROM ind WHERE NOT tr
         AND (feature NOT LIKE 'game_platforms_%' OR feature IN (SELECT feature FROM ind WHERE tr))
  UNION ALL SELECT user_id, app_id, feature, (v - m) / s FROM num JOIN ns USING (feature) WHERE NOT tr AND v IS NOT NULL
  UNION ALL SELECT user_id, 0, feature, (v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END FROM pref JOIN ps USING (feature) WHERE NOT tr AND v IS NOT NULL
  UNION ALL SELECT user_id, 0, 'user_preference_' || feature, count(*) * 1.0 / any_value(n) FROM ind JOIN cnt USING (user_id)
            WHERE NOT tr GROUP BY user_id, feature)
WHERE round(v, 6) <> 0"""


@register("feature_pipeline_train_test", "C1 C2 A1 P25 N1 I1 I2 I3 I4 I5 I6 N2 N6", _flow_sql())
def q_flow(spark, d):
    """The offline build fitted on the train users, saved, loaded and applied to the test users: the features other than 0,
    in long form (a user's own features once, under app_id 0)."""
    from ludex.operators.flow import FeatureFlow
    from ludex.session import cut_lineage, scratch_path
    f = cut_lineage(flow_frame(spark, d))
    path = scratch_path(spark, "flow")
    FeatureFlow(flow_steps(power=False)).fit(f.filter(F.col("user_id") % fx.TRAIN_MOD != 0), staged=True).save(spark, path)
    out = cut_lineage(FeatureFlow.load(spark, path).apply(f.filter(F.col("user_id") % fx.TRAIN_MOD == 0)))
    rows = [c for c in out.columns if c.startswith(("game_esrb_rating_", "game_genres_", "game_platforms_")) or c in FLOW_NUMBERS]
    own = [c for c in out.columns if c.startswith("user_preference_")]

    def long(df, cols):
        values = [F.col(f"`{c}`").cast("double").alias(c) for c in cols]
        return df.select("user_id", "app_id", *values).unpivot(["user_id", "app_id"], [f"`{c}`" for c in cols], "feature", "value")

    users = out.select("user_id", F.lit(0).cast(out.schema["app_id"].dataType).alias("app_id"), *[f"`{c}`" for c in own]).dropDuplicates(["user_id"])   # equal in all rows of a user
    return round_doubles(long(out, rows).unionByName(long(users, own))).filter("value <> 0")
