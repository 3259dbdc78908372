"""Registered queries: cleaning and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ludex.functions import clean as cl
from ludex.plans import fixtures as fx
from ludex.plans.registry import register, round_doubles


# ---------------------------------------------------------------- P1 P2 P3
@register("rename_drop_filter", "P1 P2 P3", """
SELECT l_orderkey AS order_id, l_partkey AS app_id, l_quantity AS playtime_forever,
       l_returnflag AS flag
FROM lineitem
WHERE l_quantity > 10 AND (l_returnflag = 'R' OR l_discount >= 0.05) AND l_tax IS NOT NULL""")
def q_rename_drop_filter(spark, d):
    li = fx.table(spark, d, "lineitem")
    li = cl.filter_rows(li, (F.col("l_quantity") > 10)
                        & ((F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.05))
                        & F.col("l_tax").isNotNull())
    li = cl.rename(li, {"l_orderkey": "order_id", "l_partkey": "app_id",
                        "l_quantity": "playtime_forever", "l_returnflag": "flag"})
    return cl.drop_columns(li, [c for c in li.columns if c.startswith("l_")])


# ---------------------------------------------------------------- P4
COMPANY_SRC = "p_brand || ', ' || p_name || ' Inc., ' || p_type || ' Ltd.,  '"


@register("company_names_normalized", "P4 F1", f"""
SELECT p_partkey AS app_id, array_to_string(l, '|') AS developers, CAST(len(l) AS INTEGER) AS n_developers
FROM (SELECT p_partkey,
        list_filter(list_transform(string_split(
          replace(replace(replace(replace(lower({COMPANY_SRC}), '.', ''), 'inc', ''), 'llc', ''), 'ltd', ''),
          ','), lambda x: trim(x)), lambda x: x <> '') AS l
      FROM part)""")
def q_company(spark, d):
    p = fx.table(spark, d, "part")
    src = F.concat_ws("", F.col("p_brand"), F.lit(", "), F.col("p_name"), F.lit(" Inc., "),
                      F.col("p_type"), F.lit(" Ltd.,  "))
    names = cl.normalize_names(src)
    return p.select(F.col("p_partkey").alias("app_id"), F.concat_ws("|", names).alias("developers"),
                    F.size(names).alias("n_developers"))


# ---------------------------------------------------------------- P5 P6 P7 P25
@register("market_fields", "P5 P6 P7 P25 A15", fx.cte(g=fx.GAMES_SQL) + """,
m AS (SELECT app_id, CASE WHEN game_size % 3 = 0 THEN '' ELSE CAST(game_size AS VARCHAR) END AS score_rank_s,
             game_owners, CAST(game_initial_price AS VARCHAR) AS price_s FROM g)
SELECT app_id,
       CASE WHEN score_rank_s = '' THEN 0 ELSE CAST(score_rank_s AS INTEGER) END AS score_rank,
       CAST(string_split(replace(game_owners, ',', ''), ' .. ')[1] AS BIGINT) AS owners_lower,
       CAST(string_split(replace(game_owners, ',', ''), ' .. ')[-1] AS BIGINT) AS owners_upper,
       round((CAST(string_split(replace(game_owners, ',', ''), ' .. ')[1] AS BIGINT)
            + CAST(string_split(replace(game_owners, ',', ''), ' .. ')[-1] AS BIGINT)) / 2, 6) AS game_popularity,
       round(CAST(price_s AS DOUBLE), 6) AS price
FROM m""")
def q_market(spark, d):
    g = fx.games(spark, d)
    g = g.select("app_id", F.when(F.col("game_size") % 3 == 0, F.lit("")).otherwise(
        F.col("game_size").cast("string")).alias("score_rank_s"), "game_owners",
        F.col("game_initial_price").cast("string").alias("price_s"))
    lo, hi = cl.parse_range("game_owners")
    return round_doubles(g.select("app_id", cl.empty_to_zero("score_rank_s").alias("score_rank"),
                                  lo.alias("owners_lower"), hi.alias("owners_upper"),
                                  ((lo + hi) / 2).alias("game_popularity"),
                                  cl.to_double("price_s").alias("price")))


@register("market_quality_report", "A15 P6", fx.cte(g=fx.GAMES_SQL) + """,
m AS (SELECT CAST(string_split(replace(game_owners, ',', ''), ' .. ')[1] AS BIGINT) AS lo,
             CAST(string_split(replace(game_owners, ',', ''), ' .. ')[-1] AS BIGINT) AS hi,
             game_genres FROM g)
SELECT CAST(count_if(lo > hi) AS BIGINT) AS lower_above_upper, CAST(count_if(len(game_genres) = 0) AS BIGINT) AS empty_lists,
       count(*) AS n_rows FROM m""")
def q_market_quality(spark, d):
    from ludex.operators.profile import quality_report
    g = fx.games(spark, d)
    lo, hi = cl.parse_range("game_owners")
    return quality_report(g.select(lo.alias("lo"), hi.alias("hi"), "game_genres"),
                          {"lower_above_upper": F.col("lo") > F.col("hi"),
                           "empty_lists": F.size("game_genres") == 0})


# ---------------------------------------------------------------- P8 P10 P11
@register("lenient_casts_and_age", "P8 P10 P11", f"""
SELECT c_custkey AS user_id,
       round(try_cast(CASE WHEN c_custkey % 4 = 0 THEN 'x' || c_name ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE), 6) AS acct,
       round(epoch({fx.AS_OF_SQL}) - floor(epoch(oc.created)), 6) AS age_seconds,
       round((epoch({fx.AS_OF_SQL}) - floor(epoch(oc.created))) / (30.44 * 86400), 6) AS user_account_age_months
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created FROM orders GROUP BY o_custkey) oc
  ON c_custkey = oc.o_custkey""")
def q_casts_age(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("created"))
    j = c.join(o, c.c_custkey == o.o_custkey, "left")
    raw = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("x"), F.col("c_name"))) \
        .otherwise(F.col("c_acctbal").cast("string"))
    epoch_str = cl.epoch_seconds("created").cast("string")          # the raw form: epoch seconds as text
    created = cl.epoch_to_timestamp(epoch_str)                     # an instant
    age_s = cl.age_months(created, fx.AS_OF, ntz=False) * (cl.DAYS_PER_MONTH * 86400.0)
    return round_doubles(j.select(F.col("c_custkey").alias("user_id"), cl.to_double_lenient(raw).alias("acct"),
                                  age_s.alias("age_seconds"),
                                  cl.age_months(created, fx.AS_OF, ntz=False).alias("user_account_age_months")))


# ---------------------------------------------------------------- nested catalog
def catalog_raw(spark, d):
    """Row-local nested game records built from ``part`` (no grouping)."""
    p = fx.table(spark, d, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    released = F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(
        F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (k % 9000).cast("int")), "yyyy-MM-dd"))
    ratings = F.array(
        F.struct(F.lit(5).alias("id"), (F.col("p_retailprice") % 50).alias("percent")),
        F.struct((s % 6).cast("int").alias("id"), s.cast("double").alias("percent")),
        F.struct(F.lit(3).alias("id"), (k % 17).cast("double").alias("percent")))
    plat = F.struct(F.struct(F.col("p_type").alias("name")).alias("platform"))
    noplat = F.struct(F.lit(None).cast("struct<name:string>").alias("platform"))
    platforms = F.when(k % 11 == 0, F.lit(None)).otherwise(
        F.when(s % 2 == 0, F.array(plat, noplat)).otherwise(F.array(plat)))
    genres = F.transform(F.split(F.col("p_name"), " "), lambda x: F.struct(x.alias("name")))
    esrb = F.when(k % 3 == 0, F.lit(None)).otherwise(F.struct(F.col("p_brand").alias("name")))
    stores = F.array(
        F.struct(F.struct((s % 3).cast("int").alias("id")).alias("store"),
                 F.format_string("https://store.example/app/%d/x", k).alias("url")),
        F.struct(F.struct(F.lit(1).alias("id")).alias("store"),
                 F.when(k % 4 == 0, F.lit("https://store.example/bundle/9")).otherwise(
                     F.format_string("https://store.example/app/%d/", k * 10)).alias("url")))
    ach = F.when(k % 5 == 0, F.lit(None)).otherwise(
        F.array(F.struct((s % 2).cast("int").alias("achieved")), F.struct(F.lit(1).alias("achieved")),
                F.struct((k % 2).cast("int").alias("achieved"))))
    return p.select(k.alias("id"), released.alias("released"), ratings.alias("ratings"),
                    platforms.alias("platforms"), genres.alias("genres"), esrb.alias("esrb_rating"),
                    stores.alias("stores"), ach.alias("achievements"))


CATALOG_RAW_SQL = """
SELECT p_partkey AS id,
  CASE WHEN p_partkey % 13 = 0 THEN NULL
       ELSE strftime(DATE '1990-01-01' + CAST(p_partkey % 9000 AS INTEGER), '%Y-%m-%d') END AS released,
  [{'id': 5, 'percent': p_retailprice % 50},
   {'id': CAST(p_size % 6 AS INTEGER), 'percent': CAST(p_size AS DOUBLE)},
   {'id': 3, 'percent': CAST(p_partkey % 17 AS DOUBLE)}] AS ratings,
  CASE WHEN p_partkey % 11 = 0 THEN NULL
       WHEN p_size % 2 = 0 THEN [{'platform': {'name': p_type}}, {'platform': NULL}]
       ELSE [{'platform': {'name': p_type}}] END AS platforms,
  string_split(p_name, ' ') AS genre_names,
  CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS esrb_name,
  CASE WHEN p_size % 3 = 1 THEN 'https://store.example/app/' || p_partkey || '/x'
       WHEN p_partkey % 4 = 0 THEN NULL
       ELSE 'https://store.example/app/' || (p_partkey * 10) || '/' END AS store_url_1,
  p_size % 3 = 1 OR true AS in_store_1,
  CASE WHEN p_partkey % 5 = 0 THEN NULL
       ELSE CAST(p_size % 2 = 1 AS INTEGER) + 1 + CAST(p_partkey % 2 = 1 AS INTEGER) END AS n_achieved
FROM part"""


@register("catalog_nested_fields", "P9 P12 P14 P15 P16 P17 P29 S10 F4", fx.cte(c=CATALOG_RAW_SQL) + """
SELECT id AS app_id,
  CAST(year(CAST(released AS DATE)) AS DOUBLE) AS released_year,
  CAST(month(CAST(released AS DATE)) AS DOUBLE) AS released_month,
  CAST(day(CAST(released AS DATE)) AS DOUBLE) AS released_day,
  round(coalesce(list_transform(list_filter(ratings, lambda x: x['id'] = 5), lambda x: x['percent'])[-1], 0.0), 6) AS rating_5_percent,
  round(coalesce(list_transform(list_filter(ratings, lambda x: x['id'] = 4), lambda x: x['percent'])[-1], 0.0), 6) AS rating_4_percent,
  round(coalesce(list_transform(list_filter(ratings, lambda x: x['id'] = 3), lambda x: x['percent'])[-1], 0.0), 6) AS rating_3_percent,
  round(coalesce(list_transform(list_filter(ratings, lambda x: x['id'] = 1), lambda x: x['percent'])[-1], 0.0), 6) AS rating_1_percent,
  coalesce(array_to_string(list_transform(list_filter(platforms, lambda x: x['platform'] IS NOT NULL),
                                          lambda x: x['platform']['name']), '|'), '') AS platforms,
  array_to_string(genre_names, '|') AS genres,
  coalesce(genre_names[1], 'Unknown') AS main_genre,
  coalesce(esrb_name, 'Missing') AS esrb_rating,
  in_store_1 AS sold_in_store_1,
  CAST(n_achieved AS DOUBLE) AS achievements,
  CAST(CAST(regexp_extract(store_url_1, '/app/(\\d+)', 1) AS BIGINT) AS DOUBLE) AS store_app_id
FROM c""")
def q_catalog_nested(spark, d):
    from ludex.sources.ingest import extract_store_id
    c = catalog_raw(spark, d)
    c = cl.date_parts(c, "released", "released")
    # nullable integers are reported as doubles (one representation on both engines)
    return round_doubles(c.select(
        F.col("id").alias("app_id"), *[F.col(x).cast("double").alias(x)
                                       for x in ("released_year", "released_month", "released_day")],
        *cl.pivot_array("ratings", "id", "percent", cl.RATING_KEYS,
                        names=[f"rating_{k}_percent" for k in cl.RATING_KEYS]),
        F.concat_ws("|", cl.names_of("platforms", ["platform", "name"], skip_missing="platform")).alias("platforms"),
        F.concat_ws("|", cl.names_of("genres", ["name"])).alias("genres"),
        cl.first_or(cl.names_of("genres", ["name"])).alias("main_genre"),
        cl.field_or("esrb_rating", "name").alias("esrb_rating"),
        cl.exists_in("stores", lambda x: x["store"]["id"] == 1).alias("sold_in_store_1"),
        cl.count_where("achievements", lambda x: x["achieved"] == 1).cast("double").alias("achievements"),
        extract_store_id("stores").cast("double").alias("store_app_id")))


# ---------------------------------------------------------------- P13
@register("bookmark_map_columns", "P13 S1", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS bookmark_type_k_count FROM events""")
def q_map_columns(spark, d):
    e = fx.table(spark, d, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    keys = cl.map_keys_of(e, "m")
    return e.select("event_id", *cl.map_to_columns("m", keys, "bookmark_type_{}_count"))


# ---------------------------------------------------------------- P19 P20 P21 P22
def geo_tables(spark, d):
    """Country / state / city coordinate tables derived row-locally from ``nation``."""
    n = fx.table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    countries = n.select(F.col("n_nationkey").alias("country"),
                         F.format_string("%d.5,%d.25", "n_nationkey", "n_regionkey").alias("coordinates"))
    states = n.select(F.col("n_nationkey").alias("country"), F.explode(F.array(F.lit(0), F.lit(1))).alias("state")) \
        .select("country", "state", F.format_string("%d.%d,1.5", "country", "state").alias("coordinates"))
    cities = n.select(F.col("n_nationkey").alias("country"), F.lit(0).alias("state"),
                      F.explode(F.sequence(F.lit(0), F.lit(4))).alias("city")) \
        .select("country", "state", "city",
                F.when(F.col("city") == 4, F.lit("1.5")).when(F.col("city") == 3, F.lit("a,b"))
                 .otherwise(F.format_string("-%d.%d,2%d.0", "country", "city", "city")).alias("coordinates"))
    return countries, states, cities


GEO_SQL = fx.cte(
    countries="SELECT n_nationkey AS country, format('{}.5,{}.25', n_nationkey, n_regionkey) AS coordinates FROM nation",
    states="SELECT n_nationkey AS country, s.state, format('{}.{},1.5', n_nationkey, s.state) AS coordinates "
           "FROM nation, (VALUES (0), (1)) s(state)",
    cities="SELECT n_nationkey AS country, 0 AS state, c.city, CASE WHEN c.city = 4 THEN '1.5' WHEN c.city = 3 "
           "THEN 'a,b' ELSE format('-{}.{},2{}.0', n_nationkey, c.city, c.city) END AS coordinates "
           "FROM nation, (VALUES (0), (1), (2), (3), (4)) c(city)",
    u="SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_nationkey END AS country, "
      "CAST(c_custkey % 4 AS INTEGER) AS state, CAST(c_custkey % 9 AS INTEGER) AS city FROM customer")


@register("user_coordinates", "P19 P20 P21 J5 F2", GEO_SQL + """,
j AS (SELECT u.user_id, u.country,
        CASE WHEN s.coordinates IS NOT NULL THEN coalesce(ci.coordinates, s.coordinates) ELSE co.coordinates END AS coordinates
      FROM u LEFT JOIN countries co ON u.country = co.country
             LEFT JOIN states s ON u.country = s.country AND u.state = s.state
             LEFT JOIN cities ci ON u.country = ci.country AND u.state = ci.state AND u.city = ci.city),
p AS (SELECT *, string_split(coordinates, ',') AS parts FROM j)
SELECT user_id, coalesce(CAST(country AS VARCHAR), 'Missing') AS user_country_code,
       coordinates IS NOT NULL AS user_has_coordinates,
       CASE WHEN len(parts) = 2 AND try_cast(parts[1] AS DOUBLE) IS NOT NULL AND try_cast(parts[2] AS DOUBLE) IS NOT NULL
            THEN round(try_cast(parts[1] AS DOUBLE), 6) + 0.0 END AS user_latitude,
       CASE WHEN len(parts) = 2 AND try_cast(parts[1] AS DOUBLE) IS NOT NULL AND try_cast(parts[2] AS DOUBLE) IS NOT NULL
            THEN round(try_cast(parts[2] AS DOUBLE), 6) + 0.0 END AS user_longitude
FROM p""")
def q_coordinates(spark, d):
    countries, states, cities = geo_tables(spark, d)
    c = fx.table(spark, d, "customer")
    u = c.select(F.col("c_custkey").alias("user_id"),
                 F.when(F.col("c_custkey") % 13 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("country"),
                 (F.col("c_custkey") % 4).cast("int").alias("state"),
                 (F.col("c_custkey") % 9).cast("int").alias("city"))
    j = cl.lookup_coordinates(u, countries, states, cities)
    lat, lon = cl.split_coordinates("coordinates")
    return round_doubles(j.select(
        "user_id", F.coalesce(F.col("country").cast("string"), F.lit(cl.MISSING)).alias("user_country_code"),
        F.col("coordinates").isNotNull().alias("user_has_coordinates"),
        lat.alias("user_latitude"), lon.alias("user_longitude")))


@register("invalid_coordinates", "P22", f"""
SELECT user_id, round(user_latitude, 6) AS user_latitude, round(user_longitude, 6) AS user_longitude
FROM (SELECT c_custkey AS user_id, c_acctbal / 50.0 AS user_latitude, c_acctbal / 25.0 AS user_longitude FROM customer)
WHERE user_latitude < -90 OR user_latitude > 90 OR user_longitude < -180 OR user_longitude > 180""")
def q_invalid_geo(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"),
                                              (F.col("c_acctbal") / 50.0).alias("user_latitude"),
                                              (F.col("c_acctbal") / 25.0).alias("user_longitude"))
    return round_doubles(cl.invalid_geo(c, "user_latitude", "user_longitude"))


# ---------------------------------------------------------------- P23 P26 P27 P34 P35
@register("price_discount_features", "P23 P26 P27 P34 P35 P31", """
SELECT l_orderkey AS order_id, l_linenumber AS line,
       round(ln(1 + l_quantity), 6) AS log_quantity,
       round_even((p_retailprice - l_extendedprice / l_quantity) / (p_retailprice + 0.000001), 0) + 0.0 AS game_current_discount,
       CAST(year(l_shipdate) - 1984 AS INTEGER) AS released_year_since_1984,
       CASE WHEN l_tax - 0.04 >= 0 THEN round((l_tax - 0.04) * 60.0, 6) END AS playtime_minutes,
       format('{:.4f}', l_discount) AS score_text,
       CASE WHEN l_discount > -0.00001 AND l_discount <= 0.00001 THEN 'None'
            WHEN l_discount > 0.00001 AND l_discount <= 0.2 THEN 'very low'
            WHEN l_discount > 0.2 AND l_discount <= 0.4 THEN 'low'
            WHEN l_discount > 0.4 AND l_discount <= 0.6 THEN 'medium'
            WHEN l_discount > 0.6 AND l_discount <= 0.8 THEN 'high'
            WHEN l_discount > 0.8 AND l_discount <= 1.0 THEN 'very high' END AS level
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def q_price(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                                "l_extendedprice", "l_shipdate", "l_tax", "l_discount")
    p = fx.table(spark, d, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return round_doubles(j.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"),
        F.log1p("l_quantity").alias("log_quantity"),
        cl.discount(F.col("p_retailprice"), F.col("l_extendedprice") / F.col("l_quantity")).alias("game_current_discount"),
        cl.years_since(F.year("l_shipdate"), 1984).alias("released_year_since_1984"),
        cl.hours_to_minutes(F.col("l_tax") - 0.04).alias("playtime_minutes"),
        cl.fmt4("l_discount").alias("score_text"),
        cl.cut("l_discount").alias("level")))


# ---------------------------------------------------------------- P28 P36
@register("boolean_columns", "P28", """
WITH t AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS a, l_linenumber AS b, CAST(l_linestatus = 'O' AS BIGINT) AS c
           FROM lineitem)
SELECT 'is_returned' AS column_name, (SELECT count(DISTINCT a) = 2 AND min(a) = 0 AND max(a) = 1 FROM t) AS is_bool
UNION ALL SELECT 'line', (SELECT count(DISTINCT b) = 2 AND min(b) = 0 AND max(b) = 1 FROM t)
UNION ALL SELECT 'is_open', (SELECT count(DISTINCT c) = 2 AND min(c) = 0 AND max(c) = 1 FROM t)""")
def q_bool_columns(spark, d):
    li = fx.table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("is_returned"), F.col("l_linenumber").alias("line"),
        (F.col("l_linestatus") == "O").cast("long").alias("is_open"))
    cols = ["is_returned", "line", "is_open"]
    found = set(cl.infer_bool(li, cols))
    return spark.createDataFrame([(c, c in found) for c in cols], "column_name string, is_bool boolean")


@register("harmonized_types", "P36", """
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(p_size AS BIGINT) AS p_size,
       round(p_retailprice, 6) AS p_retailprice, p_name FROM part""")
def q_harmonize(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_name")
    return round_doubles(cl.harmonize(p))


# ---------------------------------------------------------------- P30
@register("vector_to_columns", "P30", "SELECT vec_id, " + ", ".join(
    f"round(CASE WHEN len(embedding) = 64 THEN CAST(embedding[{i + 1}] AS DOUBLE) ELSE 0.0 END, 6) AS emb_{i}"
    for i in range(64)) + " FROM embeddings")
def q_vector_columns(spark, d):
    e = fx.table(spark, d, "embeddings")
    return round_doubles(e.select("vec_id", *cl.flatten_vector("embedding", 64, "emb")))


# ---------------------------------------------------------------- P32 P33
@register("game_display_names", "P33 P32 U2 U3 T1", """
SELECT DISTINCT p_name || ' (ID: ' || p_partkey || ')' AS display_name FROM part WHERE p_name IS NOT NULL""")
def q_display(spark, d):
    p = fx.table(spark, d, "part").select("p_partkey", "p_name").dropna(subset=["p_name"])
    return p.select(cl.display_name("p_name", "p_partkey").alias("display_name")).distinct().orderBy("display_name")


@register("preference_prefix_strip", "P32", """
SELECT DISTINCT 'user_preference_' || n_name AS prefixed, substr('user_preference_' || n_name, 17) AS country_name
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def q_prefix(spark, d):
    c = fx.table(spark, d, "customer").select("c_nationkey")
    n = fx.table(spark, d, "nation").select("n_nationkey", "n_name")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey)  # nation: 25 rows
    pref = F.concat(F.lit("user_preference_"), F.col("n_name"))
    return j.select(pref.alias("prefixed"), cl.strip_prefix(pref, "user_preference_").alias("country_name")).distinct()


# ---------------------------------------------------------------- P18
@register("flatten_owned_games", "P18", """
SELECT user_id, g.appid AS app_id, coalesce(g.playtime_forever, 0) AS playtime_forever
FROM (SELECT l_orderkey AS user_id,
             unnest(CASE WHEN l_linenumber = 1 THEN []
                         ELSE [{'appid': l_partkey, 'playtime_forever': CAST(l_quantity AS BIGINT)},
                               {'appid': l_suppkey, 'playtime_forever': NULL}] END) AS g
      FROM lineitem)""")
def q_flatten(spark, d):
    """Row-local nested records (each line plays the user record with its owned games)."""
    li = fx.table(spark, d, "lineitem")
    game = "struct<appid:bigint, playtime_forever:bigint>"
    owned = F.when(F.col("l_linenumber") == 1, F.array().cast(f"array<{game}>")).otherwise(F.array(
        F.struct(F.col("l_partkey").alias("appid"), F.col("l_quantity").cast("long").alias("playtime_forever")),
        F.struct(F.col("l_suppkey").alias("appid"), F.lit(None).cast("long").alias("playtime_forever"))))
    users = li.select(F.col("l_orderkey").alias("user_id"), owned.alias("owned_games"))
    return cl.flatten_users(users, "user_id", "owned_games")
