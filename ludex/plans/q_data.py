"""Registered queries: sources and sinks (S*), joins (J*), profiles (A*), set ops (U*)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.operators import assemble as asm
from ludex.operators import profile as pf
from ludex.plans import fixtures as fx
from ludex.plans.registry import DIGITS, register, round_doubles
from ludex.session import scratch_path
from ludex.sources import ingest, io

I, G, U = fx.INTERACTIONS_SQL, fx.GAMES_SQL, fx.USERS_SQL


# ------------------------------------------------------------------ sources
@register("keyed_json_roundtrip", "S1", """
SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events""")
def q_keyed_json(spark, d):
    e = fx.table(spark, d, "events")
    path = scratch_path(spark, "keyed-json")
    rec = F.struct("user_id", "event_type", "value")
    e.select(F.to_json(F.create_map(F.col("event_id").cast("string"), rec)).alias("value")) \
        .write.mode("overwrite").text(path)
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                           T.StructField("value", T.DoubleType())])
    out = io.read_keyed_json(spark, path, schema, key="event_id")
    return round_doubles(out.select(F.col("event_id").cast("long").alias("event_id"), "user_id", "event_type", "value"))


@register("json_lines_roundtrip", "S2", """
SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer""")
def q_json_lines(spark, d):
    c = fx.table(spark, d, "customer")
    path = scratch_path(spark, "json-lines")
    c.write.mode("overwrite").json(path)
    return round_doubles(io.read_json_lines(spark, path, c.schema))


@register("json_array_capped", "S2", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT (SELECT (count(*) * 2) // 3 FROM orders)""")
def q_json_array(spark, d):
    """All orders written as JSON array files, read back by byte ranges up to a cap on the records."""
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "json-arrays")
    io.write_json_arrays(o, path, ["o_orderkey"])
    return round_doubles(io.read_json_array(spark, path, o.schema, max_records=o.count() * 2 // 3))


@register("csv_typed_subset_roundtrip", "S3", """
SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice FROM orders""")
def q_csv(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    path = scratch_path(spark, "csv")
    io.write_csv(o, path)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                           T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderpriority", T.StringType())])
    return round_doubles(io.read_csv(spark, path, schema, ["o_orderkey", "o_custkey", "o_totalprice"]))


@register("parquet_stage_roundtrip", "S4 S5", fx.cte(inter=I) + """
SELECT user_id, app_id, round(playtime_forever, 6) AS playtime_forever, achievements,
       CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM inter""")
def q_parquet_stage(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id", "playtime_forever", "achievements") \
        .withColumn("split", F.when(F.col("user_id") % 5 == 0, "test").otherwise("train"))
    path = scratch_path(spark, "stage")
    io.write_stage(i, path, partition_by=["split"])
    return round_doubles(io.read_stage(spark, path).select("user_id", "app_id", "playtime_forever",
                                                           "achievements", "split"))


@register("game_lookup", "S6 W4", fx.cte(inter=I) + """
SELECT CAST(l_partkey AS INTEGER) AS app_id, min(p_name) AS game_name
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey""")
def q_lookup(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_partkey")
    p = fx.table(spark, d, "part").select("p_partkey", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return io.build_lookup(j, "l_partkey", "p_name")


HREF_RE = 'href="([^"]*)"'


@register("page_links", "S8", """
SELECT DISTINCT link, regexp_extract(link, '^/([^/?#]+)', 1) AS kind
FROM (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages)""")
def q_page_links(spark, d):
    p = fx.table(spark, d, "pages").select("html")
    links = p.select(F.explode(F.regexp_extract_all("html", F.lit(HREF_RE), 1)).alias("link")).distinct()
    return links.select("link", F.regexp_extract("link", r"^/([^/?#]+)", 1).alias("kind"))


@register("profile_links", "S8", r"""
WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(
  'see <a href="https://players.example/' || CASE WHEN page_id % 3 = 0 THEN 'id/p' || page_id % 50 WHEN page_id % 3 = 1
    THEN 'profiles/' || lpad(CAST(page_id % 70 AS VARCHAR), 17, '7') ELSE 'profiles/' || page_id END || '">x</a> ' || html,
  'https?://players\.example/(?:id|profiles)/[^/"''<>\s]+')) AS link FROM pages)
SELECT link, split_part(link, '/', 4) AS kind, split_part(link, '/', 5) AS profile FROM l
WHERE split_part(link, '/', 4) = 'id' OR regexp_matches(split_part(link, '/', 5), '^[0-9]{17}$')""")
def q_profile_links(spark, d):
    """Profile links of pages that each begin with one (some repeated, some with an id that is not valid)."""
    from ludex.sources.ingest import extract_profile_links
    n = F.col("page_id")
    path = F.when(n % 3 == 0, F.concat(F.lit("id/p"), n % 50)).when(n % 3 == 1, F.concat(F.lit("profiles/"), F.lpad((n % 70).cast("string"), 17, "7"))) \
        .otherwise(F.concat(F.lit("profiles/"), n))
    p = fx.table(spark, d, "pages").select(F.concat(F.lit('see <a href="https://players.example/'), path, F.lit('">x</a> '), "html").alias("html"))
    return extract_profile_links(p, "players.example")


URL_RE = r"^https?://([^/]+)/([a-z]{2})/([0-9]+)"


@register("page_url_parts", "S8 P3", f"""
SELECT page_id, regexp_extract(url, '{URL_RE}', 1) AS host, regexp_extract(url, '{URL_RE}', 2) AS lang,
       CAST(regexp_extract(url, '{URL_RE}', 3) AS BIGINT) AS page_number
FROM pages WHERE regexp_matches(url, '{URL_RE}')""")
def q_url_parts(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", "url").filter(F.col("url").rlike(URL_RE))
    return p.select("page_id", F.regexp_extract("url", URL_RE, 1).alias("host"),
                    F.regexp_extract("url", URL_RE, 2).alias("lang"),
                    F.regexp_extract("url", URL_RE, 3).cast("long").alias("page_number"))


@register("page_number_gaps", "S9 J7", f"""
WITH n AS (SELECT DISTINCT CAST(regexp_extract(url, '{URL_RE}', 3) AS BIGINT) AS page_number
           FROM pages WHERE regexp_matches(url, '{URL_RE}'))
SELECT r.range AS page_number FROM range(1, (SELECT max(page_number) FROM n) + 1) r
WHERE r.range NOT IN (SELECT page_number FROM n)""")
def q_gaps(spark, d):
    p = fx.table(spark, d, "pages").select("url").filter(F.col("url").rlike(URL_RE))
    nums = p.select(F.regexp_extract("url", URL_RE, 3).cast("long").alias("page_number"))
    return ingest.missing_sequence(spark, nums, "page_number")


@register("dedup_repeat_ingest", "S11 U1", """
SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-12'""")
def q_dedup(spark, d):
    """A re-fetched batch (days 10+ plus a repeated page of days 10-15) minus
    the ids processed before (days < 12): every id once, nothing already done."""
    e = fx.table(spark, d, "events").select("event_id", "user_id", "ts")
    fetched = e.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).unionByName(
        e.filter((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
                 & (F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))))
    done = e.filter(F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))
    return ingest.dedup_ingest(fetched, done, "event_id").select("event_id", "user_id")


# ------------------------------------------------------------------ joins
@register("facts_assembled", "J1 W4 P2", fx.cte(inter=I, g=G) + """
SELECT i.user_id, i.app_id, round(i.playtime_forever, 6) AS playtime_forever, g.game_name, g.game_type,
       round(g.game_initial_price, 6) AS game_initial_price, m.n_suppliers
FROM inter i JOIN g ON i.app_id = g.app_id
JOIN (SELECT l_partkey AS sk, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY l_partkey) m
  ON i.app_id = m.sk""")
def q_facts(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id", "playtime_forever")
    g = fx.games(spark, d).select(F.col("app_id").alias("game_key"), "game_name", "game_type", "game_initial_price")
    m = fx.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("sk")) \
        .agg(F.count_distinct("l_suppkey").alias("n_suppliers"))
    out = asm.assemble_facts(i, g, m, inter_key="app_id", catalog_key="game_key", market_key="sk")
    return round_doubles(out)


@register("facts_with_user_location", "J2 J5", fx.cte(inter=I, u=U) + """
SELECT i.user_id, i.app_id, u.user_country_code, round(u.user_latitude, 6) AS user_latitude
FROM inter i LEFT JOIN u ON i.user_id = u.user_id""")
def q_user_location(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id")
    u = fx.users(spark, d).select("user_id", "user_country_code", "user_latitude")
    return round_doubles(asm.attach(i, u, "user_id"))


@register("attach_embeddings_default", "J3 P30", fx.cte(inter=I) + """
SELECT i.user_id, i.app_id,
       """ + ", ".join(f"round(CASE WHEN len(e.embedding) = 64 THEN CAST(e.embedding[{k + 1}] AS DOUBLE) ELSE 0.0 END, 6) AS emb_{k}"
                         for k in range(64)) + """,
       64 AS emb_len,
       e.embedding IS NOT NULL AS hit
FROM inter i LEFT JOIN embeddings e ON i.app_id % 500 = e.vec_id AND i.user_id % 10 = e.label""")
def q_attach_emb(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id") \
        .withColumn("slot", F.col("app_id") % 500).withColumn("label", (F.col("user_id") % 10).cast("int"))
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("slot"), "label", "embedding")
    hit = i.join(e.select("slot", "label").withColumn("hit", F.lit(True)), ["slot", "label"], "left")
    j = asm.attach_embeddings(hit, e, ["slot", "label"], "embedding", 64, each=lambda v: [      # rounded once a vector
        *[F.round(v[k].cast("double"), DIGITS).alias(f"emb_{k}") for k in range(64)], F.size(v).alias("emb_len")])
    return j.select("user_id", "app_id", *[f"emb_{k}" for k in range(64)], "emb_len", F.coalesce(F.col("hit"), F.lit(False)).alias("hit"))


@register("features_join_relevance", "J4 U3", fx.cte(inter=I) + """
SELECT i.user_id, i.app_id, round(i.price_mean, 6) AS price_mean, c.n_lines
FROM (SELECT DISTINCT user_id, app_id, price_mean FROM inter) i
JOIN (SELECT o_custkey AS user_id, l_partkey AS app_id, count(*) AS n_lines
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) c USING (user_id, app_id)""")
def q_join_emb(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id", "price_mean")
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("user_id"),
                                                         F.col("l_partkey").alias("app_id")).count() \
        .withColumnRenamed("count", "n_lines")
    return round_doubles(asm.join_embeddings(i, c, ["user_id", "app_id"]))


@register("train_known_games_semi", "J6", fx.cte(inter=I) + f"""
SELECT user_id, app_id FROM inter
WHERE app_id IN (SELECT p_partkey FROM part WHERE p_partkey % {fx.TRAIN_MOD} <> 0)""")
def q_semi(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id")
    known = fx.table(spark, d, "part").filter(F.col("p_partkey") % fx.TRAIN_MOD != 0) \
        .select(F.col("p_partkey").alias("app_id"))
    return asm.semi(i, known, "app_id")


@register("games_unseen_by_test_users", "J7", fx.cte(inter=I) + """
SELECT p_partkey AS app_id FROM part
WHERE NOT EXISTS (SELECT 1 FROM inter WHERE inter.app_id = part.p_partkey AND inter.user_id % 5 = 0)""")
def q_anti(spark, d):
    seen = fx.interactions(spark, d).filter(F.col("user_id") % 5 == 0).select("app_id")
    seen = seen.unionByName(spark.range(1).select(F.lit(None).cast("long").alias("app_id")))  # a null key
    games = fx.table(spark, d, "part").select(F.col("p_partkey").alias("app_id"))
    return asm.anti(games, seen, "app_id")


# ------------------------------------------------------------------ aggregates
@register("median_latitude_by_country", "A2", fx.cte(u=U) + """
SELECT user_country_code, round(median(user_latitude), 6) AS user_latitude_median FROM u GROUP BY 1""")
def q_median(spark, d):
    return round_doubles(pf.median(fx.users(spark, d), "user_latitude", "user_country_code"))


@register("mode_quantity_by_flag", "A3", """
SELECT l_returnflag, l_quantity_mode FROM (
  SELECT l_returnflag, l_quantity AS l_quantity_mode,
         row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS rn
  FROM lineitem GROUP BY l_returnflag, l_quantity) WHERE rn = 1""")
def q_mode(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_returnflag", "l_quantity")
    return pf.mode_min(li, "l_quantity", "l_returnflag")


@register("totalprice_quantiles_by_priority", "A4", """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 6) AS o_totalprice_q05,
       round(quantile_cont(o_totalprice, 0.95), 6) AS o_totalprice_q95 FROM orders GROUP BY 1""")
def q_quantiles(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    return round_doubles(pf.quantiles(o, "o_totalprice", [0.05, 0.95], "o_orderpriority"))


@register("column_cardinality", "A5", fx.cte(g=G) + """
SELECT 'game_type' AS column_name, count(DISTINCT game_type) AS n_distinct FROM g
UNION ALL SELECT 'game_brand', count(DISTINCT game_brand) FROM g
UNION ALL SELECT 'game_size', count(DISTINCT game_size) FROM g
UNION ALL SELECT 'game_genres', count(DISTINCT x) FROM (SELECT unnest(game_genres) AS x FROM g)""")
def q_cardinality(spark, d):
    return pf.cardinality(fx.games(spark, d), ["game_type", "game_brand", "game_size"], ["game_genres"])


@register("duplicate_key_count", "A6", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, l_suppkey)""")
def q_dup_count(spark, d):
    return pf.duplicate_count(fx.table(spark, d, "lineitem"), ["l_partkey", "l_suppkey"])


@register("duplicated_key_rows", "A7", """
SELECT l_orderkey, l_linenumber FROM lineitem
WHERE (l_partkey, l_suppkey) IN (SELECT (l_partkey, l_suppkey) FROM lineitem GROUP BY 1 HAVING count(*) > 1)""")
def q_dup_rows(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return pf.duplicated_rows(li, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@register("null_profile_users", "A8", fx.cte(u=U) + """
SELECT column_name, n_null FROM (
  SELECT 'user_id' AS column_name, CAST(count_if(user_id IS NULL) AS BIGINT) AS n_null FROM u
  UNION ALL SELECT 'user_country_code', CAST(count_if(user_country_code IS NULL) AS BIGINT) FROM u
  UNION ALL SELECT 'user_latitude', CAST(count_if(user_latitude IS NULL) AS BIGINT) FROM u
  UNION ALL SELECT 'user_longitude', CAST(count_if(user_longitude IS NULL) AS BIGINT) FROM u
  UNION ALL SELECT 'user_created', CAST(count_if(user_created IS NULL) AS BIGINT) FROM u)""")
def q_null_profile(spark, d):
    u = fx.users(spark, d)
    return pf.null_profile(u, ["user_id", "user_country_code", "user_latitude", "user_longitude", "user_created"])


def _describe_sql(cols, src):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, round(CAST(min({c}) AS DOUBLE), 6) AS min,
  round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
  round(quantile_cont({c}, 0.75), 6) AS q75, round(CAST(max({c}) AS DOUBLE), 6) AS max FROM {src}""")
    return "\nUNION ALL ".join(parts)


DESCRIBE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("describe_lineitem", "A9", _describe_sql(DESCRIBE_COLS, "lineitem"))
def q_describe(spark, d):
    return round_doubles(pf.describe(fx.table(spark, d, "lineitem"), DESCRIBE_COLS))


@register("genre_value_counts", "A10", fx.cte(g=G) + """
SELECT game_genres, count(*) AS n FROM (SELECT unnest(game_genres) AS game_genres FROM g) GROUP BY 1""")
def q_value_counts(spark, d):
    return pf.value_counts(fx.games(spark, d), "game_genres", explode=True)


@register("type_value_counts", "A10", "SELECT p_type AS game_type, count(*) AS n FROM part GROUP BY 1")
def q_value_counts_scalar(spark, d):
    return pf.value_counts(fx.games(spark, d), "game_type")


SKEW_FROM = [("orders", "o_totalprice"), ("customer", "c_acctbal"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"),
             ("events", "value"), ("documents", "n_chars")]
SKEW_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("skewness_table", "A12 N5", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(skewness({c}), 6) AS skewness FROM lineitem" for c in SKEW_COLS))
def q_skew(spark, d):
    return round_doubles(pf.skew_table(fx.table(spark, d, "lineitem"), SKEW_COLS))


@register("skewed_columns", "N5", "SELECT column_name FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, skewness({c}) AS s FROM {t}" for t, c in SKEW_FROM) + ") WHERE abs(s) > 0.5")
def q_skewed(spark, d):
    """Columns of orders and of their customers' balances whose skewness says that they want a power transform."""
    from ludex.operators.scale import skewed_columns
    names = [n for t, c in SKEW_FROM for n in skewed_columns(fx.table(spark, d, t).select(c), [c], 0.5)]
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@register("mean_std_table", "A13", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem"
    for c in SKEW_COLS))
def q_mean_std(spark, d):
    return round_doubles(pf.mean_std(fx.table(spark, d, "lineitem"), SKEW_COLS))


@register("brand_cumulative_share", "A14 A10", fx.cte(inter=I) + """
SELECT p_brand AS game_brand, n, round(sum(n) OVER (ORDER BY n DESC, p_brand ROWS UNBOUNDED PRECEDING)
                                       / sum(n) OVER (), 6) AS cum_share
FROM (SELECT p_brand, count(*) AS n FROM inter JOIN part ON app_id = p_partkey GROUP BY p_brand)""")
def q_cum_share(spark, d):
    i = fx.interactions(spark, d).select("app_id")
    g = fx.games(spark, d).select("app_id", "game_brand")
    counts = pf.value_counts(i.join(g, "app_id"), "game_brand")
    return round_doubles(pf.cumulative_share(counts, "game_brand"))


@register("game_mean_inputs", "A16", fx.cte(inter=I) + """
SELECT app_id, round(coalesce(avg(playtime_forever), 0.0), 6) AS playtime_forever_mean,
       round(coalesce(avg(achievements), 0.0), 6) AS achievements_mean FROM inter GROUP BY app_id""")
def q_game_means(spark, d):
    return round_doubles(pf.game_means(fx.interactions(spark, d), "app_id", ["playtime_forever", "achievements"]))


@register("box_stats_totalprice", "A17", """
WITH s AS (SELECT o_orderpriority, count(o_totalprice) AS n, min(o_totalprice) AS min,
             quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
             quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max FROM orders GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo_fence, q3 + 1.5 * (q3 - q1) AS hi_fence FROM s)
SELECT f.o_orderpriority, n, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, round(max, 6) AS max, round(lo_fence, 6) AS lo_fence, round(hi_fence, 6) AS hi_fence,
       (SELECT count(*) FROM orders o WHERE o.o_orderpriority = f.o_orderpriority
          AND (o.o_totalprice < lo_fence OR o.o_totalprice > hi_fence)) AS n_outliers
FROM f""")
def q_box(spark, d):
    o = fx.table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    return round_doubles(pf.box_stats(o, "o_totalprice", "o_orderpriority"))


@register("histogram_totalprice", "A18", """
WITH b AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx, (max(o_totalprice) - min(o_totalprice)) / 10 AS w
           FROM orders)
SELECT CAST(least(floor((o_totalprice - mn) / w), 9) AS INTEGER) AS bin,
       round(mn + least(floor((o_totalprice - mn) / w), 9) * w, 6) AS lower,
       round(mn + (least(floor((o_totalprice - mn) / w), 9) + 1) * w, 6) AS upper, count(*) AS n
FROM orders, b WHERE o_totalprice IS NOT NULL GROUP BY 1, 2, 3""")
def q_hist(spark, d):
    return round_doubles(pf.histogram(fx.table(spark, d, "orders").select("o_totalprice"), "o_totalprice", 10))


@register("users_with_min_rows", "A21", fx.cte(inter=I) + """
SELECT user_id, app_id FROM inter WHERE user_id IN (SELECT user_id FROM inter GROUP BY 1 HAVING count(*) >= 20)""")
def q_min_rows(spark, d):
    return pf.min_rows(fx.interactions(spark, d).select("user_id", "app_id"), "user_id", 20)


@register("max_list_length", "A22", fx.cte(g=G) + "SELECT CAST(max(len(game_genres)) AS INTEGER) AS pad_width FROM g")
def q_max_len(spark, d):
    return spark.range(1).select(F.lit(pf.max_list_length(fx.games(spark, d), "game_genres")).alias("pad_width"))


# ------------------------------------------------------------------ set ops / reshape
@register("union_by_name_splits", "U1 U2", fx.cte(u=U) + """
SELECT user_id, user_country_code, NULL::DOUBLE AS user_latitude FROM u WHERE user_id % 5 = 0
UNION ALL SELECT user_id, NULL, round(user_latitude, 6) FROM u WHERE user_id % 5 <> 0 AND user_latitude IS NOT NULL""")
def q_union(spark, d):
    u = fx.users(spark, d)
    a = u.filter(F.col("user_id") % 5 == 0).select("user_id", "user_country_code")
    b = u.filter(F.col("user_id") % 5 != 0).select("user_id", "user_latitude").dropna(subset=["user_latitude"])
    return round_doubles(pf.union_by_name(a, b).select("user_id", "user_country_code", "user_latitude"))


@register("unseen_test_brands", "U4", f"""
SELECT DISTINCT p_brand AS game_brand FROM part WHERE p_partkey % {fx.TRAIN_MOD} = 0
EXCEPT SELECT p_brand FROM part WHERE p_partkey % {fx.TRAIN_MOD} <> 0 AND p_brand <> '{fx.HELD_OUT_BRAND}'""")
def q_unseen(spark, d):
    g = fx.games(spark, d)
    train = g.filter((F.col("app_id") % fx.TRAIN_MOD != 0) & (F.col("game_brand") != fx.HELD_OUT_BRAND))
    test = g.filter(F.col("app_id") % fx.TRAIN_MOD == 0)
    return pf.unseen_values(train, test, "game_brand")


@register("melt_user_means", "U5 A1", fx.cte(inter=I) + """
SELECT user_id, variable, round(value, 6) AS value FROM (
  SELECT user_id, 'mean_playtime' AS variable, avg(playtime_forever) AS value FROM inter GROUP BY 1
  UNION ALL SELECT user_id, 'mean_achievements', avg(achievements) FROM inter GROUP BY 1)""")
def q_melt(spark, d):
    i = fx.interactions(spark, d)
    wide = pf.user_profile_table(i, "user_id", ["playtime_forever", "achievements"], prefix="",
                                 names={"playtime_forever": "mean_playtime", "achievements": "mean_achievements"})
    return round_doubles(pf.melt(wide, ["user_id"], ["mean_playtime", "mean_achievements"]))
