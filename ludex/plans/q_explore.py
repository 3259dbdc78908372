"""Registered queries: exploratory tables (V1-V7, T3, T4) and incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.operators import explore as ex
from ludex.operators import profile as pf
from ludex.plans import fixtures as fx
from ludex.plans.q_model import item_vectors, mean_vectors
from ludex.plans.q_relevance import RELEVANCE_SQL_BODY, relevance_table, staged_relevance
from ludex.plans.registry import DIGITS, register, round_doubles
from ludex.session import cut_lineage, scratch_path

I, G = fx.INTERACTIONS_SQL, fx.GAMES_SQL


def facts(spark, d):
    """Relevance rows with the game's genre list (interactions JOIN games)."""
    g = fx.games(spark, d).select("app_id", "game_genres")
    return relevance_table(spark, d).join(g, "app_id")


REL_G = RELEVANCE_SQL_BODY.rstrip() + """,
f AS (SELECT r.*, string_split(p_name, ' ') AS game_genres FROM rel r JOIN part ON r.app_id = p_partkey)
"""


@register("genre_game_counts", "V1 W4 A10", REL_G + """
SELECT genre, count(*) AS n_games FROM (
  SELECT DISTINCT app_id, unnest(game_genres) AS genre FROM (SELECT DISTINCT app_id, game_genres FROM f))
GROUP BY genre""")
def q_genre_counts(spark, d):
    return ex.genre_counts(facts(spark, d), "app_id", "game_genres")


@register("genre_relevance", "V2 J10 A11", REL_G + """
SELECT genre, count(*) AS n_rows, round(avg(relevance_score), 6) AS mean_relevance
FROM (SELECT relevance_score, unnest(list_distinct(game_genres)) AS genre FROM f) GROUP BY genre""")
def q_genre_relevance(spark, d):
    return round_doubles(ex.genre_relevance(facts(spark, d), "game_genres", "relevance_score"))


@register("genre_preference_distribution", "V3 U5 A1 A17", REL_G + """,
words AS (SELECT DISTINCT unnest(game_genres) AS genre FROM f),
pu AS (SELECT f.user_id, w.genre, avg(CAST(list_contains(f.game_genres, w.genre) AS INTEGER)) AS v
       FROM f, words w GROUP BY f.user_id, w.genre),
s AS (SELECT genre, count(v) AS n, min(v) AS min, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) AS q3, max(v) AS max FROM pu GROUP BY genre)
SELECT genre AS preference, n, round(min, 6) AS min, round(q1, 6) AS q1, round(median, 6) AS median,
       round(q3, 6) AS q3, round(max, 6) AS max, round(q1 - 1.5 * (q3 - q1), 6) AS lo_fence,
       round(q3 + 1.5 * (q3 - q1), 6) AS hi_fence,
       (SELECT count(*) FROM pu WHERE pu.genre = s.genre AND (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)))
         AS n_outliers
FROM s""")
def q_pref_dist(spark, d):
    from ludex.operators.encode import MultiLabel
    f = facts(spark, d)
    ml = MultiLabel.fit(f, "game_genres", "pref", unknown=False)
    wide = ml.apply(f.select("user_id", "game_genres"))
    cols = [c for c in wide.columns if c.startswith("pref_")]
    prefs = pf.user_profile_table(wide, "user_id", cols, prefix="user_preference_")
    return round_doubles(ex.preference_distribution(prefs, "user_id", "user_preference_pref_"))


@register("embedding_genre_level_table", "V4 J4 P29 P30 P31", REL_G + """,
iv AS (SELECT p_partkey AS app_id, CAST(e.embedding AS DOUBLE[]) AS v
       FROM part JOIN embeddings e ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
uvec AS (SELECT user_id, """ + ", ".join(f"avg(v[{k + 1}]) AS u{k}" for k in range(64)) + """
         FROM inter JOIN iv USING (app_id) GROUP BY user_id)
SELECT f.user_id, f.app_id, game_genres[1] AS main_genre,
  CASE WHEN relevance_score > -0.00001 AND relevance_score <= 0.00001 THEN 'None'
       WHEN relevance_score > 0.00001 AND relevance_score <= 0.2 THEN 'very low'
       WHEN relevance_score > 0.2 AND relevance_score <= 0.4 THEN 'low'
       WHEN relevance_score > 0.4 AND relevance_score <= 0.6 THEN 'medium'
       WHEN relevance_score > 0.6 AND relevance_score <= 0.8 THEN 'high'
       WHEN relevance_score > 0.8 AND relevance_score <= 1.0 THEN 'very high' END AS relevance_level,
  round(relevance_score, 6) AS relevance_score,
""" + ", ".join(f"round(iv.v[{k + 1}], 6) AS game_emb_{k}, round(u{k}, 6) AS user_emb_{k}" for k in range(64)) + """
FROM f JOIN iv USING (app_id) JOIN uvec USING (user_id)""")
def q_embedding_table(spark, d):
    # the interactions are made once, for the rows and for the users' vectors; without prices, which the table does not hold
    r = staged_relevance(spark, d)
    f = r.join(fx.games(spark, d).select("app_id", "game_genres"), "app_id")
    items = item_vectors(spark, d)
    uv = mean_vectors(r, items).select("user_id", F.col("features").alias("user_emb"))
    return ex.embedding_table(f, items.select("app_id", F.col("features").alias("game_emb")), uv, ["user_id", "app_id"],
                              "game_genres", "relevance_score", dim=64, digits=DIGITS)


@register("pca_two_components", "V5")
def q_pca(spark, d):
    c = fx.table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("avg_price"),
                                                             F.count(F.lit(1)).alias("n_orders"))
    df = c.join(o, c.c_custkey == o.o_custkey).select("c_custkey", "c_acctbal", "c_nationkey", "avg_price", "n_orders")
    cols = ["c_acctbal", "c_nationkey", "avg_price", "n_orders"]
    res, model = ex.pca(df, cols, 2)
    ev = [float(x) for x in model.explainedVariance.toArray()]
    means = res.agg(F.avg(F.col("pca")[0]).alias("m0"), F.avg(F.col("pca")[1]).alias("m1"),
                    F.count(F.lit(1)).alias("n")).first()
    return spark.createDataFrame([(i, ev[i], [means["m0"], means["m1"]][i], means["n"]) for i in range(2)],
                                 "component int, explained_variance double, mean_score double, n_rows long")


@register("density_clusters_sample", "V6 T4 R4 N2")
def q_dbscan(spark, d, eps: float = 0.5, min_pts: int = 112):
    """Cluster sizes of a fixed-size sample of users by their standardised rank-2 factors."""
    from ludex.operators.scale import Standardize
    from ludex.plans.q_model import als_train
    _, _, model = als_train(spark, d, rank=2)
    f = model.user_factors().select("user_id", *[F.col("features")[i].cast("double").alias(f"x{i}") for i in range(2)])
    sample = cut_lineage(ex.sample_n(f, 10000, "user_id"))
    labels = ex.density_clusters(Standardize.fit(sample, ["x0", "x1"]).apply(sample), "user_id", ["x0", "x1"], eps, min_pts)
    return labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_points"))


@register("shapley_attributions", "V7 R14 T4")
def q_shapley(spark, d):
    """Mean absolute attributions of every input of the MLP (a padded list counts by place), on test rows."""
    from ludex.operators import rank as rk
    from ludex.plans.q_model import M, mlp_parts, mlp_rows, mlp_wide
    n, seed = 200, 43
    r, games, roles, card = mlp_parts(spark, d)
    w = rk.init_mlp(roles, card, seed=42)
    row_key = F.col("user_id") * 1_000_000 + F.col("app_id")
    # both samples are drawn of all rows by their keys alone; vectors are attached to the rows of the drawn keys
    test = r.filter(F.col("user_id") % M == 0)
    keys = cut_lineage(test.select("user_id", "app_id").join(games.select("app_id"), "app_id").select("user_id", "app_id", row_key.alias("row_key")))
    drawn = cut_lineage(ex.sample_n(keys, n, "row_key").unionByName(ex.sample_n(keys, ex.BACKGROUND, "row_key", seed)).distinct())   # at most both samples
    users = cut_lineage(test.join(F.broadcast(drawn.select("user_id").distinct()), "user_id", "left_semi"))
    x, own = mlp_rows(users, games)
    x = x.join(F.broadcast(drawn.select("user_id", "app_id")), ["user_id", "app_id"], "left_semi")
    x = cut_lineage(mlp_wide(x, own, roles).withColumn("row_key", row_key))
    width = {c: x.select(F.coalesce(F.max(F.size(c)), F.lit(0))).first()[0] for c in roles["multi"]}      # padded: one size
    places = {c: [f"{c}_dim_{k}" for k in range(n)] for c, n in width.items()}
    x = x.withColumns({name: F.col(c)[k] for c, names in places.items() for k, name in enumerate(names)})
    features = [*roles["single"], *(name for names in places.values() for name in names), *roles["num"], *roles["bool"], *roles["cf"]]

    def score(df):
        lists = {c: F.array(*names).cast("array<long>") for c, names in places.items()}
        whole = df.withColumns(lists).select(*[c for c in df.columns if c not in features or c in roles["single"]], *lists,
                                             *roles["num"], *roles["bool"], *roles["cf"])
        return rk.score_mlp(whole, roles, w)

    sh = ex.shapley_sample(ex.sample_n(x, n, "row_key"), x, features, score, "row_key", m=20, seed=seed)
    return sh.groupBy("feature").agg(F.avg(F.abs("shapley")).alias("mean_abs_shapley"),
                                     F.count(F.lit(1)).alias("n_rows"))


@register("top_active_users_rows", "T3", fx.cte(inter=I) + """
SELECT user_id, app_id FROM inter WHERE user_id IN (
  SELECT user_id FROM inter GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 10)""")
def q_top_users(spark, d):
    return ex.top_groups(fx.interactions(spark, d).select("user_id", "app_id"), "user_id", 10)


@register("seeded_fixed_size_sample", "T4")
def q_sample(spark, d):
    s = ex.sample_n(fx.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1000, "o_orderkey")
    return s


EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                             T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
                             T.StructField("day", T.StringType())])


@register("incremental_ingest_events", "S7 S11", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_events, CAST(sum(user_id) AS BIGINT) AS user_sum
FROM events GROUP BY 1""")
def q_ingest(spark, d):
    """Three landings; the second overlaps the first (its ids land again), the third
    goes into the same table from another folder under a checkpoint of its own."""
    from ludex.streaming.landing import ingest_incremental, land_by_day, read_ingested
    e = fx.table(spark, d, "events")
    land, out, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "ingested"), scratch_path(spark, "ckpt")
    days = sorted(r[0] for r in e.select(F.to_date("ts").cast("string")).distinct().collect())
    half = days[len(days) // 2]
    land_by_day(e.filter(F.to_date("ts") < F.lit(half)), "ts", land)
    ingest_incremental(spark, land, out, ckpt, EVENT_SCHEMA, key="event_id")        # first run
    ingest_incremental(spark, land, out, ckpt, EVENT_SCHEMA, key="event_id")        # restart: nothing new
    later = e.filter(F.to_date("ts") >= F.lit(half))
    again = e.filter((F.to_date("ts") < F.lit(half)) & (F.col("event_id") % 3 == 0))
    land_by_day(later.filter("event_id % 2 = 0").unionByName(again), "ts", land)     # new files, some ids again
    ingest_incremental(spark, land, out, ckpt, EVENT_SCHEMA, key="event_id")        # picks up the rest
    other = scratch_path(spark, "landing")
    land_by_day(later, "ts", other)                                                  # a second source, half of it known
    ingest_incremental(spark, other, out, scratch_path(spark, "ckpt"), EVENT_SCHEMA, key="event_id")
    got = read_ingested(spark, out, EVENT_SCHEMA)
    return got.groupBy("day").agg(F.count(F.lit(1)).alias("n_events"), F.sum("user_id").alias("user_sum"))


@register("incremental_latest_snapshot", "S7 W4", """
SELECT user_id, event_id, event_type FROM (
  SELECT user_id, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def q_snapshot(spark, d):
    """Resumable ingest in two landings with an upsert of the latest event per user."""
    from ludex.streaming.landing import ingest_incremental, land_by_day, read_snapshot
    e = fx.table(spark, d, "events")
    land, out, ckpt = scratch_path(spark, "landing"), scratch_path(spark, "ingested"), scratch_path(spark, "ckpt")
    snap = scratch_path(spark, "snapshot")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    land_by_day(e.filter(F.col("ts") < cut), "ts", land)
    ingest_incremental(spark, land, out, ckpt, EVENT_SCHEMA, key="event_id", snapshot=(snap, "user_id", ["ts", "event_id"]))
    land_by_day(e.filter(F.col("ts") >= cut), "ts", land)
    ingest_incremental(spark, land, out, ckpt, EVENT_SCHEMA, key="event_id", snapshot=(snap, "user_id", ["ts", "event_id"]))
    return read_snapshot(spark, snap).select("user_id", "event_id", "event_type")
