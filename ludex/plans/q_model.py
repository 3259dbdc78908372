"""Registered queries: recommendations (R11, R12, R19, E2), ALS (A19, R4-R8), rankers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ludex.operators import als as alsmod
from ludex.operators import evaluate as ev
from ludex.operators import lookup
from ludex.operators import rank as rk
from ludex.plans import fixtures as fx
from ludex.plans.q_relevance import RELEVANCE_SQL_BODY, relevance_table, staged_relevance
from ludex.plans.registry import DIGITS, register, round_doubles
from ludex.session import cut_lineage, free_shuffles

M = fx.TRAIN_MOD
VECTOR_DIM = 64             # fixed value: width of the fixture's item vectors
HOLD_MOD = 4   # fixture: a test user's games with app_id % 4 = 0 are held out for evaluation


# ------------------------------------------------------------------ fixture vectors
def item_vectors(spark, d):
    """Game vectors: game ``app_id`` takes embedding ``app_id % (number of embeddings)``."""
    e = fx.table(spark, d, "embeddings").select("vec_id", "embedding")
    n = e.count()
    g = fx.table(spark, d, "part").select(F.col("p_partkey").alias("app_id"))
    g = g.withColumn("vec_id", F.pmod(F.col("app_id"), F.lit(n)))
    return g.join(e, "vec_id").select("app_id", F.col("embedding").alias("features"))      # as stored: floats are half of doubles to move


def mean_vectors(rows, items, user="user_id"):
    """User vector = mean of the vectors of the user's games (element-wise, distributed); no vector moves with a row."""
    return lookup.staged_means(rows, items, user, "app_id", "features", VECTOR_DIM)


VEC_SQL = fx.cte(inter=fx.INTERACTIONS_SQL) + """,
iv AS (SELECT p_partkey AS app_id, CAST(e.embedding AS DOUBLE[]) AS v
       FROM part JOIN embeddings e ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings))"""


def _recs_sql(seen_pred: str, users_pred: str) -> str:
    return VEC_SQL + f""",
seen AS (SELECT user_id, app_id FROM inter WHERE {users_pred} AND {seen_pred}),
uv AS (SELECT s.user_id, k.idx, avg(iv.v[k.idx]) AS x FROM seen s JOIN iv USING (app_id),
          range(1, 65) AS k(idx) GROUP BY s.user_id, k.idx),
uvec AS (SELECT user_id, list(x ORDER BY idx) AS u FROM uv GROUP BY user_id),
sc AS (SELECT uvec.user_id, iv.app_id, list_dot_product(u, v) AS s FROM uvec, iv
       WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.user_id = uvec.user_id AND seen.app_id = iv.app_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, app_id) AS rank FROM sc),
recs AS (SELECT user_id, app_id, rank, s FROM r WHERE rank <= 10)
"""


def _recs(spark, d, seen_filter=None, users_filter=None, k=10):
    i = fx.interactions(spark, d).select("user_id", "app_id")
    users = i.filter(users_filter) if users_filter is not None else i
    seen = users.filter(seen_filter) if seen_filter is not None else users
    seen = cut_lineage(seen)                                             # read for the users' vectors and for their lists
    free_shuffles(spark)
    items = item_vectors(spark, d)
    uvec = mean_vectors(seen, items)
    return rk.recommend_topk(uvec, items, seen, k=k)


@register("recommend_top10_unseen", "R11 R19 T2 J6 J7 J8", _recs_sql("true", "true") + """
SELECT user_id, app_id, rank, round(s, 6) AS score FROM recs""")
def q_recommend(spark, d):
    """Top 10 unseen games for every user of the interaction table."""
    return round_doubles(_recs(spark, d).select("user_id", "app_id", "rank", "score"))


@register("recommend_top10_formatted", "R19 P35 S6", _recs_sql("true", "true") + """
SELECT user_id, rank, app_id, p_name AS "Game", format('{:.4f}', s) AS "Predicted Score"
FROM recs JOIN part ON app_id = p_partkey""")
def q_recommend_fmt(spark, d):
    recs = _recs(spark, d)
    names = fx.games(spark, d).select("app_id", "game_name")
    return rk.format_recommendations(recs, names)


@register("ndcg_at_10_fixed_recs", "E2", _recs_sql(f"app_id % {HOLD_MOD} <> 0", f"user_id % {M} = 0") + f""",
truth AS (SELECT user_id, app_id FROM inter WHERE user_id % {M} = 0 AND app_id % {HOLD_MOD} = 0),
dcg AS (SELECT r.user_id, sum(1 / log2(r.rank + 1)) AS dcg FROM recs r JOIN truth t USING (user_id, app_id) GROUP BY 1),
nt AS (SELECT user_id, least(count(*), 10) AS m FROM truth GROUP BY 1),
idcg AS (SELECT user_id, sum(1 / log2(k.i + 1)) AS idcg FROM nt, range(1, 11) AS k(i) WHERE k.i <= m GROUP BY 1)
SELECT round(avg(coalesce(dcg, 0) / idcg), 6) AS ndcg_at_k, count(*) AS n_users
FROM idcg LEFT JOIN dcg USING (user_id)""")
def q_ndcg_recs(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id")
    test = i.filter(F.col("user_id") % M == 0)
    recs = _recs(spark, d, seen_filter=F.col("app_id") % HOLD_MOD != 0, users_filter=F.col("user_id") % M == 0)
    truth = test.filter(F.col("app_id") % HOLD_MOD == 0)
    return round_doubles(alsmod.als_ndcg_at_k(recs, truth, 10))


@register("input_validity_filter", "R12", fx.cte(inter=fx.INTERACTIONS_SQL) + f"""
SELECT user_id, CAST(count(*) AS BIGINT) AS n_removed FROM (
  SELECT o_custkey AS user_id, l_partkey + 100000 * (l_linenumber % 2) AS app_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % {M} = 0)
WHERE app_id NOT IN (SELECT app_id FROM inter WHERE user_id % {M} <> 0) GROUP BY user_id""")
def q_valid_inputs(spark, d):
    li = fx.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    entries = li.join(o, li.l_orderkey == o.o_orderkey).filter(F.col("o_custkey") % M == 0).select(
        F.col("o_custkey").alias("user_id"),
        (F.col("l_partkey") + F.lit(100000) * (F.col("l_linenumber") % 2)).alias("app_id"))
    hist = fx.interactions(spark, d).filter(F.col("user_id") % M != 0)
    _, removed = rk.valid_inputs(entries, hist)
    return removed


# ------------------------------------------------------------------ ALS
ALS_RANK, ALS_REG, ALS_ALPHA, ALS_ITERS = 2, 0.01, 1.0, 15   # rank 2: the reference's chosen width


def als_train(spark, d, rank=ALS_RANK, iters=ALS_ITERS):
    from ludex.session import cut_lineage
    r = cut_lineage(relevance_table(spark, d, prices=False).select("user_id", "app_id", "relevance_score"))    # used for training and for fold-in
    train = r.filter(F.col("user_id") % M != 0)
    model = alsmod.ImplicitALS(rank=rank, reg=ALS_REG, alpha=ALS_ALPHA, iters=iters).fit(train)
    return r, train, model


@register("als_factors", "R4 A19 C11 R7 A15")
def q_als(spark, d):
    r, train, model = als_train(spark, d)
    uf, itf = model.user_factors(), model.item_factors()
    att = alsmod.attach_factors(train.select("user_id", "app_id"), uf, itf)
    q = att.agg(F.count(F.lit(1)).alias("n_rows"),
                F.count_if(F.size("user_emb") != ALS_RANK).alias("bad_user_width"),
                F.count_if(F.size("game_emb") != ALS_RANK).alias("bad_game_width"),
                F.count_if(F.col("user_emb").isNull()).alias("users_without_factor"))
    return q


@register("als_fold_in", "R8 A19 F6")
def q_fold_in(spark, d):
    """Fold-in of the training users reproduces their ALS factors; test users get new ones."""
    r, train, model = als_train(spark, d)
    itf = model.item_factors()
    folded = alsmod.fold_in(itf, r, ALS_RANK, ALS_REG, ALS_ALPHA)
    uf = model.user_factors().withColumnRenamed("features", "als")
    cmp = folded.join(uf, "user_id", "left")
    diff = F.aggregate(F.zip_with("features", "als", lambda a, b: F.abs(a - b)), F.lit(0.0),
                       lambda acc, x: F.greatest(acc, x))
    return cmp.groupBy((F.col("user_id") % M == 0).alias("is_test_user")).agg(
        F.count(F.lit(1)).alias("n_users"), F.max(diff).alias("max_abs_diff_to_als"))


@register("als_ndcg_at_10", "E2 R8 R19 R4")
def q_als_ndcg(spark, d):
    r, train, model = als_train(spark, d)
    test = r.filter(F.col("user_id") % M == 0)
    known = test.filter(F.col("app_id") % HOLD_MOD != 0)
    truth = test.filter(F.col("app_id") % HOLD_MOD == 0)
    itf = model.item_factors()
    uvec = alsmod.fold_in(itf, known, ALS_RANK, ALS_REG, ALS_ALPHA)
    recs = rk.recommend_topk(uvec, itf.select("app_id", F.col("features").cast("array<double>").alias("features")),
                             known.select("user_id", "app_id"), k=10)
    return round_doubles(alsmod.als_ndcg_at_k(recs, truth, 10))


SEARCH_SPACE = {"rank": ("choice", [2, 4, 8, 16, 32]), "reg": ("log", 1e-4, 1e-2), "alpha": ("log", 1.0, 20.0)}


@register("als_random_search", "R6 R5 E4 V8 E2 R8")
def q_search(spark, d, trials: int = 30, folds: int = 5, iters: int = 15):
    """One row per trial: its parameters, mean and population std of the folds' NDCG@10."""
    from ludex.operators.assemble import user_folds
    r = relevance_table(spark, d, prices=False).filter(F.col("user_id") % M != 0).select("user_id", "app_id", "relevance_score")
    train = alsmod.persist_for_search(user_folds(r, k=folds))
    parts = [alsmod.SearchFold(train, f, F.col("app_id") % HOLD_MOD == 0) for f in range(folds)]
    res = alsmod.random_search(SEARCH_SPACE, trials, lambda rank, reg, alpha: [p.score(rank, reg, alpha, iters) for p in parts])
    rows = [(x["trial"], f, int(x["rank"]), x["reg"], x["alpha"], s) for x in res for f, s in enumerate(x["scores"])]
    scores = spark.createDataFrame(rows, "trial int, fold int, rank int, reg double, alpha double, score double")
    return ev.fold_summary(scores, "score", ["trial", "rank", "reg", "alpha"])


# ------------------------------------------------------------------ rankers
RANK_FEATURES = ["f_price", "f_size", "f_retail"]


def ranker_frame(spark, d):
    r = relevance_table(spark, d).select("user_id", "app_id", "relevance_score", "price_mean")
    g = fx.games(spark, d).select("app_id", "game_size", "game_initial_price")
    return r.join(g, "app_id").select(
        "user_id", "app_id", "relevance_score", (F.col("price_mean") / 1e5).alias("f_price"),
        (F.col("game_size") / 50.0).alias("f_size"), (F.col("game_initial_price") / 2000.0).alias("f_retail"))


@register("pairwise_ranker_fit", "R16 R15 V8")
def q_ranker(spark, d):
    f = ranker_frame(spark, d)
    train = f.filter(F.col("user_id") % M != 0)
    pr = rk.PairwiseRanker(iters=10).fit(train, "user_id", RANK_FEATURES, "relevance_score", key="app_id")
    test = pr.score(f.filter(F.col("user_id") % M == 0))
    loss = ev.ranknet_loss(test, "user_id", "score", "relevance_score", key="app_id").first()
    rows = [(i, float(v), None) for i, v in enumerate(pr.history)]
    rows.append((-1, float(loss["ranknet_loss"]), math.log(2.0)))
    return spark.createDataFrame(rows, "iteration int, loss double, ln2 double")


@register("ranker_learning_curves", "V8 R16 R5")
def q_curves(spark, d, folds: int = 3, iters: int = 6):
    """Loss per fold and iteration of the pairwise ranker, each fold's users left out once, as a table."""
    from ludex.operators.assemble import user_folds
    from ludex.operators.explore import curves
    from ludex.session import cut_lineage
    f = cut_lineage(user_folds(ranker_frame(spark, d).filter(F.col("user_id") % M != 0), k=folds))
    rows = []
    for k in range(folds):
        pr = rk.PairwiseRanker(iters=iters).fit(f.filter(F.col("fold") != k), "user_id", RANK_FEATURES, "relevance_score", key="app_id")
        held = ev.ranknet_loss(pr.score(f.filter(F.col("fold") == k)), "user_id", "score", "relevance_score", key="app_id").first()
        rows += [(k, i, float(v), float(held["ranknet_loss"]) if i == len(pr.history) - 1 else None) for i, v in enumerate(pr.history)]
    return curves(spark, rows)


def tabular_frame(spark, d):
    """Fact rows with game, user and list columns for the tree model (R18 input)."""
    r = relevance_table(spark, d).select("user_id", "app_id", "relevance_score", "price_mean")
    g = fx.games(spark, d).select("app_id", "game_genres", "game_type", "game_size", "game_initial_price",
                                  F.array("game_brand").alias("game_developer"))
    u = fx.users(spark, d).select(
        "user_id", F.when(F.col("user_id") % 13 == 0, F.lit(None)).otherwise(F.col("user_country_code"))
        .alias("user_country_code"), "user_latitude", "user_longitude",
        F.year("user_created").alias("created_year"))
    return r.join(g, "app_id").join(u, "user_id", "left")


@register("gbt_regression_metrics", "R17 R18 E3 C6 C7 C8 C9 C10 P2 P21 P27 P29 P30 J3 I1")
def q_gbt(spark, d, max_iter: int = 100):
    from ludex.operators.features import TabularFeatures
    from ludex.session import cut_lineage
    f = cut_lineage(tabular_frame(spark, d))
    train, test = f.filter(F.col("user_id") % M != 0), f.filter(F.col("user_id") % M == 0)
    emb = item_vectors(spark, d).select("app_id", F.col("features").cast("array<float>").alias("game_emb"))
    tf = TabularFeatures(drop=["price_mean"], emb_dim=VECTOR_DIM).fit(train, emb)
    num, cat = tf.feature_columns()
    tr, te = tf.apply(train), tf.apply(test)
    model = rk.fit_gbt(tr, num, "relevance_score", max_iter=max_iter, categorical=cat)
    pred = model.transform(te)
    mean_y = train.agg(F.avg("relevance_score")).first()[0]
    gbt = ev.regression_metrics(pred, "relevance_score", "prediction").withColumn("model", F.lit("gbt"))
    base = ev.regression_metrics(te.withColumn("prediction", F.lit(mean_y)), "relevance_score", "prediction") \
        .withColumn("model", F.lit("mean"))
    return round_doubles(gbt.unionByName(base).withColumn("n_features", F.lit(len(num) + len(cat))))


def mlp_parts(spark, d, folds: int = 0):
    """(fact rows of train and test users, encoded games with their vectors, the MLP's roles, the sizes of its vocabularies fitted on train).

    The rows are narrow: user, game, target, price and, with ``folds``, the train users' fold.  What a game alone decides is encoded once a
    game, so no label and no vector moves with a row before ``mlp_rows``.  A game that is there several times multiplies its rows,
    in every of the joins that its columns come from."""
    from ludex.operators import encode as enc
    from ludex.operators.assemble import user_folds
    from ludex.session import cut_lineage
    r = relevance_table(spark, d).filter("user_id IS NOT NULL").select("user_id", "app_id", "relevance_score", (F.col("price_mean") / 1e5).alias("f_price"))
    g = fx.games(spark, d).select("app_id", "game_genres", "game_type", F.col("game_brand").alias("dev"))
    r = cut_lineage(r.join(g.select("app_id"), "app_id", "left_semi").join(fx.users(spark, d).select("user_id"), "user_id", "left"))
    train = r.filter(F.col("user_id") % M != 0)
    sizes = fx.games(spark, d).select("app_id", (F.col("game_size") / 50.0).alias("f_size"), (F.col("game_initial_price") / 2000.0).alias("f_retail"))
    known = cut_lineage(g.join(train.select("app_id").distinct(), "app_id", "left_semi"))
    t_enc, d_enc = enc.LabelEncoder.fit(known, "game_type"), enc.LabelEncoder.fit(known, "dev")
    g_enc = enc.ListEncoder.fit(known, "game_genres")
    counted = train.select("app_id").join(g.select("app_id", "game_genres"), "app_id").join(sizes.select("app_id"), "app_id")
    tags = enc.TopNLabels.fit(counted, "game_genres", 5, "tag")                                   # counts rows
    x = tags.apply(g_enc.apply(d_enc.apply(t_enc.apply(g), "dev_encoded")), keep=True)
    tag_cols = [c for c in x.columns if c.startswith("tag_")]
    x = x.select("app_id", "game_type_encoded", "dev_encoded", "game_genres_encoded_padded", *[F.col(c).cast("int").alias(c) for c in tag_cols])
    games = cut_lineage(x.join(sizes, "app_id").join(item_vectors(spark, d), "app_id", "left"))
    if folds:
        r = user_folds(train, k=folds).unionByName(r.filter(F.col("user_id") % M == 0), allowMissingColumns=True)
    roles = {"single": ["game_type_encoded", "dev_encoded"], "multi": ["game_genres_encoded_padded"],
             "num": RANK_FEATURES, "bool": tag_cols, "cf": [f"{v}_{i}" for v in ("game_emb", "user_emb") for i in range(VECTOR_DIM)]}
    card = {"game_type_encoded": t_enc.size() + 1, "dev_encoded": d_enc.size() + 1,
            "game_genres_encoded_padded": g_enc.size() + 2}
    return r, games, roles, card


def mlp_rows(rows, games):
    """(encoded fact rows, the vectors of their users): the network's inputs of a row, and those that are the user's own.

    Every user's vector comes from the user's own rows, so ``rows`` holds all rows of a user."""
    from ludex.functions.clean import flatten_vector
    x = rows.join(games, "app_id")
    flat = {v: flatten_vector("features", VECTOR_DIM, v) for v in ("game_emb", "user_emb")}
    users = mean_vectors(rows, games.select("app_id", "features")).select("user_id", *flat["user_emb"])
    stored = [F.col(f"game_emb_{i}").cast("float").alias(f"game_emb_{i}") for i in range(VECTOR_DIM)] \
        if games.schema["features"].dataType.elementType.typeName() == "float" else [f"game_emb_{i}" for i in range(VECTOR_DIM)]
    plain = [c for c in x.columns if c != "features"]
    return x.select(*plain, *flat["game_emb"]).select(*plain, *stored), users


def mlp_wide(x, users, roles):
    """Rows with all inputs as columns; a user without vector has zeros."""
    own = [c for c in users.columns if c != "user_id"]
    wide = x.join(users, "user_id", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in own})
    return wide.select("user_id", "app_id", *[F.col(c).cast("double").alias(c) if c in roles["cf"] else c
                                              for r in ("single", "multi", "num", "bool", "cf") for c in roles[r]])


def mlp_inputs(spark, d):
    """Encoded test rows, the MLP's roles and seeded weights of the reference's shape."""
    r, games, roles, card = mlp_parts(spark, d)
    x, users = mlp_rows(r.filter(F.col("user_id") % M == 0), games)
    return mlp_wide(x, users, roles), roles, rk.init_mlp(roles, card, seed=42)


@register("mlp_ranker_curves", "R16 R14 V8 R5 E1")
def q_mlp_curves(spark, d, folds: int = 3, epochs: int = 6):
    """Training loss and held-out NDCG of the MLP ranker: one row per fold and epoch, each fold's users held out once."""
    from ludex.operators.explore import curves
    from ludex.operators.mlp import MLPRanker
    r, games, roles, card = mlp_parts(spark, d, folds)
    x, users = mlp_rows(r.filter(F.col("user_id") % M != 0), games)
    m = MLPRanker(roles, card, epochs=epochs).prepare(x, "user_id", "app_id", "relevance_score", "fold", own=users)
    rows = [(k, e, float(loss), float(score)) for k in range(folds) for e, loss, score in m.fit(k).history]
    m.release()
    return curves(spark, rows, ("fold", "epoch", "train_loss", "held_ndcg"))


@register("mlp_batch_scoring", "R14 R16 F5 C3 C4 C6 P30")
def q_mlp(spark, d, epochs: int = 4):
    """Every test row scored by the MLP, with weights that were trained on the train users, saved and loaded."""
    from ludex.operators.mlp import MLPRanker, fill_inputs, load_mlp, save_mlp
    from ludex.session import drop_path, scratch_path
    r, games, roles, card = mlp_parts(spark, d)
    x, users = mlp_rows(r.filter(F.col("user_id") % M != 0), games)
    m = MLPRanker(roles, card, epochs=epochs).prepare(x, "user_id", "app_id", "relevance_score", own=users).fit()
    m.release()
    path = scratch_path(spark, "mlp-weights")
    save_mlp(spark, m.weights, path)
    weights = load_mlp(spark, path)
    drop_path(spark, path)
    x, users = mlp_rows(r.filter(F.col("user_id") % M == 0), games)
    test = fill_inputs(mlp_wide(x, users, roles), roles, m.widths)
    return rk.score_mlp(test, roles, weights).select("user_id", "app_id", "score")


@register("new_user_recommendations", "R13 I7 R2 R9 R8 R11 R19 R10")
def q_new_users(spark, d):
    """Batch version of the request path for every test user at once."""
    from ludex.operators import impute as imp
    from ludex.operators import profile as pf
    from ludex.operators.assemble import game_catalog
    from ludex.operators.relevance import relevance_incremental
    from ludex.session import cut_lineage
    i = fx.interactions(spark, d)
    hist, new = i.filter(F.col("user_id") % M != 0), i.filter(F.col("user_id") % M == 0)
    means = pf.game_means(hist, "app_id", ["playtime_forever", "achievements"])
    new_in = new.select("user_id", "app_id", F.when(F.col("app_id") % 3 == 0, None)
                        .otherwise(F.col("playtime_forever")).alias("playtime_forever"),
                        F.col("achievements").cast("double").alias("achievements"))
    filled = imp.impute_game_inputs(new_in, means)
    rel_new = relevance_incremental(filled, hist.withColumn("achievements", F.col("achievements").cast("double")))
    games = fx.games(spark, d)
    catalog = game_catalog(games.select("app_id", "game_size", "game_initial_price"))
    prefs = pf.user_profile_table(rel_new.join(catalog, "app_id"), "user_id", ["game_size", "game_initial_price"])
    r_hist = cut_lineage(relevance_table(spark, d, prices=False).filter(F.col("user_id") % M != 0).select("user_id", "app_id", "relevance_score"))
    model = alsmod.ImplicitALS(rank=ALS_RANK, reg=ALS_REG, alpha=ALS_ALPHA, iters=ALS_ITERS).fit(r_hist)
    itf = model.item_factors().select("app_id", F.col("features").cast("array<double>").alias("features"))
    uvec = alsmod.fold_in(itf, rel_new.fillna(0.0, ["relevance_score"]), ALS_RANK, ALS_REG, ALS_ALPHA)
    recs = rk.recommend_topk(uvec, itf, new.select("user_id", "app_id"), k=10)
    out = rk.format_recommendations(recs, games.select("app_id", "game_name"))
    return out.join(prefs, "user_id", "left")


def request_features(spark, d):
    """(user rows, game rows, roles, vocabulary sizes) of the request path, fitted on the train users.

    A user's row is made as for a new user (R13): country or Missing, coordinates and account age filled from train (I7), country
    encoded (C3), means over the user's own games of prices, sizes and every genre (R9), mean game vector."""
    from ludex.functions import clean as cl
    from ludex.operators import encode as enc
    from ludex.operators import impute as imp
    from ludex.operators import profile as pf
    from ludex.operators.scale import Standardize
    from ludex.session import cut_lineage
    inter = cut_lineage(fx.interactions(spark, d).select("user_id", "app_id"))
    u = fx.users(spark, d).select("user_id", F.when(F.col("user_id") % 13 != 0, F.col("user_country_code")).alias("user_country_code"), "user_latitude",
                                  "user_longitude", F.when(F.col("user_id") % 17 != 0, cl.age_months("user_created", fx.AS_OF)).alias("user_account_age_months"))
    u = cut_lineage(u.join(inter.select("user_id").distinct(), "user_id", "left_semi"))
    seen_users = u.filter(F.col("user_id") % M != 0)
    geo = imp.GroupMedianFill.fit(seen_users.filter("user_country_code IS NOT NULL"), ["user_latitude", "user_longitude"], "user_country_code")
    u = cut_lineage(imp.impute_profiles(u, geo, imp.MedianFill.fit(seen_users, ["user_account_age_months"])))
    numbers = ["user_latitude", "user_longitude", "user_account_age_months"]
    country = enc.LabelEncoder.fit(u.filter(F.col("user_id") % M != 0), "user_country_code")
    u = Standardize.fit(u.filter(F.col("user_id") % M != 0), numbers).apply(country.apply(u))
    g = cut_lineage(fx.games(spark, d).withColumns({"f_size": F.col("game_size") / 50.0, "f_retail": F.col("game_initial_price") / 2000.0})
                    .select("app_id", "game_type", "game_brand", "game_genres", "f_size", "f_retail"))
    known = g.join(inter.filter(F.col("user_id") % M != 0).select("app_id").distinct(), "app_id", "left_semi")
    kind, brand, words = enc.LabelEncoder.fit(known, "game_type"), enc.LabelEncoder.fit(known, "game_brand"), enc.ListEncoder.fit(known, "game_genres")
    genres = enc.MultiLabel.fit(known, "game_genres", "genre", unknown=False)
    means = ["f_size", "f_retail", *[f"genre_{w}" for w in genres.state["known"]]]
    prefs = pf.user_profile_table(inter.join(genres.apply(g), "app_id"), "user_id", means)
    items = item_vectors(spark, d)
    flat = [f"{v}_{k}" for v in ("game_emb", "user_emb") for k in range(VECTOR_DIM)]
    uvec = mean_vectors(inter, items).select("user_id", *[F.col("features")[k].alias(f"user_emb_{k}") for k in range(VECTOR_DIM)])
    users = u.join(prefs, "user_id").join(uvec, "user_id", "left").drop("user_country_code")
    games = words.apply(brand.apply(kind.apply(g))).join(items.select("app_id", *[F.col("features")[k].alias(f"game_emb_{k}") for k in range(VECTOR_DIM)]),
                                                         "app_id", "left").drop("game_type", "game_brand", "game_genres")
    roles = {"single": ["user_country_code_encoded", "game_type_encoded", "game_brand_encoded"], "multi": ["game_genres_encoded_padded"],
             "num": [*numbers, "f_size", "f_retail", *[f"user_preference_{c}" for c in means]], "bool": ["user_has_coordinates"], "cf": flat}
    card = {f"{c}_encoded": e.size() + 1 for c, e in (("user_country_code", country), ("game_type", kind), ("game_brand", brand))}
    return cut_lineage(users), cut_lineage(games), roles, card | {"game_genres_encoded_padded": words.size() + 2}


@register("new_user_model_recommendations", "R13 R14 R16 R19 R11 R9 I7 C3 C4")
def q_request(spark, d, epochs: int = 3):
    """The ten best unseen games of every new (test) user by the MLP that was trained on the train users, formatted."""
    from ludex.operators.mlp import MLPRanker, recommend_by_model
    users, games, roles, card = request_features(spark, d)
    rel = staged_relevance(spark, d)
    # a user's inputs meet the user's blocks, not every row, where the users are there once
    once = users.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    train = rel.filter(F.col("user_id") % M != 0).join(users.select("user_id") if once else users, "user_id").join(games, "app_id")
    m = MLPRanker(roles, card, epochs=epochs).prepare(train, "user_id", "app_id", "relevance_score", own=users if once else None).fit()
    m.release()
    new = users.filter(F.col("user_id") % M == 0)
    recs = recommend_by_model(new, games, rel.filter(F.col("user_id") % M == 0).select("user_id", "app_id"), roles, m.widths, m.weights, k=10)
    return rk.format_recommendations(recs, fx.games(spark, d).select("app_id", "game_name"))


TAB_SQL = RELEVANCE_SQL_BODY.rstrip() + f""",
u AS ({fx.USERS_SQL}),
f AS (SELECT r.user_id, r.app_id, r.relevance_score, p_type AS game_type, p_size AS game_size,
             p_retailprice AS game_initial_price, string_split(p_name, ' ') AS game_genres, p_brand AS dev0,
             CASE WHEN r.user_id % 13 = 0 THEN NULL ELSE u.user_country_code END AS country,
             u.user_latitude, u.user_longitude, year(u.user_created) AS created_year
      FROM rel r JOIN part ON r.app_id = p_partkey LEFT JOIN u ON r.user_id = u.user_id),
tr AS (SELECT * FROM f WHERE user_id % {M} <> 0),
te AS (SELECT * FROM f WHERE user_id % {M} = 0),
devtop AS (SELECT dev0 AS d FROM tr GROUP BY dev0 ORDER BY count(*) DESC, dev0 LIMIT 10),
tagtop AS (SELECT w FROM (SELECT unnest(game_genres) AS w FROM tr) GROUP BY w ORDER BY count(*) DESC, w LIMIT 5),
words AS (SELECT DISTINCT unnest(game_genres) AS w FROM tr),
med AS (SELECT median(user_latitude) AS mlat, median(user_longitude) AS mlon, min(created_year) AS y0 FROM tr),
trc AS (SELECT DISTINCT coalesce(country, 'Missing') AS cc,
               CASE WHEN dev0 IN (SELECT d FROM devtop) THEN dev0 ELSE 'Other' END AS dev, game_type FROM tr),
iv AS (SELECT p_partkey AS app_id, CAST(e.embedding AS DOUBLE[]) AS v
       FROM part JOIN embeddings e ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings)),
x AS (SELECT te.*, coalesce(te.country, 'Missing') AS cc0,
             CASE WHEN dev0 IN (SELECT d FROM devtop) THEN dev0 ELSE 'Other' END AS dev1,
             coalesce(user_latitude, mlat) AS lat, coalesce(user_longitude, mlon) AS lon, created_year - y0 AS yrs,
             iv.v
      FROM te LEFT JOIN iv USING (app_id), med),
y AS (SELECT x.*,
        CASE WHEN cc0 IN (SELECT cc FROM trc) THEN cc0 WHEN 'Other' IN (SELECT cc FROM trc) THEN 'Other'
             WHEN 'Missing' IN (SELECT cc FROM trc) THEN 'Missing' END AS cc1,
        CASE WHEN dev1 IN (SELECT dev FROM trc) THEN dev1 WHEN 'Other' IN (SELECT dev FROM trc) THEN 'Other'
             WHEN 'Missing' IN (SELECT dev FROM trc) THEN 'Missing' END AS dev2,
        CASE WHEN game_type IN (SELECT game_type FROM trc) THEN game_type
             WHEN 'Other' IN (SELECT game_type FROM trc) THEN 'Other'
             WHEN 'Missing' IN (SELECT game_type FROM trc) THEN 'Missing' END AS gt1
      FROM x)
SELECT user_id, app_id, feature, round(num_value, 6) AS num_value, str_value FROM (
  SELECT user_id, app_id, 'relevance_score' AS feature, relevance_score AS num_value, NULL AS str_value FROM y
  UNION ALL SELECT user_id, app_id, 'game_size', CAST(game_size AS DOUBLE), NULL FROM y
  UNION ALL SELECT user_id, app_id, 'game_initial_price', game_initial_price, NULL FROM y
  UNION ALL SELECT user_id, app_id, 'user_latitude', lat, NULL FROM y
  UNION ALL SELECT user_id, app_id, 'user_longitude', lon, NULL FROM y
  UNION ALL SELECT user_id, app_id, 'game_emb_' || k, coalesce(v[k + 1], 0.0), NULL FROM y, range(64) AS r(k)
  UNION ALL SELECT user_id, app_id, 'created_years_since', CAST(yrs AS DOUBLE), NULL FROM y
  UNION ALL SELECT user_id, app_id, 'tag_' || w, CAST(list_contains(game_genres, w) AS DOUBLE), NULL FROM y, tagtop
  UNION ALL SELECT user_id, app_id, 'genre_' || w, CAST(list_contains(game_genres, w) AS DOUBLE), NULL FROM y, words
  UNION ALL SELECT user_id, app_id, 'game_type', NULL, gt1 FROM y
  UNION ALL SELECT user_id, app_id, 'user_country_code', NULL, cc1 FROM y
  UNION ALL SELECT user_id, app_id, 'developer', NULL, dev2 FROM y)"""


def long_form(df, keys, num, txt, ready=()):
    """``keys``, feature, num_value (rounded; the columns ``ready`` are so already), str_value: a row a feature, nulls too.

    A row is made once: its values are an array that is exploded, its names are looked up by place.  An unpivot of each kind would make
    every row once a kind, and a projection a feature is too long a method for the JVM to compile; so are all values in one piece of
    whole-stage code, which a lambda's rounding keeps them out of."""
    num = [c for c in num if c not in ready] + [c for c in num if c in ready]
    first = [F.col(c).cast("double") for c in num if c not in ready]
    rest = [F.col(c).cast("double") for c in num if c in ready] + [F.lit(None).cast("double")] * len(txt)
    values = F.concat(F.transform(F.array(*first).cast("array<double>"), lambda x: F.round(x, DIGITS)), F.array(*rest).cast("array<double>"))
    wide = df.select(*keys, values.alias("_n"), F.array(*[F.col(c).cast("string") for c in txt]).cast("array<string>").alias("_t"))
    names = F.array(*[F.lit(c) for c in [*num, *txt]])
    return wide.select(*keys, "_t", F.posexplode("_n").alias("_at", "num_value")) \
        .select(*keys, F.get(names, F.col("_at")).alias("feature"), "num_value", F.get("_t", F.col("_at") - len(num)).alias("str_value"))


@register("tabular_feature_chain", "R18 C6 C7 C8 C9 C10 P2 P21 P27 P29 P30 J3 I1", TAB_SQL)
def q_tabular(spark, d):
    """The tree model's feature table for the test rows, fitted on train, in long form."""
    from pyspark.sql import types as T
    from ludex.operators.features import TabularFeatures
    from ludex.session import cut_lineage
    f = cut_lineage(tabular_frame(spark, d))                       # read by every fit
    train, test = f.filter(F.col("user_id") % M != 0), f.filter(F.col("user_id") % M == 0)
    # vectors are no input of a fit: they are rounded for the table here, once a game, not once a row
    emb = item_vectors(spark, d).select("app_id", F.transform(F.col("features").cast("array<float>"), lambda x: F.round(x.cast("double"), DIGITS)).alias("game_emb"))
    tf = TabularFeatures(drop=["price_mean"], emb_dim=VECTOR_DIM).fit(train, emb)
    out = tf.apply(test)
    keys = ["user_id", "app_id"]
    num = [c.name for c in out.schema.fields if c.name not in keys and not isinstance(c.dataType, T.StringType)]
    txt = [c.name for c in out.schema.fields if c.name not in keys and isinstance(c.dataType, T.StringType)]
    return long_form(out, keys, num, txt, [f"game_emb_{k}" for k in range(VECTOR_DIM)])
