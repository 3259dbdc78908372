"""Registered queries: evaluation (E1, E3-E5), RankNet loss (R15, J9), user split and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ludex.operators import assemble as asm
from ludex.operators import evaluate as ev
from ludex.plans import fixtures as fx
from ludex.plans.q_relevance import RELEVANCE_SQL_BODY, relevance_table
from ludex.plans.registry import register, round_doubles

M = fx.TRAIN_MOD
SCORE_SCALE = 100000.0   # fixture: score = mean extended price / 1e5

# relevance rows joined back to their mean price (the score of the fixture)
REL_B = RELEVANCE_SQL_BODY.rstrip() + """,
b AS (SELECT r.user_id, r.app_id, r.relevance_score AS y, i.price_mean AS price
      FROM rel r JOIN inter i USING (user_id, app_id))
"""


def _ndcg_sql(score: str, k: int | None) -> str:
    cut_p = f"CASE WHEN pp <= {k} THEN 1 / log2(pp + 1) ELSE 0 END" if k else "1 / log2(pp + 1)"
    cut_t = f"CASE WHEN pt <= {k} THEN 1 / log2(pt + 1) ELSE 0 END" if k else "1 / log2(pt + 1)"
    return REL_B + f""",
s AS (SELECT user_id, y, {score} AS s FROM b),
p AS (SELECT user_id, y, s, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, y DESC) AS pp,
             row_number() OVER (PARTITION BY user_id ORDER BY y DESC) AS pt FROM s),
t AS (SELECT user_id, s, avg(y) * sum({cut_p}) AS g, sum(y * {cut_t}) AS ig, count(*) AS n FROM p GROUP BY user_id, s),
u AS (SELECT user_id, sum(g) AS dcg, sum(ig) AS idcg, sum(n) AS n FROM t GROUP BY user_id)
SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END), 6) AS mean_ndcg, count(*) AS n_users,
       (SELECT count(DISTINCT user_id) FROM b) - count(*) AS n_skipped
FROM u WHERE n >= 2"""


@register("ndcg_full_list", "E1 W5", _ndcg_sql("price", None))
def q_ndcg(spark, d):
    r = relevance_table(spark, d)
    return round_doubles(ev.ndcg(r, "user_id", "relevance_score", "price_mean"))


@register("ndcg_at_10_with_ties", "E1 W5", _ndcg_sql("floor(price / 20000)", 10))
def q_ndcg_ties(spark, d):
    r = relevance_table(spark, d).withColumn("score", F.floor(F.col("price_mean") / 20000))
    return round_doubles(ev.ndcg(r, "user_id", "relevance_score", "score", k=10))


RANKNET_SQL = REL_B + f""",
s AS (SELECT user_id, app_id, y, price / {SCORE_SCALE} AS s FROM b),
n AS (SELECT user_id FROM s GROUP BY user_id HAVING count(*) >= 2),
pr AS (SELECT a.user_id, least(greatest(-(a.s - c.s), 0) + ln(1 + exp(-abs(a.s - c.s))), 100) AS l
       FROM s a JOIN s c ON a.user_id = c.user_id AND a.y > c.y),
pu AS (SELECT user_id, sum(l) AS loss, count(*) AS pairs FROM pr GROUP BY user_id)
SELECT round(avg(coalesce(loss, 0) / greatest(coalesce(pairs, 0), 1)), 6) AS ranknet_loss, count(*) AS n_users
FROM n LEFT JOIN pu USING (user_id)"""


@register("ranknet_loss", "R15 J9 A21", RANKNET_SQL)
def q_ranknet(spark, d, block: int = 1024):
    r = relevance_table(spark, d).withColumn("score", F.col("price_mean") / SCORE_SCALE)
    return round_doubles(ev.ranknet_loss(r, "user_id", "score", "relevance_score", block=block, key="app_id"))


@register("ranknet_loss_small_blocks", "R15 J9", RANKNET_SQL)
def q_ranknet_blocks(spark, d):
    """Same loss with 8-row blocks: many block pairs per user, same exact result."""
    return q_ranknet(spark, d, block=8)


@register("regression_metrics_popularity", "E3", RELEVANCE_SQL_BODY.rstrip() + f""",
pred AS (SELECT app_id, avg(relevance_score) AS p FROM rel WHERE user_id % {M} <> 0 GROUP BY app_id)
SELECT round(avg((p - relevance_score) * (p - relevance_score)), 6) AS mse,
       round(sqrt(avg((p - relevance_score) * (p - relevance_score))), 6) AS rmse,
       round(avg(abs(p - relevance_score)), 6) AS mae
FROM rel JOIN pred USING (app_id) WHERE user_id % {M} = 0""")
def q_regression(spark, d):
    r = relevance_table(spark, d)
    pred = r.filter(F.col("user_id") % M != 0).groupBy("app_id").agg(F.avg("relevance_score").alias("pred"))
    test = r.filter(F.col("user_id") % M == 0).join(pred, "app_id")
    return round_doubles(ev.regression_metrics(test, "relevance_score", "pred"))


@register("fold_ndcg_summary", "E4 A20 E1", REL_B + f""",
p AS (SELECT user_id, y, user_id % {M} AS fold,
             row_number() OVER (PARTITION BY user_id ORDER BY price DESC, y DESC) AS pp,
             row_number() OVER (PARTITION BY user_id ORDER BY y DESC) AS pt, price FROM b),
t AS (SELECT user_id, fold, price, avg(y) * sum(1 / log2(pp + 1)) AS g, sum(y / log2(pt + 1)) AS ig, count(*) AS n
      FROM p GROUP BY user_id, fold, price),
u AS (SELECT user_id, fold, sum(g) AS dcg, sum(ig) AS idcg, sum(n) AS n FROM t GROUP BY user_id, fold),
f AS (SELECT fold, avg(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END) AS score FROM u WHERE n >= 2 GROUP BY fold)
SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS n_folds FROM f""")
def q_fold_summary(spark, d):
    r = relevance_table(spark, d)
    per = ev.ndcg_per_user(r, "user_id", "relevance_score", "price_mean")
    folds = per.withColumn("fold", F.col("user_id") % M).groupBy("fold").agg(F.avg("ndcg").alias("score"))
    return round_doubles(ev.fold_summary(folds, "score"))


@register("train_test_drift", "E5 U1", fx.cte(inter=fx.INTERACTIONS_SQL) + f"""
SELECT CASE WHEN user_id % {M} = 0 THEN 'test' ELSE 'train' END AS split,
       round(avg(playtime_forever), 6) AS mean_playtime, round(stddev_samp(playtime_forever), 6) AS std_playtime,
       count(*) AS n_rows
FROM inter GROUP BY 1""")
def q_drift(spark, d):
    i = fx.interactions(spark, d)
    tr, te = i.filter(F.col("user_id") % M != 0), i.filter(F.col("user_id") % M == 0)

    def stat(df, split):
        return df.groupBy(split).agg(F.avg("playtime_forever").alias("mean_playtime"),
                                     F.stddev_samp("playtime_forever").alias("std_playtime"),
                                     F.count(F.lit(1)).alias("n_rows"))
    return round_doubles(ev.compare_sets(tr, te, stat))


@register("user_split_and_folds", "R3 R5")
def q_split(spark, d):
    i = fx.interactions(spark, d).select("user_id", "app_id")
    s = asm.user_folds(asm.split_by_user(i, "user_id", 0.8, 42), "user_id", 5, 42)
    return s.groupBy("split", "fold").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.count_distinct("user_id").alias("n_users"))
