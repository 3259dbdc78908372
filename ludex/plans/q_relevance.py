"""Registered queries: relevance scoring (W1-W3, R1, R2) and the flagship top-10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ludex.operators import relevance as rel
from ludex.operators.rank import top_k
from ludex.plans import fixtures as fx
from ludex.plans.registry import register, round_doubles
from ludex.session import cut_lineage, drop_stage, free_shuffles

I = fx.INTERACTIONS_SQL
TEST_USER_MOD = 5  # fixture split: users with user_id % 5 = 0 are the new / test users


def _stats_sql(src: str, lo: float = 0.05, hi: float = 0.95) -> str:
    return f"""
SELECT app_id, count(*) AS n, max(ln(1 + coalesce(achievements, 0))) > 0 AS has_ach,
       quantile_cont(ln(1 + playtime_forever), {lo}) AS p_lo,
       quantile_cont(ln(1 + playtime_forever), {hi}) AS p_hi,
       quantile_cont(ln(1 + coalesce(achievements, 0)), {lo}) AS a_lo,
       quantile_cont(ln(1 + coalesce(achievements, 0)), {hi}) AS a_hi
FROM {src} GROUP BY app_id"""


RELEVANCE_SQL_BODY = fx.cte(inter=I, st=_stats_sql("inter")) + """,
scored AS (
  SELECT i.user_id, i.app_id, s.has_ach,
    CASE WHEN s.n >= 5 THEN (least(greatest(ln(1 + i.playtime_forever), s.p_lo), s.p_hi) - s.p_lo)
                            / (s.p_hi - s.p_lo + 1e-6) ELSE 0 END AS mp,
    CASE WHEN s.n >= 5 THEN (least(greatest(ln(1 + coalesce(i.achievements, 0)), s.a_lo), s.a_hi) - s.a_lo)
                            / (s.a_hi - s.a_lo + 1e-6) ELSE 0 END AS ma
  FROM inter i JOIN st s USING (app_id)),
rel AS (SELECT user_id, app_id, CASE WHEN has_ach THEN 0.7 * mp + 0.3 * ma ELSE mp END AS relevance_score
        FROM scored)
"""


def relevance_table(spark, d, prices: bool = True):
    """Interactions with their score; without ``prices`` their mean price is neither computed nor staged."""
    i = fx.interactions(spark, d)
    # the catalogue size bounds the per-game statistics table (parquet metadata count)
    return rel.relevance(i if prices else i.drop("price_mean"), item_count=fx.table(spark, d, "part").count())


def staged_relevance(spark, d):
    """(user_id, app_id, relevance_score), written once; the wider rows that they were made of are deleted."""
    made = relevance_table(spark, d, prices=False)
    out = cut_lineage(made.select("user_id", "app_id", "relevance_score"))
    drop_stage(made)
    free_shuffles(spark)
    return out


@register("relevance_score", "R1 P23 P24 W1 W2 W3 F3",
          RELEVANCE_SQL_BODY + "SELECT user_id, app_id, round(relevance_score, 6) AS relevance_score FROM rel")
def q_relevance(spark, d):
    return round_doubles(relevance_table(spark, d).select("user_id", "app_id", "relevance_score"))


TOP_GAMES_SQL = RELEVANCE_SQL_BODY + """
SELECT r.app_id, p_name AS game_name, round(avg(relevance_score), 6) AS mean_relevance,
       count(*) AS n_users
FROM rel r JOIN part ON r.app_id = p_partkey
GROUP BY r.app_id, p_name
ORDER BY avg(relevance_score) DESC, r.app_id
LIMIT 10"""


def top_games(spark, d, k: int = 10):
    r = relevance_table(spark, d)
    per_game = r.groupBy("app_id").agg(F.avg("relevance_score").alias("mean_relevance"),
                                       F.count(F.lit(1)).alias("n_users"))
    top = top_k(per_game, k, [F.desc("mean_relevance"), F.asc("app_id")])
    names = fx.table(spark, d, "part").select(F.col("p_partkey").alias("app_id"), F.col("p_name").alias("game_name"))
    # top holds k rows: the name lookup is a broadcast of a k-row side
    out = names.join(F.broadcast(top), "app_id", "inner")
    return round_doubles(out.select("app_id", "game_name", "mean_relevance", "n_users"))


register("top_games_by_relevance", "R1 T2 T1 J1", TOP_GAMES_SQL)(top_games)


@register("game_has_achievements", "W1", fx.cte(inter=I) + """
SELECT user_id, app_id, max(achievements) OVER (PARTITION BY app_id) > 0 AS game_has_ach FROM inter""")
def q_group_flag(spark, d):
    return rel.group_flag(fx.interactions(spark, d), "achievements", "app_id", "game_has_ach") \
        .select("user_id", "app_id", "game_has_ach")


@register("winsorize_log_playtime", "W2 A4 P23", fx.cte(inter=I) + """
SELECT user_id, app_id, round(least(greatest(ln(1 + playtime_forever), q05), q95), 6) AS log_playtime_w
FROM (SELECT *, quantile_cont(ln(1 + playtime_forever), 0.05) OVER (PARTITION BY app_id) AS q05,
                quantile_cont(ln(1 + playtime_forever), 0.95) OVER (PARTITION BY app_id) AS q95 FROM inter)""")
def q_winsorize(spark, d):
    i = fx.interactions(spark, d).withColumn("log_playtime_w", F.log1p("playtime_forever"))
    return round_doubles(rel.winsorize(i, "log_playtime_w", "app_id").select("user_id", "app_id", "log_playtime_w"))


@register("minmax_gated_small_groups", "W3", fx.cte(inter=I) + """
SELECT user_id, app_id,
  round(CASE WHEN count(*) OVER w >= 5
        THEN (ln(1 + playtime_forever) - min(ln(1 + playtime_forever)) OVER w)
             / (max(ln(1 + playtime_forever)) OVER w - min(ln(1 + playtime_forever)) OVER w + 1e-6)
        ELSE 0 END, 6) AS minmax_playtime
FROM inter WINDOW w AS (PARTITION BY app_id, user_id % 7)""")
def q_minmax(spark, d):
    """Groups of a game and a seventh of its users: some above, some below the gate."""
    i = fx.interactions(spark, d).withColumn("minmax_playtime", F.log1p("playtime_forever"))
    i = i.withColumn("part", F.col("app_id") * 7 + F.col("user_id") % 7)
    return round_doubles(rel.minmax_in_group(i, "minmax_playtime", "part", 5)
                         .select("user_id", "app_id", "minmax_playtime"))


# Rows whose playtime is unknown: a null stays a null score where the game is scaled.
NULL_PLAYTIME_SQL = f"""
SELECT user_id, app_id, CASE WHEN (user_id + app_id) % 11 = 0 THEN NULL ELSE playtime_forever END AS playtime_forever,
       achievements FROM ({I})"""


def null_playtime(spark, d):
    gone = (F.col("user_id") + F.col("app_id")) % 11 == 0
    return fx.interactions(spark, d).withColumn("playtime_forever", F.when(~gone, F.col("playtime_forever")))


@register("relevance_score_null_playtime", "R1 W2 P24", fx.cte(inter=NULL_PLAYTIME_SQL, st=_stats_sql("inter")) + """,
x AS (SELECT i.user_id, i.app_id, s.*, ln(1 + i.playtime_forever) AS lp, ln(1 + coalesce(i.achievements, 0)) AS la
      FROM inter i JOIN st s USING (app_id)),
c AS (SELECT *, CASE WHEN lp IS NULL THEN NULL WHEN lp < p_lo THEN p_lo WHEN lp > p_hi THEN p_hi ELSE lp END AS cp,
             CASE WHEN la < a_lo THEN a_lo WHEN la > a_hi THEN a_hi ELSE la END AS ca FROM x),
s AS (SELECT user_id, app_id, has_ach, CASE WHEN n >= 5 THEN (cp - p_lo) / (p_hi - p_lo + 1e-6) ELSE 0 END AS mp,
             CASE WHEN n >= 5 THEN (ca - a_lo) / (a_hi - a_lo + 1e-6) ELSE 0 END AS ma FROM c)
SELECT user_id, app_id, round(CASE WHEN has_ach THEN 0.7 * mp + 0.3 * ma ELSE mp END, 6) AS relevance_score FROM s""")
def q_relevance_null(spark, d):
    r = rel.relevance(null_playtime(spark, d), item_count=fx.table(spark, d, "part").count())
    return round_doubles(r.select("user_id", "app_id", "relevance_score"))


@register("winsorize_null_playtime", "W2", fx.cte(inter=NULL_PLAYTIME_SQL) + """
SELECT user_id, app_id, round(CASE WHEN x IS NULL THEN NULL WHEN x < q05 THEN q05 WHEN x > q95 THEN q95 ELSE x END, 6) AS w
FROM (SELECT user_id, app_id, ln(1 + playtime_forever) AS x, quantile_cont(ln(1 + playtime_forever), 0.05) OVER (PARTITION BY app_id) AS q05,
             quantile_cont(ln(1 + playtime_forever), 0.95) OVER (PARTITION BY app_id) AS q95 FROM inter)""")
def q_winsorize_null(spark, d):
    i = null_playtime(spark, d).withColumn("w", F.log1p("playtime_forever"))
    return round_doubles(rel.winsorize(i, "w", "app_id").select("user_id", "app_id", "w"))


R2_SQL = fx.cte(inter=I) + f""",
newu AS (SELECT user_id, app_id, playtime_forever, achievements, true AS is_new
         FROM inter WHERE user_id % {TEST_USER_MOD} = 0),
hist AS (SELECT user_id, app_id, playtime_forever, achievements, false AS is_new
         FROM inter WHERE user_id % {TEST_USER_MOD} <> 0
           AND app_id IN (SELECT app_id FROM newu)),
allr AS (SELECT *, ln(1 + playtime_forever) AS lp, ln(1 + achievements) AS la FROM newu
         UNION ALL SELECT *, ln(1 + playtime_forever), ln(1 + achievements) FROM hist),
st AS (SELECT app_id, count(*) AS n, max(achievements) > 0 AS has_ach,
              min(lp) AS plo, max(lp) AS phi, min(la) AS alo, max(la) AS ahi FROM allr GROUP BY app_id),
sc AS (SELECT a.user_id, a.app_id, s.has_ach,
          CASE WHEN n >= 5 THEN (lp - plo) / (phi - plo + 1e-6) ELSE 0 END AS mp,
          CASE WHEN n >= 5 THEN (la - alo) / (ahi - alo + 1e-6) ELSE 0 END AS ma
       FROM allr a JOIN st s USING (app_id) WHERE a.is_new)
SELECT user_id, app_id,
       round(CASE WHEN has_ach THEN 0.7 * mp + 0.3 * ma ELSE mp END, 6) AS relevance_score FROM sc"""


@register("relevance_online_new_users", "R2 U1 J6", R2_SQL)
def q_relevance_online(spark, d):
    i = fx.interactions(spark, d)
    new = i.filter(F.col("user_id") % TEST_USER_MOD == 0)
    hist = i.filter(F.col("user_id") % TEST_USER_MOD != 0)
    return round_doubles(rel.relevance_incremental(new, hist).select("user_id", "app_id", "relevance_score"))
