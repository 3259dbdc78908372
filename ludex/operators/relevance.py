"""Per-item relevance scores.

The per-game statistics (row count, any-achievement flag, 5 % / 95 %
percentiles of the log values) are one grouped aggregate with map-side
partial aggregation; they are joined back to the fact rows instead of
running a window, so a hot game never has to sit in one task: the
aggregate is combined per partition first and the join-back is sized by
AQE (broadcast of the per-game table, or sort-merge with skew splitting).

After clipping to [q_lo, q_hi] the group minimum is q_lo and the maximum is
q_hi, so winsorize + min-max collapse to one expression over the stats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ludex.operators.ordered import exact_quantiles, small_groups
from ludex.session import cut_lineage, join_small

EPS = 1e-6  # fixed value: denominator guard of the min-max scaling


def group_flag(df: DataFrame, col: str, by: str, out: str) -> DataFrame:
    """Per-group ``max(col) > 0`` broadcast to every row of the group."""
    flags = df.groupBy(by).agg((F.max(col) > 0).alias(out))
    return df.join(flags, by, "left")


def _clip(x: Column, lo: Column, hi: Column) -> Column:
    """``x`` within [lo, hi]; null stays null (``least`` and ``greatest`` skip nulls)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def winsorize(df: DataFrame, col: str, by: str, lo: float = 0.05, hi: float = 0.95,
              out: str | None = None) -> DataFrame:
    """Clip ``col`` to the per-group [lo, hi] percentiles (linear interpolation); null stays null."""
    out = out or col
    q = exact_quantiles(df, [col], [lo, hi], [by], bounded=small_groups(df, [by])).withColumnRenamed(col, "_q")
    j = df.join(q, by, "left")
    clipped = _clip(F.col(col), F.col("_q")[0], F.col("_q")[1])
    return j.withColumn(out, clipped).drop("_q")


def minmax_in_group(df: DataFrame, col: str, by: str, min_rows: int = 5,
                    out: str | None = None) -> DataFrame:
    """(x - min) / (max - min + 1e-6) per group; groups below ``min_rows`` rows -> 0."""
    out = out or col
    s = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n"), F.min(col).alias("_mn"), F.max(col).alias("_mx"))
    j = df.join(s, by, "left")
    val = F.when(F.col("_n") >= min_rows,
                 (F.col(col) - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + EPS)).otherwise(F.lit(0.0))
    return j.withColumn(out, val).drop("_n", "_mn", "_mx")


def _scaled(x: Column, lo: Column, hi: Column, n: Column, min_users: int, clip: bool) -> Column:
    v = _clip(x, lo, hi) if clip else x
    return F.when(n >= min_users, (v - lo) / (hi - lo + EPS)).otherwise(F.lit(0.0))


def relevance(df: DataFrame, item: str = "app_id", playtime: str = "playtime_forever",
              achievements: str = "achievements", w1: float = 0.7, w2: float = 0.3,
              min_users: int = 5, winsor: tuple[float, float] | None = (0.05, 0.95),
              out: str = "relevance_score", keep_parts: bool = False,
              item_count: int | None = None) -> DataFrame:
    """Offline relevance score in [0, 1) per (user, game).

    achievements null -> 0; log1p; winsorize per game; min-max per game with
    the ``min_users`` gate; ``w1 * playtime + w2 * achievements`` when the game
    has any achievement, else the playtime part only.

    Rows without a game id have no game group and are dropped.  The per-game
    statistics table has one row per game: with ``item_count`` (e.g. the
    catalogue size) within the broadcast bound it is broadcast, so the fact
    rows are never shuffled by game (no hot-game task); otherwise AQE sizes
    the join at runtime.  The fact-grain rows are staged once; percentiles are
    exact and distributed (no game's values in one task).  A null playtime
    keeps a null score where the game is scaled (0 below the gate).
    """
    ach = F.coalesce(F.col(achievements).cast("double"), F.lit(0.0))
    lp, la = F.log1p(F.col(playtime)), F.log1p(ach)
    base = df.filter(F.col(item).isNotNull()).withColumn("_lp", lp).withColumn("_la", la)
    if winsor is not None:
        lo, hi = winsor
        base = cut_lineage(base)
        q = exact_quantiles(base, ["_lp", "_la"], [lo, hi], [item], item_count, small_groups(base, [item]))
        stats = base.groupBy(item).agg(
            F.count(F.lit(1)).alias("_n"), (F.max("_la") > 0).alias("_has_ach"))
        ends = {"_plo": "_lp", "_phi": "_lp", "_alo": "_la", "_ahi": "_la"}
        stats = stats.join(q.select(item, *[F.col(c)[i % 2].alias(name) for i, (name, c) in enumerate(ends.items())]), item)
        p_lo, p_hi, a_lo, a_hi = map(F.col, ends)
    else:
        stats = base.groupBy(item).agg(
            F.count(F.lit(1)).alias("_n"), (F.max("_la") > 0).alias("_has_ach"),
            F.min("_lp").alias("_plo"), F.max("_lp").alias("_phi"),
            F.min("_la").alias("_alo"), F.max("_la").alias("_ahi"))
        p_lo, p_hi, a_lo, a_hi = F.col("_plo"), F.col("_phi"), F.col("_alo"), F.col("_ahi")
    j = join_small(base, stats, item, "inner", known_rows=item_count)
    mp = _scaled(F.col("_lp"), p_lo, p_hi, F.col("_n"), min_users, winsor is not None)
    ma = _scaled(F.col("_la"), a_lo, a_hi, F.col("_n"), min_users, winsor is not None)
    score = F.when(F.col("_has_ach"), w1 * mp + w2 * ma).otherwise(mp)
    j = j.withColumn(out, score)
    if keep_parts:
        j = j.withColumn("minmax_playtime", mp).withColumn("minmax_achievements", ma) \
             .withColumn("game_has_ach", F.col("_has_ach").cast("int"))
    j = j.drop(*[c for c in j.columns if c.startswith("_")])
    if winsor is not None:
        j.stage_path = base.stage_path                       # what the rows are read from, for ``drop_stage``
    return j


def relevance_incremental(new: DataFrame, history: DataFrame, item: str = "app_id",
                          user: str = "user_id", playtime: str = "playtime_forever",
                          achievements: str = "achievements", w1: float = 0.7, w2: float = 0.3,
                          min_users: int = 5, out: str = "relevance_score") -> DataFrame:
    """R2: online relevance of new users' rows against the history.

    History is first restricted (semi-join) to the games the new users touch,
    then appended; no winsorize and no null fill: a null achievement stays
    out of the min/max and gives a null score when the game has achievements.
    Only the new users' rows are returned.
    """
    cols = [user, item, playtime, achievements]
    touched = new.select(item).distinct()
    hist = history.select(*cols).join(touched, item, "left_semi").withColumn("_new", F.lit(False))
    allr = hist.unionByName(new.select(*cols).withColumn("_new", F.lit(True)))
    allr = allr.withColumn("_lp", F.log1p(F.col(playtime))).withColumn("_la", F.log1p(F.col(achievements)))
    stats = allr.groupBy(item).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(achievements) > 0).alias("_has_ach"),
        F.min("_lp").alias("_plo"), F.max("_lp").alias("_phi"),
        F.min("_la").alias("_alo"), F.max("_la").alias("_ahi"))
    j = allr.filter("_new").join(stats, item, "left")
    mp = _scaled(F.col("_lp"), F.col("_plo"), F.col("_phi"), F.col("_n"), min_users, False)
    ma = _scaled(F.col("_la"), F.col("_alo"), F.col("_ahi"), F.col("_n"), min_users, False)
    # a null achievement makes the achievement part null (pandas NaN arithmetic)
    ma = F.when(F.col("_la").isNull() & (F.col("_n") >= min_users), F.lit(None).cast("double")).otherwise(ma)
    score = F.when(F.col("_has_ach") == True, w1 * mp + w2 * ma).otherwise(mp)  # noqa: E712
    return j.withColumn(out, score).drop(*[c for c in j.columns if c.startswith("_")])
