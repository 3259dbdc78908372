"""Joins and fact assembly."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludex.session import join_small


def first_per_key(df: DataFrame, key, order: list[str]) -> DataFrame:
    """Keep the first row per key under an explicit order.

    Implemented as ``min(struct(order..., rest...))`` per key: partial
    aggregates per task, then one per key (no window over a hot key; Spark
    sorts for a struct minimum); later columns break ties, so the result is
    deterministic.  Map columns cannot be ordered and must be cast before."""
    keys = [key] if isinstance(key, str) else list(key)
    order = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest])
    g = df.groupBy(*keys).agg(F.min(packed).alias("_m"))
    return g.select(*keys, *[F.col(f"_m._o{i}").alias(c) for i, c in enumerate(order)],
                    *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*df.columns)


def assemble_facts(inter: DataFrame, catalog: DataFrame, market: DataFrame | None = None,
                   inter_key: str = "app_id", catalog_key: str = "app_id", market_key: str = "app_id",
                   order: list[str] | None = None) -> DataFrame:
    """Interactions JOIN catalog JOIN market (inner, differently named keys).

    Each dimension is de-duplicated on its key first (W4), so the join can
    never multiply fact rows; the dimension sides are then sized by AQE."""
    cat = first_per_key(catalog, catalog_key, order or [c for c in catalog.columns if c != catalog_key][:1])
    out = inter.join(cat.withColumnRenamed(catalog_key, "_ck"), inter[inter_key] == F.col("_ck"), "inner").drop("_ck")
    if market is not None:
        mk = first_per_key(market, market_key, [c for c in market.columns if c != market_key][:1])
        out = out.join(mk.withColumnRenamed(market_key, "_mk"), out[inter_key] == F.col("_mk"), "inner").drop("_mk")
    return out


def attach(df: DataFrame, dim: DataFrame, key, known_rows: int | None = None) -> DataFrame:
    """Left join of a dimension or fitted lookup on a key."""
    return join_small(df, dim, key, "left", known_rows)


def attach_embeddings(df: DataFrame, emb: DataFrame, keys: list[str], col: str, dim: int,
                      fill: float = 0.0, each: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """Left join on a composite key after de-duplicating the right side;
    a miss (or a vector of the wrong length) becomes the fill vector.

    ``each``: named columns of the vector to attach in its place; they are
    computed once a key, not once a row, and for a miss of the fill vector."""
    right = first_per_key(emb.select(*keys, col), keys, keys)
    fillv = F.array_repeat(F.lit(fill).cast("float"), dim)
    ok = F.col(col).isNotNull() & (F.size(col) == dim)
    vector = F.when(ok, F.col(col)).otherwise(fillv)
    if each is None:
        return df.join(right, keys, "left").withColumn(col, vector)
    made = right.select(*keys, vector.alias(col)).select(*keys, F.lit(True).alias("_met"), *each(F.col(col)))
    names = [c for c in made.columns if c not in (*keys, "_met")]
    none = df.sparkSession.range(1).select(fillv.alias(col)).select(*each(F.col(col))).first()     # one row: the fill vector's columns
    j = df.join(made, keys, "left")
    return j.withColumns({c: F.when(F.col("_met"), F.col(c)).otherwise(F.lit(none[c])) for c in names}).drop("_met")


def join_embeddings(df: DataFrame, emb: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on (user, game) after de-duplicating both sides."""
    left = first_per_key(df, keys, [c for c in df.columns if c not in keys])
    right = first_per_key(emb, keys, [c for c in emb.columns if c not in keys])
    return left.join(right, keys, "inner")


def semi(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """``isin(set)``."""
    return df.join(keys, on, "left_semi")


def anti(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    """``~isin(set)``; a null in ``keys`` never hides other rows (unlike NOT IN)."""
    return df.join(keys, on, "left_anti")


def _unit_hash(user: Column, seed: int) -> Column:
    """Deterministic value in [0, 1) per key (no rand() over unordered partitions)."""
    return F.pmod(F.xxhash64(user, F.lit(seed)), F.lit(1_000_000)).cast("double") / 1_000_000.0


def split_by_user(df: DataFrame, user: str = "user_id", train_frac: float = 0.8, seed: int = 42,
                  out: str = "split", exact: bool = False) -> DataFrame:
    """User-stratified split.

    Default: a per-user hash decides (every row of a user lands on the same
    side), computed per row -- no shuffle of the facts, shares are ~80/20.
    ``exact=True``: users are numbered in seeded-hash order (C11, distributed)
    and exactly ceil((1 - train_frac) * n) of them go to test, as the
    reference's splitter does; that costs one join of the user table."""
    if not exact:
        return df.withColumn(out, F.when(_unit_hash(F.col(user), seed) < train_frac, F.lit("train"))
                             .otherwise(F.lit("test")))
    idx = _user_order(df, user, seed)
    n = idx.count()
    n_test = int(math.ceil((1.0 - train_frac) * n))
    lab = idx.select(user, F.when(F.col("_idx") < n_test, F.lit("test")).otherwise(F.lit("train")).alias(out))
    return df.join(lab, user, "left")


def _user_order(df: DataFrame, user: str, seed: int) -> DataFrame:
    from ludex.operators.encode import build_index
    return build_index(df, user, "_idx", order=F.xxhash64(F.col(user), F.lit(seed)))


def user_folds(df: DataFrame, user: str = "user_id", k: int = 5, seed: int = 42, out: str = "fold",
               exact: bool = True) -> DataFrame:
    """K user folds; all rows of a user share a fold.

    ``exact`` (default, the reference's rule): users in a seeded permutation
    (hash order, numbered distributively by C11), k folds of floor(n/k)
    users, the remainder in the last fold; one join of the user table.
    ``exact=False``: fold = hash mod k per row, no join, sizes vary."""
    if not exact:
        return df.withColumn(out, F.pmod(F.xxhash64(F.col(user), F.lit(seed)), F.lit(k)).cast("int"))
    idx = _user_order(df, user, seed)
    n = idx.count()
    size = max(n // k, 1)
    lab = idx.select(user, F.least(F.floor(F.col("_idx") / size), F.lit(k - 1)).cast("int").alias(out))
    return df.join(lab, user, "left")


def game_catalog(df: DataFrame, item: str = "app_id", prefix: str = "game_") -> DataFrame:
    """One row per game with its ``game_*`` columns, first by those columns."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return first_per_key(df.select(item, *cols), item, cols[:1])


# Largest group (rows) that a per-key window may hold in one task.
WINDOW_GROUP_MAX_ROWS = 2_000_000


def max_group_rows(df: DataFrame, key: str) -> int:
    """Size of the largest ``key`` group (one aggregate, partial per partition)."""
    r = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).agg(F.max("_c")).first()[0]
    return int(r or 0)


def rank_within_group(df: DataFrame, key: str, order: list[Column], out: str = "pos",
                      bounded: bool | None = None) -> DataFrame:
    """1-based position of every row inside its ``key`` group under ``order``
    (``row_number`` semantics; give ``order`` a unique tie-break for
    deterministic positions; null keys form a group).

    Two plans of one function of the data.  When the largest group is proven
    small (``bounded``, or one count aggregate against
    ``WINDOW_GROUP_MAX_ROWS``) a plain per-key window is used.  Otherwise no
    window spans a whole group: the rows are range-partitioned on (key, order)
    and written with their partition id (so both passes agree); per
    (partition, key) counts give each key's offset in a partition, and the
    final ``row_number`` runs per (partition, key)."""
    if bounded is None:
        bounded = max_group_rows(df, key) <= WINDOW_GROUP_MAX_ROWS
    if bounded:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    from ludex.session import cut_lineage
    ordered = df.repartitionByRange(F.col(key), *order)
    part = cut_lineage(ordered.withColumn("_p", F.spark_partition_id()))
    counts = part.groupBy(F.col("_p").alias("_op"), F.col(key).alias("_ok")).agg(F.count(F.lit(1)).alias("_c"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.partitionBy("_ok").orderBy("_op").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    w = Window.partitionBy("_p", key).orderBy(*order)
    same = (F.col("_p") == F.col("_op")) & F.col(key).eqNullSafe(F.col("_ok"))
    return part.join(offs, same).withColumn(out, F.col("_off") + F.row_number().over(w)) \
        .drop("_p", "_op", "_ok", "_off")
