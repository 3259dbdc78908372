"""Role tables built from the driver's TPC-H-like tables.

users        <- customer (+ nation, region, first order date)
games        <- part
interactions <- orders JOIN lineitem grouped by (customer, part)

Each Spark builder has a SQL twin (``*_SQL``) used by the DuckDB oracle, so
the oracle strings and the DataFrame plans are built from the same mapping.
Only the columns a query needs are read (column pruning reaches the scan).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture mapping.
AS_OF = _dt.datetime(2002, 1, 1)           # "now" for account age
AS_OF_SQL = "TIMESTAMP '2002-01-01 00:00:00'"
LAT_NULL_MOD = 7                            # every c_custkey % 7 = 0 has no latitude
LON_NULL_MOD = 11                           # every c_custkey % 11 = 0 has no longitude
TRAIN_MOD = 5                               # parts with p_partkey % 5 = 0 are test-only games
HELD_OUT_BRAND = "Brand#25"                 # brand never seen in train


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------- interactions
def interactions(spark: SparkSession, sf_dir: str, min_quantity: float | None = None) -> DataFrame:
    """One row per (user, game): playtime = summed quantity, achievements =
    returned lines (null when every line of the pair is still open)."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus", "l_extendedprice")
    if min_quantity is not None:
        li = li.filter(F.col("l_quantity") >= F.lit(min_quantity))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
    return (j.groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("app_id"))
             .agg(F.sum("l_quantity").alias("playtime_forever"),
                  F.when(F.bool_and(F.col("l_linestatus") == "O"), F.lit(None).cast("long"))
                   .otherwise(F.count_if(F.col("l_returnflag") == "R")).alias("achievements"),
                  F.avg("l_extendedprice").alias("price_mean")))


def interactions_sql(min_quantity: float | None = None) -> str:
    where = f"WHERE l_quantity >= {min_quantity}" if min_quantity is not None else ""
    return f"""
SELECT o_custkey AS user_id, l_partkey AS app_id,
       sum(l_quantity) AS playtime_forever,
       CASE WHEN bool_and(l_linestatus = 'O') THEN NULL
            ELSE count_if(l_returnflag = 'R') END AS achievements,
       avg(l_extendedprice) AS price_mean
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
{where}
GROUP BY o_custkey, l_partkey"""


INTERACTIONS_SQL = interactions_sql()


# ------------------------------------------------------------------------ games
def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("app_id"),
        F.col("p_name").alias("game_name"),
        F.col("p_type").alias("game_type"),
        F.col("p_brand").alias("game_brand"),
        F.col("p_size").alias("game_size"),
        F.col("p_retailprice").alias("game_initial_price"),
        F.split(F.col("p_name"), " ").alias("game_genres"),
        F.concat(F.format_number(F.col("p_size") * 1000, 0), F.lit(" .. "),
                 F.format_number(F.col("p_size") * 2000, 0)).alias("game_owners"),
    )


GAMES_SQL = """
SELECT p_partkey AS app_id, p_name AS game_name, p_type AS game_type,
       p_brand AS game_brand, p_size AS game_size, p_retailprice AS game_initial_price,
       string_split(p_name, ' ') AS game_genres,
       format('{:,}', p_size * 1000) || ' .. ' || format('{:,}', p_size * 2000) AS game_owners
FROM part"""


# ------------------------------------------------------------------------ users
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    o = (table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
         .groupBy("o_custkey").agg(F.min("o_orderdate").alias("created")))
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left"))  # 25 rows
    u = c.join(geo, c.c_nationkey == geo.n_nationkey, "left").join(o, c.c_custkey == o.o_custkey, "left")
    return u.select(
        F.col("c_custkey").alias("user_id"),
        F.col("n_name").alias("user_country_code"),
        F.col("r_name").alias("user_region"),
        F.col("c_mktsegment").alias("user_segment"),
        F.when(F.col("c_custkey") % LAT_NULL_MOD == 0, F.lit(None).cast("double"))
         .otherwise(F.col("c_acctbal") / 110.0).alias("user_latitude"),
        F.when(F.col("c_custkey") % LON_NULL_MOD == 0, F.lit(None).cast("double"))
         .otherwise(-F.col("c_acctbal") / 55.0).alias("user_longitude"),
        F.col("created").alias("user_created"),
    )


USERS_SQL = f"""
SELECT c_custkey AS user_id, n_name AS user_country_code, r_name AS user_region,
       c_mktsegment AS user_segment,
       CASE WHEN c_custkey % {LAT_NULL_MOD} = 0 THEN NULL ELSE c_acctbal / 110.0 END AS user_latitude,
       CASE WHEN c_custkey % {LON_NULL_MOD} = 0 THEN NULL ELSE -c_acctbal / 55.0 END AS user_longitude,
       oc.created AS user_created
FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created FROM orders GROUP BY o_custkey) oc
       ON c_custkey = oc.o_custkey"""


def cte(**parts: str) -> str:
    """``WITH a AS (...), b AS (...)`` from keyword SQL fragments."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in parts.items()) + "\n"
