"""Landed-page processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.operators.assemble import first_per_key

# Profile link forms (/id/<name>, /profiles/<number>) and the 17-digit numeric id.
PROFILE_PATH_RE = r"/(?:id|profiles)/[^/\"'<>\s]+"
PROFILE_PARTS_RE = r"/(id|profiles)/([^/\"'<>\s]+)"
NUMERIC_ID_RE = r"^[0-9]{17}$"
STORE_APP_RE = r"/app/(\d+)"


def extract_links(df: DataFrame, text: str, pattern: str, out: str = "link") -> DataFrame:
    """All matches of ``pattern`` in every text, one row per distinct match.

    ``regexp_extract_all`` runs per row in the scan stage; ``distinct`` is a
    partial + final aggregate, so repeated links collapse map-side."""
    return df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias(out)).distinct()


def extract_profile_links(pages: DataFrame, host: str, text: str = "html") -> DataFrame:
    """Unique profile URLs on ``host`` -> (kind, id); numeric ids kept only when 17 digits."""
    import re as _re
    links = extract_links(pages, text, r"https?://" + _re.escape(host) + PROFILE_PATH_RE)
    kind = F.regexp_extract("link", PROFILE_PARTS_RE, 1)
    ident = F.regexp_extract("link", PROFILE_PARTS_RE, 2)
    out = links.select("link", kind.alias("kind"), ident.alias("profile"))
    return out.filter((F.col("kind") == "id") | F.col("profile").rlike(NUMERIC_ID_RE))


def missing_sequence(spark: SparkSession, df: DataFrame, col: str, n: int | None = None,
                     start: int = 1) -> DataFrame:
    """Expected numbers start..n minus those stored (anti-join on the range).

    ``spark.range`` is generated in parallel partitions; the anti-join is a
    shuffle join sized by AQE.  With ``n=None`` the upper end is the stored max.
    """
    if n is None:
        n = df.agg(F.max(col)).first()[0] or (start - 1)
    expected = spark.range(start, int(n) + 1).withColumnRenamed("id", col)
    return expected.join(df.select(F.col(col).cast("long").alias(col)), col, "left_anti")


def extract_store_id(stores, store_id: int = 1) -> Column:
    """First record of store ``store_id`` whose URL holds '/app/<n>' -> n, else null."""
    c = F.col(stores) if isinstance(stores, str) else stores
    ids = F.transform(F.filter(c, lambda x: x["store"]["id"] == store_id),
                      lambda x: F.regexp_extract(x["url"], STORE_APP_RE, 1))
    return F.try_element_at(F.filter(ids, lambda v: v != ""), F.lit(1)).cast("long")


def dedup_ingest(new: DataFrame, done: DataFrame | None, key: str) -> DataFrame:
    """Drop ids already processed and repeated ids within the new batch
    (of repeated ids the first row by the other columns stays)."""
    fresh = first_per_key(new, key, [c for c in new.columns if c != key])
    if done is not None:
        fresh = fresh.join(done.select(key), key, "left_anti")
    return fresh
