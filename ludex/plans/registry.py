"""Registry of named queries (Spark builder + DuckDB oracle SQL)."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, str] = {}   # query name -> SURVEY ids it exercises

DIGITS = 6  # fixed value: floats are compared after rounding to 6 places


def register(name: str, ops: str, sql: str | None = None):
    def deco(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir, *a, **k):
            ship_package(spark)              # Python workers must import ludex
            return fn(spark, sf_dir, *a, **k)
        QUERIES[name] = run
        OPERATORS[name] = ops
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every float/double column (the oracle SQL rounds the same way)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            exprs.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)
