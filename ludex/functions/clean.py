"""Column-level cleaning expressions.

All of these are native Catalyst expressions (no Python UDF), so they stay
inside whole-stage codegen and are applied in the same projection as the
scan.  Functions taking a Column return a Column; functions taking a
DataFrame return a DataFrame.
"""

from __future__ import annotations

import calendar
import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must equal the reference's.
COMPANY_SUFFIXES = ["inc", "llc", "ltd"]          # removed from company names (substring)
RATING_KEYS = [5, 4, 3, 1]                          # rating ids pivoted to percent columns
DAYS_PER_MONTH = 30.44                               # account age divisor
BIN_EDGES = [-0.00001, 0.00001, 0.2, 0.4, 0.6, 0.8, 1.0]
BIN_LABELS = ["None", "very low", "low", "medium", "high", "very high"]
DISCOUNT_EPS = 0.000001
MISSING = "Missing"
UNKNOWN = "Unknown"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# P1, P2, P3 -------------------------------------------------------------------
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by map (missing names are ignored, like pandas)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """P2"""
    return df.drop(*cols)


def filter_rows(df: DataFrame, cond: Column) -> DataFrame:
    """A null predicate drops the row, as a pandas boolean mask does --
    which is what ``filter`` already does; the predicate is left bare so that
    Catalyst can push it into the parquet scan."""
    return df.filter(cond)


# P4-P8 ------------------------------------------------------------------------
def normalize_names(c, whole_word: bool = False) -> Column:
    """Lower, delete '.', delete inc/llc/ltd (anywhere, or whole words
    only with ``whole_word``), split on ',', trim, drop empty entries."""
    s = F.replace(F.lower(_c(c)), F.lit("."), F.lit(""))
    for suf in COMPANY_SUFFIXES:
        if whole_word:
            s = F.regexp_replace(s, rf"\b{suf}\b", "")
        else:
            s = F.replace(s, F.lit(suf), F.lit(""))
    parts = F.transform(F.split(s, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def empty_to_zero(c) -> Column:
    """P5: '' -> 0, else the integer value."""
    return F.when(_c(c) == "", F.lit(0)).otherwise(_c(c).cast("int"))


def parse_range(c) -> tuple[Column, Column]:
    """P6: 'a .. b' with thousands commas -> (a, b) as long."""
    parts = F.split(F.replace(_c(c), F.lit(","), F.lit("")), r" \.\. ")
    return parts[0].cast("long"), F.element_at(parts, -1).cast("long")


def to_double(c) -> Column:
    """Strict numeric cast."""
    return _c(c).cast("double")


def to_double_lenient(c) -> Column:
    """``to_numeric(errors='coerce')``: unparsable -> null."""
    return _c(c).try_cast("double")


# P9-P11 -----------------------------------------------------------------------
def date_parts(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Year / month / day of a date string or timestamp."""
    d = F.to_date(F.col(col))
    return df.withColumns({f"{prefix}_year": F.year(d), f"{prefix}_month": F.month(d),
                           f"{prefix}_day": F.dayofmonth(d)})


def epoch_to_timestamp(c) -> Column:
    """P10: epoch seconds (any type) -> timestamp (an instant); bad -> null."""
    return F.timestamp_seconds(_c(c).try_cast("long"))


def epoch_seconds(c, ntz: bool = True) -> Column:
    """Seconds since 1970-01-01 00:00 UTC, independent of the session time zone:
    a TIMESTAMP_NTZ is read as a UTC wall clock (field arithmetic), a
    TIMESTAMP is an instant."""
    x = _c(c)
    if not ntz:
        return F.unix_seconds(x)
    return (F.unix_date(F.to_date(x)).cast("long") * 86400 + F.hour(x) * 3600 + F.minute(x) * 60
            + F.second(x))


def age_months(c, as_of: _dt.datetime, ntz: bool = True) -> Column:
    """(as_of - created) / 30.44 days, as double (``as_of`` read as UTC)."""
    as_of_s = calendar.timegm(as_of.utctimetuple()) if as_of.tzinfo else calendar.timegm(as_of.timetuple())
    return (F.lit(float(as_of_s)) - epoch_seconds(c, ntz).cast("double")) / (DAYS_PER_MONTH * 86400.0)


# P12-P17 ----------------------------------------------------------------------
def pivot_array(c, key: str, val: str, keys: list, default: float = 0.0,
                names: list[str] | None = None) -> list[Column]:
    """array<struct> -> one column per key (last match wins, default if absent)."""
    names = names or [f"{key}_{k}" for k in keys]
    def matcher(k):
        return lambda x: x[key] == F.lit(k)
    out = []
    for k, n in zip(keys, names):
        hit = F.filter(_c(c), matcher(k))
        out.append(F.coalesce(F.try_element_at(hit, F.lit(-1))[val].cast("double"), F.lit(default)).alias(n))
    return out


def map_keys_of(df: DataFrame, col: str) -> list[str]:
    """Key set of a map column (fit step of P13); one distinct over exploded keys."""
    return sorted(r[0] for r in df.select(F.explode(F.map_keys(col))).distinct().collect())


def map_to_columns(c, keys: list[str], fmt: str = "{}") -> list[Column]:
    """Map -> one double column per fitted key; absent -> null."""
    return [F.try_element_at(_c(c), F.lit(k)).cast("double").alias(fmt.format(k)) for k in keys]


def names_of(c, path: list[str], skip_missing: str | None = None) -> Column:
    """List of structs -> list of nested names; null list -> [];
    entries lacking ``skip_missing`` are skipped."""
    arr = _c(c)
    if skip_missing:
        arr = F.filter(arr, lambda x: x[skip_missing].isNotNull())

    def get(x):
        for p in path:
            x = x[p]
        return x
    return F.coalesce(F.transform(arr, get), F.array().cast(T.ArrayType(T.StringType())))


def field_or(c, field: str, default: str = MISSING) -> Column:
    """Struct field, else a constant."""
    return F.coalesce(_c(c)[field], F.lit(default))


def exists_in(c, pred) -> Column:
    """Any element satisfies ``pred``; a null list -> false."""
    return F.coalesce(F.exists(_c(c), pred), F.lit(False))


def count_where(c, pred) -> Column:
    """Number of elements satisfying ``pred``; a null list -> null."""
    return F.when(_c(c).isNull(), F.lit(None).cast("int")).otherwise(F.size(F.filter(_c(c), pred)))


def flatten_users(df: DataFrame, user: str, games: str, item_field: str = "appid",
                  value_field: str = "playtime_forever") -> DataFrame:
    """One row per owned game; missing playtime -> 0; users without games drop out."""
    keep = [x for x in df.columns if x != games]
    e = df.select(*keep, F.explode(games).alias("_g"))
    return e.select(*keep, F.col(f"_g.{item_field}").alias("app_id"),
                    F.coalesce(F.col(f"_g.{value_field}"), F.lit(0)).alias(value_field))


# P19-P22 ----------------------------------------------------------------------
def lookup_coordinates(users: DataFrame, countries: DataFrame, states: DataFrame, cities: DataFrame,
                       country: str = "country", state: str = "state", city: str = "city") -> DataFrame:
    """City -> state -> country fallback (the city level is consulted only
    when the state is known).  Each place table is counted and broadcast only
    within the broadcast bound; otherwise AQE sizes the join."""
    from ludex.session import join_small
    cc = countries.select(F.col(country).alias("_c1"), F.col("coordinates").alias("_cc"))
    sc = states.select(F.col(country).alias("_c2"), F.col(state).alias("_s2"), F.col("coordinates").alias("_sc"))
    ci = cities.select(F.col(country).alias("_c3"), F.col(state).alias("_s3"), F.col(city).alias("_i3"),
                       F.col("coordinates").alias("_ic"))
    j = join_small(users, cc, users[country] == F.col("_c1"), "left", known_rows=cc.count())
    j = join_small(j, sc, (j[country] == F.col("_c2")) & (j[state] == F.col("_s2")), "left", known_rows=sc.count())
    j = join_small(j, ci, (j[country] == F.col("_c3")) & (j[state] == F.col("_s3")) & (j[city] == F.col("_i3")),
                   "left", known_rows=ci.count())
    coord = F.when(F.col("_sc").isNotNull(), F.coalesce(F.col("_ic"), F.col("_sc"))).otherwise(F.col("_cc"))
    return j.withColumn("coordinates", coord).drop("_c1", "_cc", "_c2", "_s2", "_sc", "_c3", "_s3", "_i3", "_ic")


def split_coordinates(c) -> tuple[Column, Column]:
    """P20: 'lat,lon' -> two doubles when exactly two parts both parse, else both null."""
    parts = F.split(_c(c), ",")
    lat, lon = parts[0].try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    ok = (F.size(parts) == 2) & lat.isNotNull() & lon.isNotNull()
    return F.when(ok, lat), F.when(ok, lon)


def invalid_geo(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows whose coordinates are out of range."""
    return df.filter((F.col(lat) < -90) | (F.col(lat) > 90) | (F.col(lon) < -180) | (F.col(lon) > 180))


# P23-P31 ----------------------------------------------------------------------
def discount(init, cur) -> Column:
    """Round-half-even((init - cur) / (init + 1e-6))."""
    return F.bround((_c(init) - _c(cur)) / (_c(init) + DISCOUNT_EPS), 0)


def years_since(c, base) -> Column:
    """Value minus a fitted (or fixed) base year."""
    return _c(c) - (base if isinstance(base, Column) else F.lit(base))


def infer_bool(train: DataFrame, cols: list[str]) -> list[str]:
    """Numeric columns whose train value set is exactly {0, 1} (one aggregate)."""
    aggs = []
    for c in cols:
        aggs += [F.bool_and(F.col(c).isin(0, 1)).alias(f"{c}__b"), F.min(c).alias(f"{c}__lo"), F.max(c).alias(f"{c}__hi")]
    r = train.agg(*aggs).first()
    return [c for c in cols if r[f"{c}__b"] and r[f"{c}__lo"] == 0 and r[f"{c}__hi"] == 1]


def first_or(c, default: str | None = UNKNOWN) -> Column:
    """First element of a list, else a default."""
    first = F.try_element_at(_c(c), F.lit(1))
    return first if default is None else F.coalesce(first, F.lit(default))


def flatten_vector(c, d: int, prefix: str, fill: float = 0.0) -> list[Column]:
    """Array of length d -> d columns; null or wrong length -> fill."""
    ok = _c(c).isNotNull() & (F.size(_c(c)) == d)
    return [F.when(ok, _c(c)[i].cast("double")).otherwise(F.lit(fill)).alias(f"{prefix}_{i}") for i in range(d)]


def cut(c, edges: list[float] = BIN_EDGES, labels: list[str] = BIN_LABELS) -> Column:
    """Right-closed bins ``lo < x <= hi``; outside the edges -> null."""
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (_c(c) > lo) & (_c(c) <= hi)
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def add_prefix(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """P32"""
    return df.withColumnsRenamed({c: prefix + c for c in cols})


def strip_prefix(c, prefix: str) -> Column:
    """P32 on values: drop a leading prefix."""
    return F.when(_c(c).startswith(prefix), F.substring(_c(c), len(prefix) + 1, 1 << 30)).otherwise(_c(c))


def display_name(name, key) -> Column:
    """P33: 'name (ID: n)'."""
    return F.format_string("%s (ID: %d)", _c(name), _c(key).cast("long"))


def hours_to_minutes(c) -> Column:
    """Hours -> minutes; negative -> null."""
    return F.when(_c(c) >= 0, _c(c) * 60.0)


def years_to_months(c) -> Column:
    """P34"""
    return F.when(_c(c) >= 0, _c(c) * 12.0)


def fmt4(c) -> Column:
    """P35: '%.4f'."""
    return F.format_string("%.4f", _c(c))


def harmonize(df: DataFrame) -> DataFrame:
    """One plain type per kind: integers -> long, floats -> double."""
    out = []
    for f in df.schema.fields:
        t = f.dataType
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append(F.col(f.name).cast("long").alias(f.name))
        elif isinstance(t, (T.FloatType, T.DecimalType)):
            out.append(F.col(f.name).cast("double").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
