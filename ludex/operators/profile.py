"""Aggregations, data profiles, set operations and reshapes.

Every per-key statistic here is a hash aggregate (partial per partition, then final
per key) rather than a window, so a key holding a third of the rows is
combined map-side and never shipped whole to one task.  Where a per-row
flag from a group statistic is needed, the small per-key result is joined
back (sized by AQE; null-safe where pandas would match NaN keys).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludex.operators.ordered import GROUP_ROWS, exact_quantiles, modes, quantiles_of_counts, running_total, small_groups, value_table
from ludex.session import cut_lineage, join_small


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# A1 -------------------------------------------------------------------------
def user_profile(df: DataFrame, user: str, cols: list[str], prefix: str = "user_preference_",
                 names: dict[str, str] | None = None, exclude_self: bool = False,
                 loo: dict[str, str] | None = None, known_users: int | None = None) -> DataFrame:
    """Per-user means of many columns attached to every row.

    ONE grouped aggregate of sums and counts for all columns (partial
    aggregation, so a user holding a third of the rows is combined map-side),
    joined back on the user (broadcast when ``known_users`` is within the
    bound, else sized by AQE with skew splitting).  ``exclude_self`` (or
    ``loo={col: out}`` for extra columns) gives the leave-one-out mean
    (sum - x) / (n - 1); no other row -> null.
    """
    names = names or {}
    loo = loo or {}
    allc = list(dict.fromkeys(list(cols) + list(loo)))
    aggs = []
    for c in allc:
        aggs += [F.sum(c).alias(f"_s_{c}"), F.count(c).alias(f"_c_{c}")]
    prof = df.groupBy(user).agg(*aggs)
    j = join_small(df, prof, user, "left", known_rows=known_users)

    def mean(c, self_out):
        s, n = F.col(f"_s_{c}"), F.col(f"_c_{c}")
        if self_out:
            own = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            own_n = F.when(F.col(c).isNotNull(), 1).otherwise(0)
            return F.try_divide(s - own, n - own_n)      # no other rows -> null
        return F.try_divide(s, n)                        # no non-null value -> null

    sel = [mean(c, exclude_self).cast("double").alias(names.get(c, prefix + c)) for c in cols]
    sel += [mean(c, True).cast("double").alias(out) for c, out in loo.items()]
    return j.select(*df.columns, *sel)


def user_profile_table(df: DataFrame, user: str, cols: list[str], prefix: str = "user_preference_",
                       names: dict[str, str] | None = None) -> DataFrame:
    """A1 without the join back: one row per user."""
    names = names or {}
    return df.groupBy(user).agg(*[F.avg(c).alias(names.get(c, prefix + c)) for c in cols])


# A2-A4 ----------------------------------------------------------------------
def median(df: DataFrame, col: str, by=None) -> DataFrame:
    """A2: exact median with linear interpolation, global or per key."""
    keys = _cols(by) if by else None
    return exact_quantiles(df, [col], [0.5], keys, bounded=small_groups(df, keys)).select(*(keys or []), F.col(col)[0].alias(f"{col}_median"))


def mode_min(df: DataFrame, col: str, by=None) -> DataFrame:
    """A3: most frequent value, ties -> smallest (nulls ignored)."""
    return modes(df, col, _cols(by) if by else None).withColumnRenamed("_mode", f"{col}_mode")


def quantiles(df: DataFrame, col: str, qs: list[float], by=None) -> DataFrame:
    """A4: exact percentiles (linear interpolation) per group."""
    keys = _cols(by) if by else None
    base = exact_quantiles(df, [col], qs, keys, bounded=small_groups(df, keys))
    return base.select(*(keys or []),
                       *[F.col(col)[i].alias(f"{col}_q{int(round(q * 100)):02d}") for i, q in enumerate(qs)])


# A5-A8 ----------------------------------------------------------------------
def cardinality(df: DataFrame, cols: list[str], list_cols: list[str] = ()) -> DataFrame:
    """A5: distinct non-null values per column (lists are counted per element)."""
    parts = []
    if cols:
        parts.append(df.agg(*[F.count_distinct(c).alias(c) for c in cols])
                     .unpivot([], list(cols), "column_name", "n_distinct"))
    for c in list_cols:
        parts.append(df.select(F.explode(c).alias("_v")).agg(F.count_distinct("_v").alias("n_distinct"))
                     .select(F.lit(c).alias("column_name"), "n_distinct"))
    return reduce(DataFrame.unionByName, parts)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows repeating an earlier key (nulls compare equal, like pandas)."""
    g = df.groupBy(*keys).count()
    return g.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def duplicated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Every row whose key occurs more than once (``keep=False``).

    The repeated keys are found by an aggregate and semi-joined back with a
    null-safe condition; a hot key is split by AQE skew handling."""
    dup = df.groupBy(*keys).count().filter("count > 1").select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(dup[f"_k_{k}"]) for k in keys])
    return df.join(dup, cond, "left_semi")


def null_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null count per column (one aggregate), long form, sorted descending."""
    cols = cols or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_null").orderBy(F.desc("n_null"), "column_name")


# A9 -------------------------------------------------------------------------
def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max; one row per column."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
                 F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    wide = df.agg(*aggs).withColumn("_g", F.lit(0))
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], bounded=small_groups(df)).select(F.lit(0).alias("_g"), *[F.col(c).alias(f"{c}__q") for c in cols])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__count").alias("count"),
                     F.col(f"{c}__mean").alias("mean"), F.col(f"{c}__std").alias("std"),
                     F.col(f"{c}__min").alias("min"), F.col(f"{c}__q")[0].alias("q25"),
                     F.col(f"{c}__q")[1].alias("q50"), F.col(f"{c}__q")[2].alias("q75"),
                     F.col(f"{c}__max").alias("max")) for c in cols]
    return wide.join(q, "_g").select(F.inline(F.array(*rows)))


# A10-A15 --------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, explode: bool = False, out: str = "n") -> DataFrame:
    """A10: counts per value (list elements when ``explode``), descending, label tie-break."""
    v = F.explode(col) if explode else F.col(col)
    return df.select(v.alias(col)).filter(F.col(col).isNotNull()).groupBy(col) \
        .agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(col))


def skew_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """Bias-corrected sample skewness G1 per column, sorted by |G1| desc.

    Spark's ``skewness`` is the population g1; G1 = g1 * sqrt(n(n-1)) / (n-2), null for n < 3."""
    aggs = []
    for c in cols:
        aggs += [F.skewness(c).alias(f"{c}__g"), F.count(c).alias(f"{c}__n")]
    wide = df.agg(*aggs)
    rows = []
    for c in cols:
        n = F.col(f"{c}__n").cast("double")
        g1 = F.when(n >= 3, F.col(f"{c}__g") * F.sqrt(n * (n - 1)) / (n - 2))
        rows.append(F.struct(F.lit(c).alias("column_name"), g1.alias("skewness")))
    return wide.select(F.inline(F.array(*rows))).orderBy(F.desc(F.abs("skewness")), "column_name")


def mean_std(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample std per column."""
    wide = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s"))])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("std"))
            for c in cols]
    return wide.select(F.inline(F.array(*rows)))


def cumulative_share(counts: DataFrame, label: str, n: str = "n") -> DataFrame:
    """Running fraction of label counts, largest first (label tie-break).

    A running sum in one task where the labels are few (counted with the total), else range-partitioned."""
    total, labels = counts.agg(F.sum(n), F.count(F.lit(1))).first()
    order = [F.desc(n), F.asc(label)]
    if labels <= GROUP_ROWS:
        run = counts.withColumn("cum_share", F.sum(n).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        run = running_total(counts, order, n, "cum_share")
    return run.withColumn("cum_share", F.col("cum_share") / F.lit(total))


def quality_report(df: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """One count per named condition, plus the row count."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in conds.items()], F.count(F.lit(1)).alias("n_rows"))


# A16-A22 --------------------------------------------------------------------
def game_means(df: DataFrame, item: str, cols: list[str]) -> DataFrame:
    """Per-item mean of raw values; no value -> 0."""
    return df.groupBy(item).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"{c}_mean") for c in cols])


def box_stats(df: DataFrame, col: str, by=None) -> DataFrame:
    """Five-number summary, IQR fences and outlier count per group.

    The rows are read once, into counts per (group, value); summary, quartiles
    and outliers are aggregates of those counts."""
    keys = _cols(by) if by else ["_g"]
    base = df if by else df.withColumn("_g", F.lit(0))
    counts = cut_lineage(value_table(base, [col], keys))
    st = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    q = quantiles_of_counts(counts, [col], [0.25, 0.5, 0.75], keys)
    same = reduce(lambda a, b: a & b, [F.col(f"s.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys])
    st = st.alias("s").join(q.alias("q"), same).select(
        *[F.col(f"s.{k}").alias(k) for k in keys], "n", "min", F.col(f"q.{col}")[0].alias("q1"), F.col(f"q.{col}")[1].alias("median"),
        F.col(f"q.{col}")[2].alias("q3"), "max")
    st = st.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
           .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    st = cut_lineage(st)
    fences = st.select(*[F.col(k).alias(f"_f{i}") for i, k in enumerate(keys)], "lo_fence", "hi_fence")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_f{i}")) for i, k in enumerate(keys)])
    far = counts.join(fences, same).filter((F.col("_v") < F.col("lo_fence")) | (F.col("_v") > F.col("hi_fence"))) \
        .groupBy(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)]).agg(F.sum("_n").alias("n_outliers"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)])
    res = st.join(far, same, "left").withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0))) \
        .drop(*[f"_o{i}" for i in range(len(keys))])
    return res if by else res.drop("_g")


def histogram(df: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over [min, max]; the max falls in the last bin.

    The edges are one scalar aggregate; counting is a grouped aggregate."""
    mn, mx = df.agg(F.min(col), F.max(col)).first()
    if mn is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (mx - mn) / bins if mx > mn else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(mn)) / F.lit(width)).cast("int"), F.lit(bins - 1)) if mx > mn \
        else F.lit(0)
    h = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return h.select("bin", (F.lit(mn) + F.col("bin") * width).alias("lower"),
                    (F.lit(mn) + (F.col("bin") + 1) * width).alias("upper"), "n")


def min_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keep rows of keys with at least ``n`` rows (count aggregate + semi-join)."""
    keep = df.groupBy(key).count().filter(F.col("count") >= n).select(key)
    return df.join(keep, key, "left_semi")


def max_list_length(df: DataFrame, col: str) -> int:
    """Fitted pad width of a list column."""
    return int(df.agg(F.coalesce(F.max(F.size(col)), F.lit(0))).first()[0])


# U1-U5 ----------------------------------------------------------------------
def union_by_name(*dfs: DataFrame) -> DataFrame:
    """U1"""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def unseen_values(train: DataFrame, test: DataFrame, col: str, explode: bool = False) -> DataFrame:
    """U4: values present in test but never in train (anti-join of distinct values)."""
    def vals(df):
        v = F.explode(col) if explode else F.col(col)
        return df.select(v.alias(col)).filter(F.col(col).isNotNull()).distinct()
    return vals(test).join(vals(train), col, "left_anti")


def melt(df: DataFrame, ids: list[str], cols: list[str], var: str = "variable", value: str = "value") -> DataFrame:
    """Wide -> long."""
    return df.unpivot(ids, cols, var, value)
