"""Order statistics that no single task holds: running totals, exact quantiles, modes.

Values are first counted per (group, value) with partial aggregates, so a hot
group or value collapses in its own tasks.  A quantile is found by radix
selection (``quantiles_of_counts``): counts per group and digit, then the values
of the digits that hold a wanted rank.  Running totals range-partition their rows;
sums per (partition, group) give every partition its offset, and the running sum
is a window inside one partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludex.session import BROADCAST_MAX_BYTES, cut_lineage

DIGITS = 4096              # of a value between the ends of its group
GROUP_ROWS = 1_000_000     # of a group whose values an aggregate may hold


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right)])


def running_total(df: DataFrame, order: list[Column], value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with the running sum of ``value`` (own row included) under ``order``, per ``by`` group (nulls a group)."""
    by = by or []
    ranged = df.repartitionByRange(*[F.col(c) for c in by], *order)
    part = cut_lineage(ranged.withColumn("_p", F.spark_partition_id()))
    keys = [f"_k{i}" for i in range(len(by))]
    sums = part.groupBy(F.col("_p").alias("_q"), *[F.col(c).alias(k) for c, k in zip(by, keys)]).agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)   # rows: partitions
    sums = sums.withColumn("_off", F.coalesce(F.sum("_s").over(before), F.lit(0))).drop("_s")
    inside = Window.partitionBy("_p", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cond = F.col("_p") == F.col("_q")
    return (part.join(sums, cond & _same(by, keys) if by else cond)
            .withColumn(out, F.col("_off") + F.sum(value).over(inside)).drop("_p", "_q", "_off", *keys))


def _long(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``by..., _c`` (column number), ``_v`` (double), ``_n``: one row per row and column; null values weigh nothing."""
    pairs = F.array(*[F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(cols)])
    long = df.select(*by, F.inline(pairs)) if len(cols) > 1 else \
        df.select(*by, F.lit(0).alias("_c"), F.col(cols[0]).cast("double").alias("_v"))
    return long.withColumn("_n", F.when(F.col("_v").isNull(), 0).otherwise(1).cast("long"))


def value_table(df: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """``by..., _c`` (column number), ``_v`` (double), ``_n``: rows per group and value; null values weigh nothing."""
    return _long(df, cols, by).groupBy(*by, "_c", "_v").agg(F.sum("_n").alias("_n"))


def small_groups(df: DataFrame, by: list[str] | None = None) -> bool:
    """Whether no group has over ``GROUP_ROWS`` rows (one aggregate)."""
    n = df.groupBy(*by).count().agg(F.max("count")).first()[0] if by else df.count()
    return (n or 0) <= GROUP_ROWS


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None,
                    known_groups: int | None = None, bounded: bool = False) -> DataFrame:
    """Exact quantiles (linear interpolation, nulls ignored) per group: ``by...`` and per column an array of doubles.

    Groups without values give nulls; without ``by`` there is one row, whatever the input.  Two plans of one
    function: radix selection, which reads ``df`` three times (a caller stages what is dear to compute), or,
    where groups are ``bounded`` (see ``small_groups``), one aggregate that holds the values of a group.
    ``known_groups``: a proven bound on the number of groups."""
    if bounded:
        nulls = F.array(*[F.lit(None).cast("double") for _ in qs])
        aggs = [F.coalesce(F.percentile(F.col(c).cast("double"), [float(q) for q in qs]), nulls).alias(c) for c in cols]
        return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    keys = by or ["_g"]
    base = df if by else df.withColumn("_g", F.lit(0))
    long = _long(base, cols, keys)
    return quantiles_of_counts(long if by else long.where("_v IS NOT NULL"), cols, qs, keys, not by, known_groups if by else 1)


def _octaves(v: Column) -> Column:
    """A non-decreasing map of the finite doubles to about +-2100: their octave, counted from the smallest positive double."""
    octave = F.log2(F.abs(v)) + 1075                    # log2 is semi-monotonic
    return F.when(v > 0, octave).when(v < 0, -octave).otherwise(F.lit(0.0))


def _digit(v: Column, least: Column, most: Column) -> Column:
    """The first digit of a value between the finite ends of its group; nulls, infinities and NaN have their own.

    The sum of a linear and a logarithmic digit: neither decreases, so their sum does not, and it
    tells values apart that either one does (evenly spread ones, or ones of all magnitudes)."""
    inside = F.lit(0)
    for scale in (lambda x: x / 2, _octaves):            # half: the width stays finite
        lo, width = scale(least), scale(most) - scale(least)
        inside += F.when(width > 0, F.least(F.floor((scale(v) - lo) / width * DIGITS), F.lit(DIGITS - 1)).cast("int")).otherwise(F.lit(0))
    inf = F.lit(float("inf"))
    return (F.when(v.isNull(), -2).when(F.isnan(v), 2 * DIGITS + 1).when(v == inf, 2 * DIGITS).when(v == -inf, -1).otherwise(inside))


def quantiles_of_counts(counts: DataFrame, cols: list[str], qs: list[float], keys: list[str], ungrouped: bool = False,
                        known_groups: int | None = None) -> DataFrame:
    """``exact_quantiles`` of rows ``keys..., _c, _v, _n`` (a ``value_table``, or values with their weights), by radix selection.

    Three passes of partial aggregates: the ends of every group; rows per group and first digit of
    the value between them, whose running sums (over at most 2 ``DIGITS`` + 4 digits) tell the digits
    that hold the wanted ranks; the values of those digits alone, put in order per group and digit."""
    per = [*keys, "_c"]

    def slots() -> list[tuple[Column, Column]]:
        """For every quantile the two positions around it and the share of the second."""
        return [(f((F.col("_total") - 1) * F.lit(float(q))).cast("long"), (F.col("_total") - 1) * F.lit(float(q)))
                for q in qs for f in (F.floor, F.ceil)]

    def holding(rows: DataFrame, first: str, n: str) -> DataFrame:
        """Rows that hold a wanted rank (or no value at all), with ``_ranks``."""
        inside = [(r >= F.col(first)) & (r < F.col(first) + F.col(n)) for r, _ in slots()]
        ranks = F.array(*[F.when(hit, F.struct(F.lit(k).alias("slot"), r.alias("rank"), (pos - F.floor(pos)).alias("frac")))
                          for k, ((r, pos), hit) in enumerate(zip(slots(), inside))])
        kept = rows.where(reduce(lambda a, b: a | b, inside) | (F.col(n) == 0))
        return kept.withColumn("_ranks", F.filter(ranks, lambda r: r.isNotNull()))

    def before(order: str, n: str, *group: str) -> Column:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(n).over(w), F.lit(0).cast("long"))

    finite = F.abs("_v") < float("inf")
    ends = counts.groupBy(*[F.col(k).alias(f"_e{i}") for i, k in enumerate(per)]).agg(
        F.sum("_n").alias("_total"), F.min(F.when(finite, F.col("_v"))).alias("_least"), F.max(F.when(finite, F.col("_v"))).alias("_most"))
    # a group's row of ends is under 256 bytes, and at most two digits a quantile are wanted of it
    few = known_groups is not None and known_groups * len(cols) * len(qs) * 512 <= BROADCAST_MAX_BYTES
    small = F.broadcast if few else lambda x: x
    digits = counts.join(small(ends), _same(per, [f"_e{i}" for i in range(len(per))])) \
        .withColumn("_d", _digit(F.col("_v"), F.col("_least"), F.col("_most")))
    sums = digits.groupBy(*per, "_d").agg(F.sum("_n").alias("_m"), F.max("_total").alias("_total"))
    wanted = holding(sums.withColumn("_first", before("_d", "_m", *per)), "_first", "_m").select(      # in order: digits
        *[F.col(k).alias(f"_w{i}") for i, k in enumerate(per)], F.col("_d").alias("_wd"), "_first")
    rows = digits.join(small(wanted), _same(per, [f"_w{i}" for i in range(len(per))]) & (F.col("_d") == F.col("_wd")))
    rows = rows.groupBy(*per, "_d", "_v").agg(F.sum("_n").alias("_n"), F.min("_first").alias("_first"), F.min("_total").alias("_total"))
    rows = rows.withColumn("_at", F.col("_first") + before("_v", "_n", *per, "_d"))                       # in order: a digit's values
    found = holding(rows, "_at", "_n").select(*per, "_v", F.inline_outer("_ranks"))
    aggs = []
    for i, c in enumerate(cols):
        out = []
        for k in range(len(qs)):
            a, b, frac = (F.max(F.when((F.col("_c") == i) & (F.col("slot") == slot), F.col(x)))
                          for slot, x in ((2 * k, "_v"), (2 * k + 1, "_v"), (2 * k, "frac")))
            out.append(F.when(a == b, a).otherwise(a * (1 - frac) + b * frac))
        aggs.append(F.array(*out).alias(c))
    got = found.groupBy(*keys).agg(*aggs)
    if not ungrouped:
        return got
    one = counts.sparkSession.range(1).select(F.col("id").cast("int").alias("_one"))
    nulls = F.array(*[F.lit(None).cast("double") for _ in qs])
    return one.join(got, F.col(keys[0]) == F.col("_one"), "left").select(*[F.coalesce(F.col(c), nulls).alias(c) for c in cols])


def modes(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent non-null value per group (ties: the smallest) as ``_mode``; null where there is none."""
    counts = df.groupBy(*(by or []), F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.when(F.col("_v").isNotNull(), F.struct((-F.col("_n")).alias("_n"), F.col("_v").alias("_v"))))
    grouped = counts.groupBy(*by) if by else counts.groupBy()
    return grouped.agg(best["_v"].alias("_mode"))
