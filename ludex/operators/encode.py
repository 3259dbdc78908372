"""Encoders fitted on train and applied to any frame.

Fitting is one distributed aggregate (distinct / counts per label) whose
small result -- the category list -- is the fitted state, saved as parquet.
Applying is a projection: one ``when`` / ``array_contains`` column per
category built in a single ``select`` (never a loop of ``withColumn``), or,
where labels map to indices, a join of the fitted (label, index) table
(broadcast below a byte bound, else sized by AQE).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.functions.clean import MISSING, UNKNOWN
from ludex.session import join_small

OTHER = "Other"


class Fitted:
    """Fitted state: named label lists and scalars, persisted as parquet + json."""

    kind = "fitted"

    def __init__(self, **state):
        self.state = state

    def save(self, spark: SparkSession, path: str) -> None:
        lists = {k: v for k, v in self.state.items() if isinstance(v, list)}
        scalars = {k: v for k, v in self.state.items() if not isinstance(v, list)}
        for k, v in lists.items():
            rows = [(i, json.dumps(x)) for i, x in enumerate(v)]
            spark.createDataFrame(rows, "pos int, value string").coalesce(1) \
                .write.mode("overwrite").parquet(f"{path}/{k}")
        spark.createDataFrame([(self.kind, json.dumps(scalars), json.dumps(sorted(lists)))],
                              "kind string, scalars string, lists string").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/_meta")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        meta = spark.read.parquet(f"{path}/_meta").first()
        state = json.loads(meta["scalars"])
        for k in json.loads(meta["lists"]):
            rows = spark.read.parquet(f"{path}/{k}").orderBy("pos").collect()
            state[k] = [json.loads(r["value"]) for r in rows]
        obj = cls.__new__(cls)
        obj.state = state
        return obj


# Labels that are gathered as a list; more of them stay a table (C3 C4 C5 C9), or are refused where each names a column.
SMALL_LABELS = 100_000
MAX_COLUMNS = 10_000


def _distinct(df: DataFrame, col: str, explode: bool = False) -> DataFrame:
    return df.select((F.explode(col) if explode else F.col(col)).alias("_lbl")).filter("_lbl IS NOT NULL").distinct()


def _column_labels(df: DataFrame, col: str, explode: bool = False) -> list:
    """The sorted labels, each of which will name a column."""
    rows = _distinct(df, col, explode).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"{col}: over {MAX_COLUMNS} labels cannot name columns; index them (C3, C4)")
    return sorted(r[0] for r in rows)


class Dictionary(Fitted):
    """Fitted labels with their places in label order: a list while there are at most ``SMALL_LABELS``, else a
    written table (``_lbl``, ``_idx``) that was numbered by C11 and never passes the driver.  Same results."""

    _table: DataFrame | None = None

    @staticmethod
    def gather(found: DataFrame) -> tuple[dict, DataFrame | None]:
        """``found`` (``_lbl``) as state and table; the caller numbers from 0."""
        from ludex.session import cut_lineage
        rows = found.limit(SMALL_LABELS + 1).collect()
        if len(rows) <= SMALL_LABELS:
            return {"labels": sorted(r[0] for r in rows), "n": len(rows)}, None
        table = cut_lineage(build_index(found, "_lbl", "_idx", kind="long").select(F.col("_lbl").cast("string").alias("_lbl"), "_idx"))
        return {"n": table.count()}, table

    def size(self) -> int:
        return self.state["n"] if "n" in self.state else len(self.state["labels"])

    def table(self, spark: SparkSession, start: int = 0) -> DataFrame:
        """(``_lbl``, ``_idx``), numbered from ``start``; int while it holds all places."""
        kind = "int" if self.size() + start + 1 < 2 ** 31 else "long"
        t = self._table
        if t is None:
            t = spark.createDataFrame([(x, i) for i, x in enumerate(self.state["labels"])], "_lbl string, _idx long")
        return t.select("_lbl", (F.col("_idx") + start).cast(kind).alias("_idx"))

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        if self._table is not None:
            self._table.write.mode("overwrite").parquet(f"{path}/table")

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        obj = super().load(spark, path)
        if "n" in obj.state and "labels" not in obj.state:
            obj._table = spark.read.parquet(f"{path}/table")
        return obj


def _safe(label) -> str:
    return str(label)


# C1 -------------------------------------------------------------------------
class OneHot(Fitted):
    """Categories seen in train plus ``Unknown``; unseen -> ``Unknown``."""

    kind = "onehot"

    @classmethod
    def fit(cls, df: DataFrame, col: str, unknown: str = UNKNOWN) -> "OneHot":
        cats = _column_labels(df, col)
        if unknown not in cats:
            cats.append(unknown)
        return cls(col=col, categories=cats, unknown=unknown)

    def apply(self, df: DataFrame, keep: bool = False) -> DataFrame:
        col, cats, unk = self.state["col"], self.state["categories"], self.state["unknown"]
        known = [c for c in cats if c != unk]
        v = F.when(F.col(col).isin(known), F.col(col)).otherwise(F.lit(unk))
        onehots = [(v == F.lit(c)).cast("int").alias(f"{col}_{_safe(c)}") for c in cats]
        base = df.columns if keep else [c for c in df.columns if c != col]
        return df.select(*base, *onehots)


# C2 C6 C7 -------------------------------------------------------------------
class MultiLabel(Fitted):
    """List column -> one 0/1 column per train label.

    ``unknown=True`` (C2) adds one ``Unknown`` column set when any label of
    the row is unseen; ``unknown=False`` (C7) ignores unseen labels."""

    kind = "multilabel"

    @classmethod
    def fit(cls, df: DataFrame, col: str, prefix: str, unknown: bool = True) -> "MultiLabel":
        labels = _column_labels(df, col, explode=True)
        classes = sorted(set(labels) | {UNKNOWN}) if unknown else labels
        return cls(col=col, prefix=prefix, known=labels, classes=classes, unknown=unknown)

    def columns(self) -> list[Column]:
        s = self.state
        col, known = F.col(s["col"]), s["known"]
        arr = F.coalesce(col, F.array().cast(T.ArrayType(T.StringType())))
        out = []
        has_unknown = F.size(F.array_except(arr, F.array(*[F.lit(k) for k in known]))) > 0 if known \
            else F.size(arr) > 0
        for c in s["classes"]:
            name = f"{s['prefix']}_{_safe(c)}" if s["prefix"] else _safe(c)
            if s["unknown"] and c == UNKNOWN and UNKNOWN not in known:
                out.append(has_unknown.cast("int").alias(name))
            elif s["unknown"] and c == UNKNOWN:
                out.append((F.array_contains(arr, F.lit(c)) | has_unknown).cast("int").alias(name))
            else:
                out.append(F.array_contains(arr, F.lit(c)).cast("int").alias(name))
        return out

    def apply(self, df: DataFrame, keep: bool = False) -> DataFrame:
        base = df.columns if keep else [c for c in df.columns if c != self.state["col"]]
        return df.select(*base, *self.columns())


class TopNLabels(Fitted):
    """Keep the ``n`` most frequent train labels (count desc, label asc);
    one boolean column per kept label."""

    kind = "topn_labels"

    @classmethod
    def fit(cls, df: DataFrame, col: str, n: int, prefix: str) -> "TopNLabels":
        top = (df.select(F.explode(col).alias("_v")).groupBy("_v").count()
               .orderBy(F.desc("count"), F.asc("_v")).limit(n).collect())
        return cls(col=col, prefix=prefix, labels=[r[0] for r in top])

    def apply(self, df: DataFrame, keep: bool = False) -> DataFrame:
        s = self.state
        arr = F.coalesce(F.col(s["col"]), F.array().cast(T.ArrayType(T.StringType())))
        cols = [F.array_contains(arr, F.lit(c)).alias(f"{s['prefix']}_{_safe(c)}") for c in s["labels"]]
        base = df.columns if keep else [c for c in df.columns if c != s["col"]]
        return df.select(*base, *cols)


# C3 C4 C11 ------------------------------------------------------------------
class LabelEncoder(Dictionary):
    """Sorted train labels -> 0..n-1; unseen and null -> n."""

    kind = "label"

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> "LabelEncoder":
        state, table = cls.gather(_distinct(df, col))
        obj = cls(col=col, **state)
        obj._table = table
        return obj

    def apply(self, df: DataFrame, out: str | None = None) -> DataFrame:
        col, n = self.state["col"], self.size()
        t = self.table(df.sparkSession)
        j = join_small(df, t, df[col].cast("string") == t["_lbl"], "left", known_rows=n)
        return j.withColumn(out or f"{col}_encoded", F.coalesce(F.col("_idx"), F.lit(n))).drop("_lbl", "_idx")


def map_lists(df: DataFrame, col: str, table: DataFrame, value: str, default, out: str, known_rows: int | None = None) -> DataFrame:
    """``df`` with ``out``: every entry of the list column ``col`` looked up in ``table`` (``_lbl``, ``value``),
    in place; entries without a match (null ones too) become ``default``, a null list becomes an empty one.

    Each DISTINCT list is exploded, joined with the fitted table and put together
    again (a hot list is one row), then joined back on the list."""
    lists = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("_list")).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    entries = lists.select("_list", F.posexplode("_list").alias("_pos", "_lbl"))
    entries = join_small(entries, table.select("_lbl", F.col(value).alias("_val")), "_lbl", "left", known_rows=known_rows)
    done = entries.groupBy("_list").agg(F.sort_array(F.collect_list(F.struct("_pos", F.coalesce("_val", F.lit(default)).alias("v")))).alias("_s"))
    done = done.select("_list", F.transform("_s", lambda x: x["v"]).alias("_mapped"))
    kind = done.schema["_mapped"].dataType
    return (df.join(done, F.col(col) == F.col("_list"), "left")
            .withColumn(out, F.coalesce("_mapped", F.array().cast(kind))).drop("_list", "_mapped"))


class ListEncoder(Dictionary):
    """C4: list labels -> 1..n (sorted), unseen -> n+1, padded with 0 to the
    fitted max length (longer lists are cut to it)."""

    kind = "list"

    @classmethod
    def fit(cls, df: DataFrame, col: str) -> "ListEncoder":
        state, table = cls.gather(_distinct(df, col, explode=True))
        width = int(df.agg(F.coalesce(F.max(F.size(col)), F.lit(0))).first()[0])
        obj = cls(col=col, width=width, **state)
        obj._table = table
        return obj

    def apply(self, df: DataFrame, out: str | None = None) -> DataFrame:
        col, width, n = self.state["col"], int(self.state["width"]), self.size()
        out = out or f"{col}_encoded_padded"
        t = self.table(df.sparkSession, start=1)
        res = map_lists(df, col, t, "_idx", n + 1, "_enc", known_rows=n)
        enc = F.col("_enc")
        padded = F.slice(F.concat(enc, F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size(enc), F.lit(0)))),
                         1, max(width, 1)) if width > 0 else F.array().cast("array<int>")
        return res.withColumn(out, padded).drop("_enc")


def build_index(df: DataFrame, col: str, out: str = "idx", order: Column | None = None, kind: str = "int") -> DataFrame:
    """C11: distinct ids -> dense 0..n-1 in id order (or in ``order``, ties by id), as ``kind`` (long: over 2^31 ids).

    Range partitioning + per-partition counts turned into offsets (the
    ``zipWithIndex`` idea, JVM-side): numbering runs per range partition, so
    no single task holds all ids.  The partition-tagged ids are checkpointed
    so both passes see the same partition ids."""
    from ludex.session import cut_lineage
    ids = df.select(col).filter(F.col(col).isNotNull()).distinct()
    ids = ids.withColumn("_o", order if order is not None else F.lit(0))
    ids = ids.repartitionByRange("_o", col)
    # partition ids must be stable between the count pass and the numbering pass
    part = cut_lineage(ids.withColumn("_p", F.spark_partition_id()))
    counts = part.groupBy("_p").count()
    offs = counts.withColumn("_off", F.coalesce(F.sum("count").over(
        Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    w = Window.partitionBy("_p").orderBy("_o", col)
    return part.join(F.broadcast(offs.select("_p", "_off")), "_p") \
        .withColumn(out, (F.col("_off") + F.row_number().over(w) - 1).cast(kind)).select(col, out)


# C5 C8 ----------------------------------------------------------------------
class CoverageCap(Dictionary):
    """Labels by count desc (label asc on ties); keep while the running
    share is below ``coverage``; every other label becomes ``Other``."""

    kind = "coverage"

    @classmethod
    def fit(cls, df: DataFrame, col: str, coverage: float = 0.8) -> "CoverageCap":
        from ludex.operators.profile import cumulative_share, value_counts
        counts = value_counts(df, col, explode=True)
        kept = cumulative_share(counts, col).filter(F.col("cum_share") < coverage).select(F.col(col).alias("_lbl"))
        state, table = cls.gather(kept)
        obj = cls(col=col, coverage=coverage, **({"kept": state["labels"]} if table is None else state))
        obj._table = table
        return obj

    def apply(self, df: DataFrame, out: str | None = None) -> DataFrame:
        col = self.state["col"]
        out = out or col
        kept = self.state.get("kept")
        t = self._table if kept is None else df.sparkSession.createDataFrame([(k,) for k in kept], "_lbl string")
        res = map_lists(df, col, t.select("_lbl", F.col("_lbl").alias("_kept")), "_kept", OTHER, "_enc",
                        known_rows=self.size() if kept is None else len(kept))
        return res.withColumn(out, F.when(F.col(col).isNotNull(), F.array_distinct("_enc"))).drop("_enc")


class TopN(Fitted):
    """Scalar value kept when in the fitted top-N list, else ``Other``."""

    kind = "topn"

    @classmethod
    def fit(cls, df: DataFrame, col: str, n: int) -> "TopN":
        top = (df.select(F.col(col).alias("_v")).filter("_v IS NOT NULL").groupBy("_v").count()
               .orderBy(F.desc("count"), F.asc("_v")).limit(n).collect())
        return cls(col=col, labels=[r[0] for r in top])

    def apply(self, df: DataFrame, out: str | None = None) -> DataFrame:
        col = self.state["col"]
        return df.withColumn(out or col, F.when(F.col(col).isin(self.state["labels"]), F.col(col))
                             .otherwise(F.lit(OTHER)))


# C9 C10 ---------------------------------------------------------------------
class CategoryEnforcer(Fitted):
    """Per categorical column, a value seen in train is kept; an unseen
    value becomes ``Other`` if train had ``Other``, else ``Missing`` if train
    had ``Missing``, else null."""

    kind = "categories"

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> "CategoryEnforcer":
        obj = cls(cols=cols, fallback={})
        obj._parts = {}
        for c in cols:
            state, table = Dictionary.gather(_distinct(df, c))
            obj._parts[c] = Dictionary(**state)
            obj._parts[c]._table = table
            has = set(state["labels"]) if table is None else {r[0] for r in table.filter(F.col("_lbl").isin(OTHER, MISSING)).select("_lbl").collect()}
            obj.state["fallback"][c] = OTHER if OTHER in has else MISSING if MISSING in has else None
        return obj

    def apply(self, df: DataFrame) -> DataFrame:
        exprs = {}
        for c in self.state["cols"]:
            part, other = self._parts[c], F.lit(self.state["fallback"][c]).cast("string")
            if part._table is None:
                exprs[c] = F.when(F.col(c).isin(part.state["labels"]), F.col(c)).otherwise(other)
            else:                                                        # too many for a list in the plan: joined
                t = part._table.select(F.col("_lbl").alias(f"_seen_{c}"))
                df = join_small(df, t, df[c].cast("string") == t[f"_seen_{c}"], "left", known_rows=part.size())
                exprs[c] = F.when(F.col(f"_seen_{c}").isNotNull(), F.col(c)).otherwise(other)
        return df.withColumns(exprs).drop(*[f"_seen_{c}" for c in self.state["cols"]])

    def save(self, spark: SparkSession, path: str) -> None:
        super().save(spark, path)
        for i, c in enumerate(self.state["cols"]):
            self._parts[c].save(spark, f"{path}/part{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "CategoryEnforcer":
        obj = super().load(spark, path)
        obj._parts = {c: Dictionary.load(spark, f"{path}/part{i}") for i, c in enumerate(obj.state["cols"])}
        return obj


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorder to the train columns, add missing ones as 0 / false, drop extras."""
    cols = []
    for f in schema.fields:
        if f.name in df.columns:
            cols.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            cols.append(F.lit(False).alias(f.name))
        else:
            cols.append(F.lit(0).cast(f.dataType).alias(f.name))
    return df.select(*cols)
