"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ludex.session import cut_lineage


def read_keyed_json(spark: SparkSession, path: str, value_schema: T.DataType,
                    key: str = "id", ndjson: bool = True) -> DataFrame:
    """``{id: record, ...}`` objects -> one row per id.

    With ``ndjson`` (the scalable layout) every line is one such object and
    the text files are split across tasks; otherwise each file is one object
    read whole by one task (only for small landed files).
    """
    if ndjson:
        txt = spark.read.text(path)
    else:
        txt = spark.read.option("wholetext", True).text(path)
    m = F.from_json("value", T.MapType(T.StringType(), value_schema))
    return txt.select(F.explode(m).alias(key, "_rec")).select(key, "_rec.*") \
        if isinstance(value_schema, T.StructType) else \
        txt.select(F.explode(m).alias(key, "value"))


def explode_keyed_json(df: DataFrame, col: str, value_type: str, key: str = "key",
                       value: str = "value") -> DataFrame:
    """S1 on a string column already in a table."""
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.explode(F.from_json(col, f"map<string,{value_type}>")).alias(key, value))


def read_json_array(spark: SparkSession, path: str, schema: T.StructType,
                    max_records: int | None = None) -> DataFrame:
    """Files that are one JSON array of objects each, with an optional cap on the records.

    A file is read by many tasks: the text source cuts it at every closing brace, so its splits are byte ranges.
    Whether a range starts inside a string, and how deep, follows from sums over the ranges before it (quotes,
    and brackets for either start); a record ends where an object closes at depth one.  The cap takes the first
    records in order of file path and place.  Other array elements than objects are skipped."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    parts = F.split(F.regexp_replace("value", r"(?s)\\.", ""), '"')              # without escaped characters

    def depth(inside: int) -> Column:
        """Change of depth over the fragment and its closing brace, if it starts inside a string or not."""
        outside = F.array_join(F.filter(parts, lambda _, i: (i + inside) % 2 == 0), "")
        opened, closed = (F.length(F.regexp_replace(outside, p, "")) for p in (r"[^\[{]", r"[^\]]"))
        return opened - closed - F.when((F.size(parts) - 1 + inside) % 2 == 0, 1).otherwise(0)

    frags = cut_lineage(raw.select("*", (F.size(parts) - 1).alias("quotes"), depth(0).alias("d0"), depth(1).alias("d1")))
    within = Window.partitionBy("file", "block").orderBy("at")                     # rows: fragments of a byte range
    across = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)          # rows: ranges

    def before(c: str | Column, w) -> Column:
        return F.coalesce(F.sum(c).over(w), F.lit(0))

    upto, ahead = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, -1)
    frags = frags.withColumn("odd", before("quotes", ahead) % 2)                   # inside a string, if the range starts outside
    ranges = frags.groupBy("file", "block").agg(
        F.sum("quotes").alias("q"), *(F.sum(F.when(F.col("odd") == 0, x).otherwise(F.col(y))).alias(f"s{k}")
                                      for k, x, y in ((0, F.col("d0"), "d1"), (1, F.col("d1"), "d0"))))
    ranges = ranges.withColumn("start", before("q", across) % 2)
    ranges = ranges.withColumn("base", before(F.when(F.col("start") == 0, F.col("s0")).otherwise(F.col("s1")), across)).select("file", "block", "start", "base")
    frags = frags.join(ranges, ["file", "block"]).withColumn("inside", (F.col("odd") + F.col("start")) % 2)
    frags = frags.withColumn("depth", F.col("base") + F.sum(F.when(F.col("inside") == 0, F.col("d0")).otherwise(F.col("d1"))).over(upto))
    ends = (F.col("depth") == 1) & ((F.col("inside") + F.col("quotes")) % 2 == 0)
    frags = frags.withColumn("last", ends).withColumn("record", before(F.col("last").cast("long"), ahead))
    done = cut_lineage(frags.groupBy("file", "block").agg(F.count_if("last").alias("n")))
    done = done.withColumn("first", before("n", across)).select("file", "block", "first")
    frags = frags.join(done, ["file", "block"]).withColumn("record", F.col("record") + F.col("first"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "value"))), lambda x: F.concat(x["value"], F.lit("}"))), "")
    records = frags.groupBy("file", "record").agg(text.alias("text"), F.bool_or("last").alias("whole")).where("whole")
    if max_records is not None:
        files = frags.groupBy("file").agg(F.count_if("last").alias("n"))
        files = files.withColumn("earlier", before("n", Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))).select("file", "earlier")  # rows: files
        records = records.join(files, "file").where(F.col("earlier") + F.col("record") < max_records)
    return records.select(F.from_json(F.expr("substr(text, instr(text, '{'))"), schema).alias("_rec")).select("_rec.*")


def write_json_arrays(df: DataFrame, path: str, order: list[str], files: int = 4) -> None:
    """One JSON array file per range of ``order``, in order (the files' names are in order too)."""
    rows = df.repartitionByRange(files, *order).withColumn("_p", F.spark_partition_id())
    w = Window.partitionBy("_p").orderBy(*order)
    body = F.to_json(F.struct(*df.columns))
    text = rows.select("_p", *order, F.concat(F.when(F.lag("_p").over(w).isNull(), "[").otherwise(""), body,
                                              F.when(F.lead("_p").over(w).isNull(), "]").otherwise(",")).alias("_t"))
    text.repartitionByRange(files, "_p").sortWithinPartitions("_p", *order).select("_t").write.text(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """S2, scalable layout: newline-delimited records, split across tasks."""
    return spark.read.schema(schema).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: header, no index."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, cols: list[str] | None = None) -> DataFrame:
    """S3: typed read with an optional column subset (pruned at the scan)."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*cols) if cols else df


def write_stage(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Snappy parquet per stage (optionally partitioned, e.g. by split)."""
    w = df.write.mode(mode).option("compression", "snappy")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    """S4 / S5"""
    return spark.read.parquet(path)


def build_lookup(df: DataFrame, key: str, name: str, out_key: str = "app_id",
                 out_name: str = "game_name", order: str | None = None) -> DataFrame:
    """Key + name, nulls dropped, first per key by an explicit order, key as int.

    "First per key" is ``min(struct(order, name))``: a hash aggregate with
    map-side partial combining, so a key repeated in a third of the rows
    never lands in one task as a whole group.
    """
    d = df.select(key, name, *([order] if order and order not in (key, name) else [])).dropna(subset=[key, name])
    o = order or name
    first = d.groupBy(key).agg(F.min(F.struct(F.col(o).alias("_o"), F.col(name).alias("_v"))).alias("_m"))
    return first.select(F.col(key).cast("int").alias(out_key), F.col("_m._v").alias(out_name))
