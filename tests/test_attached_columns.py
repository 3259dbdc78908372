"""Columns of an attached vector are made once a key; a miss, a null and a wrong length get those of the fill vector."""

from pyspark.sql import functions as F

from ludex.operators import assemble as asm


def test_columns_made_once_a_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (4, 5), (None, 6)], "k long, i long")
    emb = spark.createDataFrame([(1, [1.26, 2.0]), (1, [9.0, 9.0]), (2, [1.0]), (3, None)], "k long, v array<float>")
    calls = spark.sparkContext.accumulator(0)

    def noted(x):
        calls.add(1)
        return x

    note = F.udf(noted, "double")
    many = df.join(spark.range(50), how="cross")
    got = asm.attach_embeddings(many, emb, ["k"], "v", 2, fill=0.5, each=lambda v: [note(F.round(v[0].cast("double"), 1)).alias("a"), F.size(v).alias("n")])
    rows = {(r.i, r.a, r.n) for r in got.select("i", "a", "n").collect()}
    assert rows == {(1, 1.3, 2), (2, 1.3, 2), (3, 0.5, 2), (4, 0.5, 2), (5, 0.5, 2), (6, 0.5, 2)} and got.count() == 300
    assert calls.value < 50                                            # not once a row (300)
    plain = asm.attach_embeddings(df, emb, ["k"], "v", 2, fill=0.5).select("i", F.round(F.col("v")[0].cast("double"), 1).alias("a"), F.size("v").alias("n"))
    assert {tuple(r) for r in plain.collect()} == rows
