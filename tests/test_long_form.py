"""The long form of the tabular chain: a row is made once, nulls keep their row, ready columns are not rounded again."""

from ludex.plans.q_model import long_form


def test_long_form(spark):
    df = spark.createDataFrame([(1, 7, 0.12345678, True, None, "x", 2.0), (2, None, None, False, 5, None, -0.00000049)],
                               "u long, i long, a double, b boolean, c int, t string, e double")
    out = long_form(df, ["u", "i"], ["a", "e", "b", "c"], ["t"], ["e"])
    assert out.columns == ["u", "i", "feature", "num_value", "str_value"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "Union" not in plan                  # before: an unpivot of each kind, joined by a union
    assert sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[2])) == [
        (1, 7, "a", 0.123457, None), (1, 7, "b", 1.0, None), (1, 7, "c", None, None), (1, 7, "e", 2.0, None), (1, 7, "t", None, "x"),
        (2, None, "a", None, None), (2, None, "b", 0.0, None), (2, None, "c", 5.0, None), (2, None, "e", -0.00000049, None), (2, None, "t", None, None)]


def test_one_kind_only(spark):
    df = spark.createDataFrame([(1, 0.5, "x")], "u long, a double, t string")
    assert [tuple(r) for r in long_form(df, ["u"], ["a"], []).collect()] == [(1, "a", 0.5, None)]
    assert [tuple(r) for r in long_form(df, ["u"], [], ["t"]).collect()] == [(1, "t", None, "x")]
