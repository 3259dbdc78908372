"""Label dictionaries that stay tables give what gathered lists give; labels that name columns are bounded."""

import pytest

from ludex.operators import encode as enc

SCHEMA = "i long, s string, g array<string>, _lbl string, _idx int"


@pytest.fixture(scope="module")
def frames(spark):
    train = [(i, None if i % 9 == 0 else f"k{i % 7}", None if i % 8 == 0 else [f"w{j}" for j in range(i % 4)] + ["hot"], "x", 1) for i in range(60)]
    train += [(100, "Other", ["hot"], None, 2), (101, "Missing", ["hot", "hot"], None, 2)]
    test = [(1, "k3", ["w1", "new", None, "hot"], "x", 1), (2, "never", [], "x", 1), (3, None, None, "x", 1), (4, "k0", ["w2"] * 9, "x", 1)]
    return tuple(spark.createDataFrame(r, SCHEMA).drop("_lbl", "_idx") for r in (train, test))


def fitted(train):
    return [enc.LabelEncoder.fit(train, "s"), enc.ListEncoder.fit(train, "g"), enc.CoverageCap.fit(train, "g", 0.8),
            enc.CategoryEnforcer.fit(train, ["s"]), enc.CategoryEnforcer.fit(train.filter("s like 'k%'"), ["s"])]


def test_tables_equal_lists_saved_and_loaded(spark, frames, monkeypatch, tmpdir_path):
    train, test = frames
    want = [sorted(map(repr, e.apply(test).collect())) for e in fitted(train)]
    monkeypatch.setattr(enc, "SMALL_LABELS", 0)
    big = fitted(train)
    assert all("labels" not in e.state and "kept" not in e.state for e in big)
    assert big[0]._table.count() == big[0].size() == 9
    for k, (e, rows) in enumerate(zip(big, want)):
        assert sorted(map(repr, e.apply(test).collect())) == rows
        e.save(spark, f"{tmpdir_path}/{k}")
        again = type(e).load(spark, f"{tmpdir_path}/{k}")
        assert sorted(map(repr, again.apply(test).collect())) == rows
        assert again.apply(test.limit(0)).count() == 0


def test_empty_train_and_too_many_columns(spark, frames, monkeypatch):
    train, test = frames
    assert {r.s_encoded for r in enc.LabelEncoder.fit(train.limit(0), "s").apply(test).collect()} == {0}
    assert {r.s for r in enc.CategoryEnforcer.fit(train.limit(0), ["s"]).apply(test).collect()} == {None}
    monkeypatch.setattr(enc, "MAX_COLUMNS", 3)
    for fit in (lambda: enc.OneHot.fit(train, "s"), lambda: enc.MultiLabel.fit(train, "g", "g")):
        with pytest.raises(ValueError, match="cannot name columns"):
            fit()


def test_many_labels_are_numbered_without_a_list(spark, monkeypatch):
    monkeypatch.setattr(enc, "SMALL_LABELS", 1000)
    df = spark.range(0, 300_000, 1, 8).selectExpr("concat('v', lpad(cast(id as string), 7, '0')) s", "id")
    e = enc.LabelEncoder.fit(df, "s")
    got = e.apply(df.unionByName(spark.sql("select 'none' s, 300000L id")))
    assert got.filter("s_encoded <> id").count() == 0 and got.count() == 300_001 and "labels" not in e.state
