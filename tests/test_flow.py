"""The feature flow against pandas on a small frame: fitted on train alone, joint passes, saved and loaded."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ludex.operators import flow as fl

SCHEMA = "user long, item long, kind string, words array<string>, plats array<string>, lo double, price double, old double, year int, place string, lat double, flat int"


def rows(seed, users, extra_word=False):
    r = np.random.default_rng(seed)
    out = []
    for i in range(80):
        def gap(v, p=0.2):
            return None if r.random() < p else v
        words = [str(w) for w in r.choice(["a", "b", "c"], size=int(r.integers(0, 4)), replace=False)] + (["zz"] if extra_word and i % 7 == 0 else [])
        out.append((int(r.choice(users)), i, gap(str(r.choice(["x", "y"] + (["new"] if extra_word else [])))), gap(words, 0.1),
                    [str(p) for p in r.choice(["p", "q"], size=int(r.integers(1, 3)), replace=False)], float(r.exponential(3.0) ** 2),
                    gap(float(r.integers(1, 50))), gap(float(r.integers(1, 50))), gap(int(r.integers(2000, 2004))),
                    str(r.choice(["m", "n"])) if i % 5 else "alone", gap(float(r.normal()), 0.9 if i % 5 == 0 else 0.2), 1))
    return out


def steps(power=False):
    out = [fl.OneHotStep("kind"), fl.MultiLabelStep("words", "w"), fl.MultiLabelStep("plats", "p"), fl.Derive("twice", "lo * 2", ["lo"]),
           fl.UserMeans("user", {"lo": "mean_lo"}, ["w_*"], "um_"), fl.ScaleStep(["twice"], minmax=True), fl.DropConstant(["p_*"], zero=True),
           fl.MedianStep(["old"]), fl.GroupMedianStep(["lat"], "place"), fl.ModeStep(["year"]), fl.FlagMediansStep(["price"], "p_*"),
           fl.Derive("off", "price - old", ["price", "old"]), fl.DropConstant(["flat", "lat"])]
    return [*out, *([fl.PowerStep(["lo", "lat"])] if power else []), fl.ScaleStep(["lo", "lat", "flat", "off"])]


def brute(train, test):
    """The same chain on pandas frames (rows of ``test``)."""
    tr, te = train.copy(), test.copy()
    labels = {c: sorted({w for ws in tr[c] if ws is not None for w in ws}) for c in ("words", "plats")}
    kinds = sorted(set(tr["kind"].dropna()))
    for df in (tr, te):
        for k in [*kinds, "Unknown"]:
            df[f"kind_{k}"] = [int((v if v in kinds else "Unknown") == k) for v in df["kind"]]
        for c, p in (("words", "w"), ("plats", "p")):
            for w in labels[c]:
                df[f"{p}_{w}"] = [int(w in (ws if ws is not None else [])) for ws in df[c]]
            df[f"{p}_Unknown"] = [int(any(w not in labels[c] for w in (ws if ws is not None else []))) for ws in df[c]]
        df["twice"] = df["lo"] * 2
        for c, out in [("lo", "mean_lo")] + [(f"w_{w}", f"um_w_{w}") for w in [*labels["words"], "Unknown"]]:
            df[out] = df.groupby("user")[c].transform("mean")
    lo, hi = tr["twice"].min(), tr["twice"].max()
    med, mode = tr["old"].median(), tr["year"].mode().min()
    by, every = tr.groupby("place")["lat"].median(), tr["lat"].median()
    for df in (tr, te):
        df["twice"] = (df["twice"] - lo) / (hi - lo)
        df["old"], df["year"] = df["old"].fillna(med), df["year"].fillna(mode)
        df["lat"] = df["lat"].fillna(df["place"].map(by)).fillna(every)
    for flag in [f"p_{w}" for w in labels["plats"]]:
        fill = tr.loc[tr[flag] > 0, "price"].median()
        for df in (tr, te):
            df.loc[(df[flag] > 0) & df["price"].isna(), "price"] = fill
    for df in (tr, te):
        df["off"] = df["price"] - df["old"]
    for c in ("lo", "lat", "off"):
        m, s = tr[c].mean(), tr[c].std(ddof=0)
        te[c] = (te[c] - m) / s
    return te.drop(columns=["flat", "p_Unknown"])


@pytest.fixture(scope="module")
def frames(spark):
    return (spark.createDataFrame(rows(1, range(6)), SCHEMA), spark.createDataFrame(rows(2, range(6, 9), True), SCHEMA))


def same(got, want, cols):
    got, want = (x.sort_values("item").reset_index(drop=True) for x in (got, want))
    for c in cols:
        if want[c].dtype == object:
            continue
        assert np.allclose(got[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_flow_equals_pandas_saved_and_loaded(spark, frames, tmpdir_path):
    train, test = frames
    f = fl.FeatureFlow(steps()).fit(train)
    want = brute(train.toPandas(), test.toPandas())
    f.save(spark, f"{tmpdir_path}/flow")
    again = fl.FeatureFlow.load(spark, f"{tmpdir_path}/flow")
    for flow in (f, again):
        got = flow.apply(test).toPandas()
        assert set(got.columns) == set(want.columns)
        same(got, want, [c for c in want.columns if c != "item"])


def test_independent_steps_share_their_passes(frames):
    f = fl.FeatureFlow(steps()).fit(frames[0])
    assert f.levels[0] == [0, 1, 2, 3, 7, 8, 9]            # all that read input columns only
    assert sorted(i for level in f.levels for i in level) == list(range(len(steps())))
    place = {i: n for n, level in enumerate(f.levels) for i in level}
    assert place[2] < place[6] <= place[10] < place[11] and place[8] < place[12] <= place[13]
    assert f.passes <= 6


def test_power_step_takes_the_skewed_columns(frames):
    train, test = frames
    f = fl.FeatureFlow(steps(power=True)).fit(train)
    step = next(s for s in f.steps if isinstance(s, fl.PowerStep))
    assert "lo" in step.state["skewed"] and abs(f.apply(train).toPandas()["lo"].skew()) < 0.5
    assert f.apply(test).count() == 80


def test_empty_train_clashing_names_and_too_many_labels(spark, frames, monkeypatch):
    train, test = frames
    empty = fl.FeatureFlow([fl.OneHotStep("kind"), fl.MedianStep(["old"]), fl.ScaleStep(["lo"])]).fit(train.limit(0))
    got = empty.apply(test).toPandas()
    assert got["kind_Unknown"].sum() == 80 and got["old"].isna().sum() == test.toPandas()["old"].isna().sum()
    assert empty.apply(test.limit(0)).count() == 0
    odd = train.withColumnRenamed("flat", "_v").withColumnRenamed("year", "label")
    assert fl.FeatureFlow([fl.MultiLabelStep("words", "w"), fl.MedianStep(["old"])]).fit(odd).apply(odd).count() == 80
    monkeypatch.setattr(fl, "MAX_LABELS", 2)
    with pytest.raises(ValueError, match="words"):
        fl.FeatureFlow([fl.MultiLabelStep("words", "w")]).fit(train)


def test_fit_computes_and_stages_only_what_later_fits_read(spark, frames, monkeypatch):
    train, test = frames
    seen, cut = [], fl.cut_lineage
    monkeypatch.setattr(fl, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    unread = train.withColumn("unread", F.raise_error(F.lit("read")).cast("int"))          # no step reads it
    got = fl.FeatureFlow(steps()).fit(unread)
    assert "unread" not in seen[0] and not [c for kept in seen for c in kept if c.startswith(("um_", "kind_"))]
    assert {"price", "p_p", "p_q", "lat"} <= set(seen[-1]) <= {*train.columns, "p_p", "p_q"}
    n = len(seen)
    again = fl.FeatureFlow(steps()).fit(cut(train), staged=True)
    assert len(seen) == 2 * n - 1 and [s.state for s in again.steps if not isinstance(s, fl.GroupMedianStep)] == [
        s.state for s in got.steps if not isinstance(s, fl.GroupMedianStep)]
    want, have = (f.apply(test).toPandas().sort_values("item").reset_index(drop=True) for f in (got, again))
    same(have, want, [c for c in want.columns if c != "item"])


def test_medians_of_flagged_rows_alone(spark, monkeypatch):
    from ludex.operators import ordered
    df = spark.createDataFrame([(1, 4.0, None), (1, None, None), (0, 9.0, None), (1, 6.0, None), (None, 1.0, None)], "p int, x double, y double")
    wanted = fl.FlagMedianStep(["x", "y"], "p").medians()
    assert fl.select_medians(df, wanted) == {"x": 5.0, "y": None}
    monkeypatch.setattr(ordered, "GROUP_ROWS", -1)                  # by selection, as for large frames
    assert fl.select_medians(df, wanted) == {"x": 5.0, "y": None}
    assert fl.select_medians(df.limit(0), wanted) == {"x": None, "y": None}
