"""Registered queries at the sizes they are described with."""

from conftest import SF_SMALL


def test_tree_model_sees_whole_vectors(spark, monkeypatch):
    from ludex.operators import rank as rk
    from ludex.plans import q_model
    seen, fit = [], rk.fit_gbt

    def spy(rows, num, label, max_iter, categorical):
        seen.extend(num)
        return fit(rows, num, label, max_iter=1, categorical=categorical)

    monkeypatch.setattr(rk, "fit_gbt", spy)
    assert q_model.q_gbt(spark, SF_SMALL).count() == 2
    assert [c for c in seen if c.startswith("game_emb")] == [f"game_emb_{k}" for k in range(q_model.VECTOR_DIM)]


def test_search_is_registered_at_full_size(spark, monkeypatch):
    from ludex.operators import als, assemble
    from ludex.plans import q_model
    seen, folds = {}, assemble.user_folds

    class Stop(Exception):
        pass

    class Spy:
        def __init__(self, iters, **rest):
            seen["iters"] = iters

        def fit(self, rows):
            raise Stop

    def search(space, trials, objective):
        seen["trials"] = trials
        try:
            objective(2, 0.01, 1.0)
        except Stop:
            return []

    monkeypatch.setattr(assemble, "user_folds", lambda df, k: folds(df, k=seen.setdefault("folds", k)))
    monkeypatch.setattr(als, "ImplicitALS", Spy)
    monkeypatch.setattr(als, "random_search", search)
    q_model.q_search(spark, SF_SMALL)
    assert seen == {"trials": 30, "folds": 5, "iters": 15}


def test_shapley_covers_every_model_input(spark, monkeypatch):
    from ludex.operators import explore
    from ludex.plans import q_explore
    real = explore.shapley_sample
    monkeypatch.setattr(explore, "sample_n", lambda df, n, key, seed=42, pick=explore.sample_n: pick(df, min(n, 5), key, seed))
    monkeypatch.setattr(explore, "shapley_sample", lambda *a, **k: real(*a, **k | {"m": 2}))
    got = {r.feature: r for r in q_explore.q_shapley(spark, SF_SMALL).collect()}
    names = {"game_type_encoded", "dev_encoded", "f_price", "f_size", "f_retail", "game_genres_encoded_padded_dim_0"}
    names |= {f"{v}_{k}" for v in ("game_emb", "user_emb") for k in range(64)}
    assert names <= set(got) and sum(c.startswith("tag_") for c in got) == 5
    assert all(r.n_rows == 5 for r in got.values()) and got["game_emb_63"].mean_abs_shapley > 0


def test_als_moves_no_ids_that_fit(spark, monkeypatch):
    """Ids that are ALS's as they are need no index: no table of ids, no join; types and null ids are kept."""
    from ludex.operators import als
    from ludex.operators.encode import build_index
    indexed = []
    monkeypatch.setattr(als, "build_index", lambda df, col, *a: indexed.append(col) or build_index(df, col, *a))
    rows = [(u, i, 0.5 + (u + i) % 3) for u in range(6) for i in range(100, 108) if (u * i) % 5]
    df = spark.createDataFrame([*rows, (None, 100, 1.0), (1, None, 1.0)], "user_id long, app_id long, relevance_score double")
    m = als.ImplicitALS(rank=2, iters=2).fit(df)
    assert m.users is None and m.items is None and not indexed
    for f, ids, c in ((m.user_factors(), {r[0] for r in rows}, "user_id"), (m.item_factors(), {r[1] for r in rows}, "app_id")):
        assert "Join" not in f._jdf.queryExecution().executedPlan().toString() and dict(f.dtypes)[c] == "bigint"
        assert {r[c] for r in f.collect()} == ids
    big = als.ImplicitALS(rank=2, iters=2).fit(df.selectExpr(f"user_id + {2**40} AS user_id", "app_id", "relevance_score"))
    assert {r.user_id for r in big.user_factors().collect()} == {u + 2**40 for u, _, _ in rows} and indexed == ["user_id"]


def test_fold_in_sums_over_pieces(spark, monkeypatch):
    """A user whose rows cross batches and pieces gets the solution of all rows; wide factors move once, with their row."""
    import numpy as np
    from ludex.operators import als
    monkeypatch.setattr(als, "SUM_VALUES", 20 * 20 * 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(3)
        y = rng.normal(size=(40, 20))
        items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(y)], "app_id long, features array<double>")
        rows = [(u, int(i), float(rng.uniform(0, 1))) for u, n in ((1, 40), (2, 1), (3, 25), (-4, 3)) for i in rng.permutation(40)[:n]]
        df = spark.createDataFrame([*rows, (5, 99, 1.0), (6, 1, 0.0), (None, 1, 1.0)], "user_id long, app_id long, relevance_score double")
        out = als.fold_in(items, df, 20, 0.1, 3.0)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Summarizer" not in plan and "_a" not in plan
        got = {r.user_id: np.asarray(r.features) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {1, 2, 3, -4}
    for u in got:
        own = [(y[i], 1.0 + 3.0 * r) for v, i, r in rows if v == u]
        a = y.T @ y + sum((c - 1.0) * np.outer(f, f) for f, c in own) + 0.1 * len(own) * np.eye(20)
        assert np.allclose(got[u], np.linalg.solve(a, sum(c * f for f, c in own)))


def test_embedding_table_moves_narrow_rows(spark):
    """V4: no key group holds vectors; first vectors of repeated keys, misses left out, as a brute join does."""
    from ludex.operators import explore as ex
    facts = spark.createDataFrame([(1, 10, 0.5, ["a"]), (1, 10, 0.3, ["b"]), (1, 11, 0.1, ["c"]), (2, 10, 0.9, ["d"]), (3, 10, 0.7, ["e"])],
                                  "user_id long, app_id long, score double, genres array<string>")
    games = spark.createDataFrame([(10, [1.0, 2.0]), (10, [0.5, 9.0]), (12, [3.0, 3.0])], "app_id long, game_emb array<float>")
    users = spark.createDataFrame([(1, [5.0, 6.0]), (2, [7.0, 8.0])], "user_id long, user_emb array<double>")
    out = ex.embedding_table(facts, games, users, ["user_id", "app_id"], "genres", "score", dim=2)
    assert sorted((r.user_id, r.app_id, r.main_genre, r.score, r.game_emb_0, r.game_emb_1, r.user_emb_0) for r in out.collect()) == \
        [(1, 10, "a", 0.5, 0.5, 9.0, 5.0), (1, 10, "b", 0.3, 0.5, 9.0, 5.0), (2, 10, "d", 0.9, 0.5, 9.0, 7.0)]
