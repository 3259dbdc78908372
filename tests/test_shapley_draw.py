"""Shapley rows get their vectors after the draw."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from ludex.operators import explore as ex


def test_shapley_rows_get_vectors_after_the_draw(spark, monkeypatch):
    from ludex.plans import q_explore, q_model
    seen, wide = [], q_model.mlp_wide
    monkeypatch.setattr(q_model, "mlp_wide", lambda x, *rest: seen.append(x) or wide(x, *rest))
    monkeypatch.setattr(ex, "shapley_sample", lambda rows, background, *rest, **kw: rows.withColumns({"feature": F.lit("f"), "shapley": F.lit(0.0)}) if seen.append(rows) is None else None)
    q_explore.q_shapley(spark, SF_SMALL).count()
    monkeypatch.setattr(q_model, "mlp_wide", wide)
    full = q_model.mlp_inputs(spark, SF_SMALL)[0].withColumn("row_key", F.col("user_id") * 1_000_000 + F.col("app_id"))
    assert seen[0].count() <= 300 < full.count()
    cols = ["row_key", "game_type_encoded", "f_price", "game_emb_3", "user_emb_5"]
    pick = lambda df: sorted((r.row_key, r.game_type_encoded, *(round(v, 9) for v in r[2:])) for r in df.select(cols).collect())
    assert pick(seen[1]) == pick(ex.sample_n(full, 200, "row_key"))
